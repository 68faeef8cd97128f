import zlib

from quillmill.llm import language

from .helpers import awkward, docs


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    rows = language.op5_language(spark, where).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_defined_cases(spark):
    known = language.dictionaries(docs(spark, ["the cat of the house"] * 5, "en").union(docs(spark, ["der hund und die katze"] * 5, "de")))
    assert list(known) == ["de", "en"]
    out = {r["doc_id"]: r for r in language.predict(docs(spark, [*awkward(), "123 ...", "the house of the cat"]), known).collect()}
    n = len(awkward())
    assert [out[i]["lang_pred"] for i in (0, 1, 2, 3, n)] == ["und"] * 5
    assert out[n + 1]["lang_pred"] == "en"
    assert language.dictionaries(docs(spark, [])) == {}
    assert {r["lang_pred"] for r in language.predict(docs(spark, ["abc"]), {}).collect()} == {"und"}
    assert language.keep_confident(spark, docs(spark, [])).columns == ["doc_id", "text", "lang", "source", "n_chars"]

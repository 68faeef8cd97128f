"""Plans that must not depend on how small a compressed table looks."""

import re

import pytest
from pyspark.sql import functions as F

from quillmill.functions import match, text
from quillmill.operators import entity, knowledge
from quillmill.plans import catalog

ENTRY = "alias string, company string, source string, weight int, rule int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def copies(spark, tmp_path, n):
    rows = spark.range(n).select(F.col("id").alias("seq"), F.lit("word3-word250-some other words").alias("title"))
    rows.write.parquet(f"{tmp_path}/titles")
    return spark.read.parquet(f"{tmp_path}/titles")


def dictionary(spark, n):
    return spark.createDataFrame([(f"word{i}", f"company {i}", "alias_map", 110, i) for i in range(n)], ENTRY)


def test_titles_that_compress_well_are_never_sent(spark, tmp_path):
    titles, entries = copies(spark, tmp_path, 2000), dictionary(spark, 300)
    for most in (entity.FEW, 300):  # by grams, and one by one
        entity.FEW, was = most, entity.FEW
        try:
            found = entity.candidates(titles, entries, {})
        finally:
            entity.FEW = was
        assert "BuildLeft" not in plan(found)
        assert {r["company"]: r["count"] for r in found.groupBy("company").count().collect()} == {"company 3": 2000, "company 250": 2000}
        best = entity.best_company(titles, found)
        assert "SortMergeJoin" in plan(best) and {r["company"] for r in best.select("company").distinct().collect()} == {"company 3"}


def test_few_words_are_found_as_many_are(spark):
    texts = spark.createDataFrame([(1, "a word1 and word12"), (2, ""), (3, None), (4, "word299")], "seq long, text string")
    words = spark.createDataFrame([(f"word{i}",) for i in range(300)] + [("",)], "word string")
    many = sorted(map(tuple, entity.contained(texts, words).collect()), key=str)
    few = sorted(map(tuple, entity.contained(texts, words.where("word in ('word1', 'word12', 'word2', 'word29', 'word299', '')")).collect()), key=str)
    assert many == few and (1, "a word1 and word12", ["word1", "word12"]) in few and (4, "word299", ["word2", "word29", "word299"]) in few


def test_texts_of_lookups_stay_where_they_are(spark):
    lookups = spark.createDataFrame([("and", ["salt and pepper of the sea", "the and of"] * 4)], "token string, arr array<string>")
    entries = spark.createDataFrame([("of", "Alpha", "alias_map", 110, 0), ("the", "Beta", "alias_map", 110, 1)], ENTRY)
    found = entity.infer_owner(lookups, entries, {})
    assert "struct<_key:string,seq:bigint,gain:int>" in plan(found)
    assert [tuple(r) for r in found.collect()] == [("and", "Alpha", 24)]


def test_references_without_a_semicolon(spark):
    t = "a &amp;lt; b&amp c &copy;&copy=1 &ampfoo; &#65;&#x42; &#65"
    row = spark.createDataFrame([(t,)], "t string").select(text.scoring_content(F.col("t"), closed=True).alias("closed"), text.scoring_content(F.col("t")).alias("all")).first()
    assert row["closed"] == "a &lt; b&amp c ©&copy=1 &ampfoo; AB &#65"
    assert row["all"] == "a &lt; b& c ©©=1 &foo; AB A"


def test_a_text_is_searched_once_for_titles(spark):
    # The found titles were searched again for each of them.
    inner = match.longest_only(F.filter(F.split("t", " "), lambda w: F.length(w) > 2))
    df = spark.createDataFrame([("nation tion of on nations",)], "t string").select(inner.alias("x"))
    assert df.first()["x"] == ["nations"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def brute(posts, hot):
    out = {}
    for seq, ids, titles in posts:
        for i, title, f in hot:
            by = (["id"] if i is not None and i in ids else []) + (["title"] if title.replace(" ", "") in titles else [])
            if by:
                key = f"id:{i}" if i is not None else "title:" + title.replace(" ", "")
                out.setdefault((seq, key), []).append((by, f, title))
    return {k: (min((("id" not in b), -f, t) for b, f, t in v)[1:], sorted({x for b, _, _ in v for x in b})) for k, v in out.items()}


def test_entries_meet_posts_without_a_shuffle_of_the_meetings(spark):
    hot = [(i, "same title", i % 3) for i in range(30)] + [(None, "same title", 2), (None, "free", 1), (50, "one", 4), (50, "two", 9), (50, "three", 1), (51, "one", 2)]
    posts = [(s, [s, 40, 50 + s % 4], ["sametitle", "three", "one"][: s % 4]) for s in range(40)] + [(99, [50], ["free", "one", "two"])]
    out = knowledge.match_details(spark.createDataFrame(posts, "seq long, ids array<int>, titles array<string>"), spark.createDataFrame(hot, "id int, title string, frequency int"))
    got = {(r["seq"], r["key"]): ((-r["frequency"], r["title"]), r["matched_by"]) for r in out.collect()}
    assert len(got) == out.count() and got == brute(posts, hot)
    # Entries of one title: nothing is left to gather by post and entry.
    out = knowledge.match_details(spark.createDataFrame(posts, "seq long, ids array<int>, titles array<string>"), spark.createDataFrame(hot[:31], "id int, title string, frequency int"))
    assert {(r["seq"], r["key"]) for r in out.collect()} == set(brute(posts, hot[:31]))
    assert "hashpartitioning(seq#" not in "\n".join(x for x in plan(out).split("== Initial Plan ==")[0].splitlines() if ", key#" in x)


@pytest.mark.parametrize("name", ["entity_canonical", "entity_best", "entity_whitelist", "scan_clean"])
def test_no_query_sends_its_titles(spark, tmp_path, name):
    """Titles with their grams were sent to all tasks where the table was small on disk."""
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    copies_of = part.crossJoin(spark.range(40)).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 1000).drop("id")
    copies_of.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    out = catalog.QUERIES[name](spark, str(tmp_path))
    shown = plan(out)
    assert out.select("seq").distinct().count() == copies_of.count()
    # What is sent is a dictionary or a row a range, never the table of titles.
    sent = re.findall(r"BroadcastExchange[^\n]*\n(?:[^\n]*\n){0,8}", shown)
    assert not any("p_name" in x or "title" in x for x in sent), sent

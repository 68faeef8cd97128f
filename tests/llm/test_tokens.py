import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmill.llm import encoding, packing, token_store
from quillmill.llm.common import shared_dir

from .helpers import awkward, docs, saved


def plain(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_store_round_trip(spark, sf, tmp_path):
    for where in (saved(spark, tmp_path, [*awkward(), "it's <|endoftext|> odd", "x\n y  z"]), sf):
        source = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect())
        got = {r["doc_id"]: r for r in token_store.op6_token_store(spark, where).collect()}
        start = 0
        for i, text in source:
            ids = plain("word_bpe_49k.json", text, 1)
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids)), i
            start += len(ids)
        assert len(got) == len(source)


def test_store_keeps_chunks_once_and_detects_damage(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    root = f"{shared_dir(spark)}/store-test-{id(text)}"
    token_store.write(docs(spark, [text] * 20), root, public_tokenizers.path("word_bpe_49k.json"))
    stored = token_store.chunks(spark, root)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_store.recipes(spark, root).count() == 20
    assert len({tuple(bytes(d) for d in r["digests"]) for r in token_store.recipes(spark, root).collect()}) == 1
    bad = spark.createDataFrame([(0, 99, 1, [b"x" * 16])], "part int, doc_id long, n_tokens long, digests array<binary>")
    bad.write.mode("append").parquet(f"{root}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read(spark, root)


def test_empty_store(spark, tmp_path):
    assert token_store.op6_token_store(spark, saved(spark, tmp_path, [])).count() == 0


def test_crc_combination():
    a, b, c = b"hello", b"", b"world" * 99
    parts = [(zlib.crc32(x), len(x)) for x in (a, b, c)]
    assert token_store.combine_crc(parts) == zlib.crc32(a + b + c)


def test_cuts_follow_content():
    r = np.random.default_rng(0).integers(0, 49000, 5000).astype(np.uint32)
    a = [r[s:e].tobytes() for s, e in zip([0, *token_store.cuts(r)], token_store.cuts(r))]
    shifted = np.concatenate([np.arange(37, dtype=np.uint32), r])
    ends = token_store.cuts(shifted)
    b = [shifted[s:e].tobytes() for s, e in zip([0, *ends], ends)]
    assert len(set(a) & set(b)) >= len(a) - 3
    assert all(len(x) // 4 <= token_store.MOST for x in a)


def test_packing_is_exact_and_tight(spark, sf, tmp_path):
    for where in (saved(spark, tmp_path, [*awkward(), *["same text here"] * 50]), sf):
        source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
        rows = packing.op8_packing(spark, where).collect()
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
        assert by_doc.keys() == source.keys()
        for i, text in source.items():
            ids, at = plain("byte_bpe_50k.json", text, 0), 0
            for r in sorted(by_doc[i], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
        assert sorted(by_seq) == list(range(len(by_seq)))
        for pieces in by_seq.values():
            at = 0
            for r in sorted(pieces, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 1024
        tokens = sum(r["length"] for r in rows)
        assert len(by_seq) <= -(-tokens // 1024) * 1.05 + 2


def test_best_fill_is_optimal():
    import itertools
    import random

    r = random.Random(4)
    for _ in range(60):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(4)}
        cap = r.randrange(5, 80)
        best = max(sum(k * n for k, n in zip(counts, take)) for take in itertools.product(*[range(v + 1) for v in counts.values()]) if sum(k * n for k, n in zip(counts, take)) <= cap)
        fill = packing.best_fill(counts, cap)
        assert sum(k * v for k, v in fill.items()) == best and all(v <= counts[k] for k, v in fill.items())


def test_no_documents(spark, tmp_path):
    assert packing.op8_packing(spark, saved(spark, tmp_path, [])).count() == 0


def test_documents_are_rebuilt_from_the_store(spark):
    rows = [*awkward(), "same text here", "same text here", None]
    root = f"{shared_dir(spark)}/store-rebuilt-{id(rows)}"
    frame = docs(spark, rows).withColumn("doc_id", F.when(F.col("doc_id") % 5 != 2, F.col("doc_id") % 7))
    token_store.write(frame, root, public_tokenizers.path(token_store.VOCABULARY))
    found = token_store.rebuild(spark, root).collect()
    want = sorted((str(r["doc_id"]), np.array(plain("word_bpe_49k.json", r["text"], 1), dtype="<u4").tobytes()) for r in frame.collect())
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in found) == want
    total, at = 0, {r["seq"]: r for r in found}
    starts = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in token_store.read(spark, root).collect()}
    for k in sorted(at):
        assert (at[k]["doc_id"], total, zlib.crc32(bytes(at[k]["ids"]))) in starts
        total += at[k]["n_tokens"]
    manifest = spark.read.parquet(f"{root}/manifest").collect()
    parts = sorted((r["part"], bytes(r["root"])) for r in manifest)
    assert parts[0][0] == -1 and parts[0][1] == token_store.merkle([x for _, x in parts[1:]])


def test_units_encode_as_the_library_does():
    r = random.Random(4)
    pieces = ["the", " ", "  ", "\n", "don't", "L'eau", "x9", "42", "é", "Ünï", "...", "!?", "'s", "a'", "_", "$5", "ça", "ABC", "-", "\t", "日", "<|", "\u00d7", "\x00"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        path = public_tokenizers.path(name)
        tool = Tokenizer.from_file(path)
        for i, ids in encoding.encoded(texts, path, spaced):
            assert ids.tolist() == tool.encode(texts[i], add_special_tokens=False).ids, texts[i]

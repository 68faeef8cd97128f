import math
import re
import zlib
from collections import Counter

import pytest

from pyspark.sql import functions as F

from quillmill.llm import interpolation

from .helpers import awkward, docs, saved


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("where", ["sf", "awkward"])
def test_counts_and_base_score(spark, sf, tmp_path, where):
    path = sf if where == "sf" else saved(spark, tmp_path, [*awkward(), *["A b a"] * 5])
    source = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in source}
    c = Counter(t for i, ts in source.items() if not held[i] for t in ts)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in interpolation.op7_interpolation(spark, path).collect()}
    assert got.keys() == source.keys()
    for i, ts in source.items():
        r = got[i]
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(c[t] > 0 for t in ts), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_score_is_the_interpolated_model(spark):
    texts = ["a b a b c", "a b b", "c c a", "b"]
    frame = docs(spark, texts).withColumn("train", interpolation.F.col("doc_id") < 3)
    seen = {}
    original = interpolation.fit
    interpolation.fit = lambda cells, v: seen.setdefault("w", original(cells, v))
    try:
        got = {r["doc_id"]: r["score"] for r in interpolation.score(frame).collect()}
    finally:
        interpolation.fit = original
    c, pair = Counter(), Counter()
    for t in texts[:3]:
        ts = tokens(t)
        c.update(ts)
        pair.update(zip(["start", *ts[:-1]], ts, strict=True))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        total = 0.0
        for h, w in zip(["start", *tokens(t)[:-1]], tokens(t), strict=True):
            ch = c[None] if h == "start" else c[h]
            a, u, z = seen["w"][0 if ch == 0 else ch.bit_length()]
            assert a + u + z == pytest.approx(1)
            total += math.log10((a * pair[h, w] / ch if ch else 0) + u * c[w] / n + z / (v + 1))
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_beats_the_base_on_held_out_text(spark):
    rows = [r for r in interpolation.op7_interpolation(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_rows(spark, tmp_path):
    assert interpolation.op7_interpolation(spark, saved(spark, tmp_path, [])).count() == 0


def test_without_training_rows_the_model_is_uniform(spark):
    """V = 0, so each token has all of the mass of the floor: probability 1, for any text."""
    rows = docs(spark, ["a b", None, "c"]).select("doc_id", "text").withColumn("train", F.lit(False))
    got = {r["doc_id"]: r for r in interpolation.score(rows).collect()}
    assert {i: (r["n_tokens"], r["n_known"], r["score"]) for i, r in got.items()} == {0: (3, 0, 0.0), 1: (1, 0, 0.0), 2: (2, 0, 0.0)}

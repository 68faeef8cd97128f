"""Resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.llm import resampling

from .helpers import awkward, docs, prose, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, target, buckets=10_000):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""

    def hashed(text):
        w = WORD.findall((text or "").translate(LOW))
        return len(w), [zlib.crc32(g.encode()) % buckets for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    every = [(i, *hashed(t)) for i, t in rows]
    s, t = Counter(b for *_, f in every for b in f), Counter(b for x in target for b in hashed(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in every:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= 20))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


TEXTS = [*awkward(), *(prose(k, 19 + k, 60) for k in range(30)), "KK İ ÄÖ Straße " * 9, "a b " * 40]


@pytest.mark.parametrize("target", [[], [None, ""], [prose(3, 300, 60), "one w1 w2", None]])
def test_against_plain(spark, tmp_path, target):
    path = saved(spark, tmp_path, TEXTS)
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    got = resampling.op13_resampling(spark, path)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(enumerate(TEXTS), target)


def test_repeated_rows_and_rows_without_id(spark):
    base = docs(spark, TEXTS).select("doc_id", "text")
    rows = base.union(base.where("doc_id > 20")).union(base.where("doc_id in (3, 25)").select(F.lit(None).cast("long"), "text"))
    got = resampling.resample(rows, docs(spark, [prose(3, 300, 60)]))
    assert sorted(map(tuple, got.collect()), key=repr) == plain([tuple(r) for r in rows.collect()], [prose(3, 300, 60)])


def test_other_orders(spark):
    f = resampling.features(docs(spark, ["a b c", "x", None]).select("doc_id", "text"), orders=3, buckets=1 << 31)
    grams = {0: ["a", "b", "c", "a b", "b c", "a b c"], 1: ["x"], 2: [None]}
    want = sorted(((d, None if g is None else zlib.crc32(g.encode()) % (1 << 31)) for d, gs in grams.items() for g in gs), key=repr)
    assert sorted(((r["doc_id"], r["bucket"]) for r in f.collect()), key=repr) == want


def test_drawn_documents_resemble_the_target(spark):
    near, other = [prose(k, 60, 50) for k in range(40)], [" ".join(f"v{i * k % 97}" for i in range(60)) for k in range(1, 161)]
    table = docs(spark, [*near, *other])
    ranks = resampling.resample(table.select("doc_id", "text"), docs(spark, [prose(k, 60, 50) for k in range(50, 60)]))
    kept = resampling.drawn_documents(table, ranks)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == table.columns and len(ids) == 50
    assert sum(i < 40 for i in ids) >= 18  # 10 by chance; the noise has the scale of the weights


def test_words_are_not_shuffled(spark):
    """One exchange of texts, none between the words and their window."""
    plan = resampling.features(docs(spark, ["a b"]).select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    tree = plan.split("Initial Plan")[-1]
    assert tree.index("Window") < tree.index("Generate", tree.index("Window")) and "Exchange" not in tree[tree.index("Window") : tree.rindex("Generate")]


def test_features_are_made_in_compiled_code(spark):
    """A function over an array is interpreted, with a call a word: a quarter of the query's time."""
    made = resampling.features(docs(spark, ["a b", "", None]).select("doc_id", "text"))
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["n_words"], r["bucket"] is None) for r in made.collect()) == [(0, True), (0, True), (2, False), (2, False), (2, False)]

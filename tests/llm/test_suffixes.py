import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.llm import common, suffixes

from .helpers import awkward, docs, prose, saved


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    out = []
    for b in raw:
        lost = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                lost[k : k + 200] = True
        edges = np.diff(np.concatenate([[0], lost.astype(int)]))
        kept = bytes(x for x, y in zip(b, lost, strict=True) if not y)
        out.append((len(b), int(lost.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    passage, other = prose(21, 60), "é" * 90 + prose(22, 40)
    out = [*awkward()[:8], "ab" * 200, "x" * 650, "y" * 199, "z" * 200, "z" * 200]
    for i in range(30):
        a, b = r.randrange(0, 120), r.randrange(130, len(passage))
        out.append(prose(400 + i, 30) + passage[a:b] + prose(500 + i, 20) + other[: r.randrange(100, len(other))])
    base = prose(23, 300)
    for i in range(12):
        words = base.split()
        words[r.randrange(len(words))] = f"edit{i}"
        out.append(" ".join(words))
    return [*out, base[:250], base[50:249], base[50:250]]


def test_matches_brute_force(spark, texts, tmp_path):
    rows = suffixes.op10_suffixes(spark, saved(spark, tmp_path, texts)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_ids_and_empty(spark, tmp_path):
    a, b = prose(31, 80), prose(32, 80)
    mixed = spark.createDataFrame([(1, a), (1, b), (2, a), (None, b)], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["text"]) for r in suffixes.strip(mixed).collect())
    assert out == [(0, ""), (1, ""), (1, ""), (2, "")]
    assert suffixes.op10_suffixes(spark, saved(spark, tmp_path, [])).count() == 0
    assert suffixes.strip(docs(spark, [])).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_strip_keeps_whole_characters(spark):
    shared = "é" * 150
    out = {r["doc_id"]: r for r in suffixes.strip(docs(spark, ["a" + shared + "b" * 50, "c" + shared + "d" * 50])).collect()}
    assert out[0]["text"] == "a" + "b" * 50 and out[0]["n_chars"] == 51


@pytest.mark.parametrize("seed", range(3))
def test_merge_sort_orders_suffixes(seed):
    rng = np.random.default_rng(seed)
    rows = rng.integers(97, 99, (300, suffixes.SIDE)).astype(np.uint8)
    rows[:, rng.integers(5, 60) :] = 98
    group = np.sort(rng.integers(0, 6, 300))
    order, ext = suffixes.sorted_extensions(rows, group)
    want = sorted(range(300), key=lambda i: (group[i], rows[i].tobytes(), i))
    assert [rows[i].tobytes() for i in order] == [rows[i].tobytes() for i in want]
    for k in range(1, 300):
        a, b = rows[order[k - 1]], rows[order[k]]
        same = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        assert ext[k] == (same if group[k] == group[k - 1] else -1)


def test_collisions_fall_back_to_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "BYTE_VALUE", np.zeros(256, dtype=np.uint64))
    rows = np.random.default_rng(1).integers(97, 122, (50, suffixes.SIDE)).astype(np.uint8)
    order, _ = suffixes.sorted_extensions(rows, np.zeros(50, dtype=np.int64))
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)


def test_long_runs_need_few_anchors(spark):
    texts = ["x" * 5000, "y" * 100 + "x" * 200, "ab" * 300 + "c", "x" * 200 + "z" * 10, "q" * 201, "w" * 200, "abcd" * 90, "head " + "-" * 400 + " tail", "\n" * 250 + "one", "x" * 199]
    raw = [t.encode() for t in texts]
    assert len(suffixes.anchors([b"x" * 100_000])[0]) < 300
    count = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    want = {}
    for i, b in enumerate(raw):
        lost = set()
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                lost |= set(range(k, k + 200))
        if lost:
            want[i] = (len(lost), bytes(x for k, x in enumerate(b) if k not in lost))
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffixes.removed(docs(spark, texts)).collect()}
    assert got == want


def test_one_step_in_python_after_the_edges(spark):
    """Runs were merged in one step and cut out in another, which kept two workers a task."""
    shared = "".join(map(chr, np.random.default_rng(5).integers(97, 123, 260)))
    texts = ["a" * 7 + shared + "b" * 50, "c" + shared + "d" * 90, "e" * 900, "f", shared[:230] + "g" + shared[30:]]
    out = suffixes.removed(docs(spark, texts))
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("MapInPandas") == 1
    got = {r["doc_id"]: r["n_removed"] for r in out.collect()}
    assert got == {i: n for i, (_, n, _, _) in enumerate(brute(texts)) if n} and len(got) == 4


def test_batches_are_bounded_by_bytes(spark):
    common.prepare(spark)
    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = long.mapInPandas(lambda batches: (pd.DataFrame({"n": [int(b["t"].str.len().sum())]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 60 << 20 and max(r["n"] for r in sizes) <= 3 * common.ARROW_BYTES

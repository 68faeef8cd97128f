"""Place numbers and running sums over ranges against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import order

ROWS = "seq long, key string, v int"


def table(spark, n, seed=3):
    r = random.Random(seed)
    seqs = r.sample(range(10 * n), n)
    return [(s, r.choice(["hot", "hot", "hot", "a", None]), r.choice([0, 1, 2, None])) for s in seqs]


@pytest.mark.parametrize("n", [0, 1, 7, 500])
@pytest.mark.parametrize("before", [False, True])
def test_running_sums(spark, n, before):
    rows = table(spark, n)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = order.running(df, "key", ["seq"], {"n": F.lit(1), "total": F.col("v")}, before, parts=5)
    assert got.columns == ["seq", "key", "v", "n", "total"]
    seen, want = {}, []
    for s, k, v in sorted(rows, key=lambda x: x[0]):
        a, b = seen.get(k, (0, 0))
        seen[k] = (a + 1, b + (v or 0))
        want.append((s, k, v, *((a, b) if before else seen[k])))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 400])
def test_numbers(spark, n):
    rows = table(spark, n)
    got = order.numbered(spark.createDataFrame(rows, ROWS).repartition(3), F.desc("seq"), name="at", first=0)
    assert sorted((r["at"], r["seq"]) for r in got.collect()) == list(enumerate(sorted((r[0] for r in rows), reverse=True)))


def test_a_key_is_spread(spark):
    """All rows under one key: no task gets them all."""
    df = spark.range(2000).select(F.col("id").alias("seq"), F.lit("one").alias("key"))
    kept = order.ranged(df, "seq", parts=8)
    sizes = [r["count"] for r in kept.groupBy(order.PART).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 800

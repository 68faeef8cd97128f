"""Dual-tree clustering against plain Lloyd rounds, and the trees' invariants."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillmill.llm import lloyd

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k=16, rounds=3):
    """Result rows of the contract, in Python integers."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e, _ in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, a, d in last if a == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, a, d, total[a], sum(total.values()), digest[a]) for i, a, d in last), key=repr)


def vectors(seed, n, spread, groups):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(groups)]
    return [(i, [x + r.gauss(0, spread) for x in r.choice(middle)], 0) for i in range(n)]


CASES = {
    "clustered": vectors(1, 700, 0.01, 20),
    "scattered": vectors(2, 500, 0.5, 30),
    "few": vectors(3, 5, 0.1, 2),
    "one": [(7, [0.5] * 64, 1)],
    "same": [(i, [0.25] * 64, 0) for i in range(40)],
    "ties": [(i, [float(i % 3)] + [0.0] * 62 + [float(i // 3 % 2)], 0) for i in range(90)],
    "large": [(i, [x * 2.0**40 for x in e], 0) for i, e, _ in vectors(4, 60, 0.2, 4)],
    "mixed": [(i, [x * 2.0**40 for x in e] if i == 5 else e, 0) for i, e, _ in vectors(5, 60, 0.2, 4)],
    "awkward": [(None, [0.1] * 64, 0), (1, None, 0), (2, [], 0), (3, [1.0] * 63, 0), (4, [None] * 64, 0), (5, [float("nan")] * 64, 0), (6, [float("inf")] + [0.0] * 63, 0), (8, [-0.01] * 64, None), (8, [-0.01] * 64, None), (None, [0.7] * 64, 0)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain_rounds(spark, tmp_path, name):
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(CASES[name], SCHEMA).repartition(3).write.parquet(path)
    got = lloyd.op12_lloyd(spark, str(tmp_path))
    rows = sorted(map(tuple, got.collect()), key=repr)
    if name in ("large", "mixed"):  # distances beyond 64 bits are held at the greatest long
        held = sorted(((*r[:2], min(r[2], 2**63 - 1), *r[5:]) for r in plain(CASES[name])), key=repr)
        assert [(*r[:3], *r[5:]) for r in rows] == held
    else:
        assert rows == plain(CASES[name])
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("seed,n,spread,most", [(1, 600, 0.01, 60), (2, 400, 0.5, 400), (3, 3, 0.1, 3), (4, 200, 0.0, 50)])
def test_tree_keeps_its_invariants(seed, n, spread, most):
    x = np.array([v for _, v, _ in vectors(seed, n, spread, 8)]) * 64 // 1
    t = lloyd.grow(x, most)
    c = x[t.centres]
    gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
    for a in range(1, t.last + 1):
        old, new = len(t.up[a - 1]), len(t.up[a])
        assert new > old and (t.up[a][:old] == np.arange(old)).all()  # nested
        apart = gap[:new, :new][~np.eye(new, dtype=bool)].min()
        reach = gap[np.arange(old, new), t.up[a][old:]].max()
        assert reach <= 2 * apart * (1 + 1e-9)  # nets of radius 2**(i+1) and separation 2**i
    for a in range(t.last + 1):
        node = t.above(a)[t.leaf]
        assert (lloyd.gaps(x, x[t.centres[node]]) <= t.radius[a][node]).all()  # covering


def test_bounds_turn_pairs_away():
    x = np.floor(np.array([v for _, v, _ in vectors(9, 2000, 0.02, 60)]) * 64)
    c = x[:300]
    tree = lloyd.grow(x, len(x) // lloyd.LEAF)
    found, _, compared = lloyd.nearest(tree, x, x.astype(np.int64), lloyd.grow(c, len(c)), c.astype(np.int64))
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (found == far.argmin(axis=1)).all() and compared < len(x) * len(c) / 10

import numpy as np
import pytest

from quillmill.llm import collisions


def usable(v):
    a = np.array([np.nan if x is None else x for x in (v if v is not None else [])], dtype=float)
    return a / np.linalg.norm(a) if a.size and np.isfinite(a).all() and np.abs(a).max() > 0 else None


def brute(ids, rows):
    v = [usable(r) for r in rows]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = dict.fromkeys(ids, 0)
    for a in range(len(ids)):
        for b in range(a):
            if v[a] is not None and v[b] is not None and len(v[a]) == len(v[b]) and float(v[a] @ v[b]) >= 0.9:
                links[ids[a]] += 1
                links[ids[b]] += 1
                x, y = find(ids[a]), find(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in ids}


@pytest.mark.parametrize("split", [1500, 40])
def test_matches_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(collisions, "LIST", split)
    r = np.random.default_rng(5)
    base = r.standard_normal((120, 32))
    rows = [*base.tolist()]
    rows += (base[0] + 0.05 * r.standard_normal((90, 32))).tolist()
    rows += [(3 * base[1]).tolist()] * 30
    rows += [(base[k] + 0.2 * r.standard_normal(32)).tolist() for k in range(60)]
    rows += [None, [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0, 2.0], [], [float("inf")] * 32]
    ids = list(range(len(rows)))
    want = brute(ids, rows)
    frame = spark.createDataFrame(list(zip(ids, rows, strict=True)), "vec_id long, embedding array<double>")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in collisions.near(frame).collect()}
    assert got.keys() == want.keys()
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in ids)
    assert np.mean([got[i][1] == want[i][1] for i in ids]) >= 0.97


def test_recall_on_the_table(spark):
    where = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{where}/embeddings.parquet").toPandas()
    want = brute(t["vec_id"].tolist(), t["embedding"].tolist())
    got = {x["vec_id"]: x["n_links"] for x in collisions.op2_collisions(spark, where).collect()}
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values())


def test_calibration_and_empty(spark):
    for n in (500, 50_000, 1_000_000):
        window, least, recall = collisions.calibrated(64, collisions.projections(n))
        assert 0 < window < 2 and least >= 1 and recall >= 0.95
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert collisions.near(empty).count() == 0


def test_lengths_ids_and_copies(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [-1.0, 0.0]), (6, [2.0]), (7, [3.0]), (8, [-1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in collisions.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 8)}, 6: (1, 6, True), 7: (1, 6, False)}
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [2.0, 4.1]), (None, [1.0, -9.0]), (None, None)]
    got = collisions.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("None", 0, "None", True), ("None", 0, "None", True), ("None", 3, "1", False)]


def test_windows_and_counts_match_brute_force():
    r = np.random.default_rng(3)
    d = collisions.directions(16, 64)
    x = collisions.unit(r.standard_normal((40, 16)))
    t, v = collisions.listed(x, d)
    for p in (0, 7, 40):
        count, first = collisions.collisions(t, v, t, v, p, 0.3)
        for a in range(40):
            for b in range(40):
                both = sorted(q for q in set(t[a]) & set(t[b]) if abs(v[a][list(t[a]).index(q)] - v[b][list(t[b]).index(q)]) <= 0.3)
                assert count[a, b] == len(both) and first[a, b] == (bool(both) and both[0] == p)


def test_nothing_is_found_without_windows(spark, monkeypatch):
    monkeypatch.setattr(collisions, "calibrated", lambda dim, n: (1e-9, 1, 1.0))
    r = np.random.default_rng(5)
    base = r.standard_normal(16)
    rows = [(i, (base + 0.05 * r.standard_normal(16)).tolist()) for i in range(20)]
    assert sum(x["n_links"] for x in collisions.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == 0

"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every vector is projected on many random directions and listed at the TOP greatest of its
projections. Each projection's list is put in order of the projected value, and every vector
of it is the query of a window of half-width W around its own value: the vectors in there
collide with it. Collisions of a pair are counted over all projections, and pairs with at
least C of them are verified by their cosine in double precision. W and C are calibrated at run
time on random pairs at the threshold itself (`calibrated`): W holds all but TAIL of their
differences, and C is the greatest count that at least RECALL of them reach.

Equal vectors are one class first, with one representative and a number of copies. A list's
ordered values are cut in stretches of STRETCH windows; a vector less than a window from the
next stretch visits it, so each pair within a window meets once. Stretches of over LIST vectors,
as of a group of near copies, are dealt to tasks by pairs of parts. A pair is counted at its
least colliding projection only. Tasks return each vector's number of links and a spanning
forest of its links, never the pairs. Vectors of different lengths are compared apart.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite component links
with nothing and is its own component; vectors of different lengths do not link; equal vectors
link, whatever their ids; rows are counted one by one, also those that share a vec_id or have
none; a component without any vec_id has null as its id; extra columns are ignored; an empty
table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table

THRESHOLD = 0.9
TOP = 10
#: Calibration: share of differences outside the window, and of pairs at the threshold to find.
TAIL, RECALL = 0.002, 0.97
SEED = 20240229
#: Vectors that meet in one task, and windows in a stretch of a list.
LIST, STRETCH = 1500, 4


def directions(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, n), dtype=np.float32)


def projections(n: int) -> int:
    """Projections for n vectors: lists then grow as the square root of n (to a billion)."""
    return int(min(1 << 17, max(256, 4 * 2 ** np.ceil(np.log2(max(n, 1)) / 2))))


def listed(x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The TOP projections of unit vectors x, ascending, and the values there."""
    values = x.astype(np.float32) @ d
    tops = np.sort(np.argpartition(-values, TOP, axis=1)[:, :TOP], axis=1)
    return tops.astype("<i4"), np.take_along_axis(values, tops, axis=1)


def pairs_at(threshold: float, dim: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(1)
    a, b = r.standard_normal((2, samples, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    return a, threshold * a + np.sqrt(1 - threshold**2) * b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)


@lru_cache(maxsize=64)
def calibrated(dim: int, n: int, threshold: float = THRESHOLD, samples: int = 500) -> tuple[float, int, float]:
    """Half-width of the window, least number of collisions, and the share of random pairs at
    the threshold that has as many, for n projections."""
    if dim == 1:  # vectors of one sign are equal
        return 1e-3, 1, 1.0
    d = directions(dim, n)
    (ta, va), (tb, vb) = (listed(x, d) for x in pairs_at(threshold, dim, samples))
    same = ta[:, :, None] == tb[:, None, :]
    apart = np.abs(va[:, :, None] - vb[:, None, :])
    window = float(np.quantile(apart[same], 1 - TAIL)) if same.any() else 1.0
    count = (same & (apart <= window)).sum(axis=(1, 2))
    reached = [(c, float((count >= c).mean())) for c in range(1, TOP + 1)]
    least, recall = max([x for x in reached if x[1] >= RECALL] or reached[:1])
    return window, least, recall


def unit(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length one."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lists(vectors: DataFrame, sizes: dict[int, int], kind: str) -> DataFrame:
    """(dim, p, x, id, copies, tops, values, v): each of vectors(id, copies, dim, v) once for
    each projection at which it is listed, x its value there."""

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, np.ndarray] = {}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim not in made:
                    made[dim] = directions(int(dim), projections(sizes[int(dim)]))
                for i in range(0, len(part), 500):
                    rows = part.iloc[i : i + 500]
                    x = np.stack(rows["v"].to_numpy()).astype(kind)
                    tops, values = listed(unit(x), made[dim])
                    at = np.repeat(np.arange(len(x)), TOP)
                    body, marks, own = ([r.tobytes() for r in y] for y in (x, tops, values))
                    yield pd.DataFrame({"dim": int(dim), "p": tops.reshape(-1), "x": values.reshape(-1), "id": rows["id"].to_numpy()[at], "copies": rows["copies"].to_numpy()[at], "tops": [marks[k] for k in at], "vals": [own[k] for k in at], "v": [body[k] for k in at]})

    return vectors.mapInPandas(project, "dim int, p int, x float, id long, copies long, tops binary, vals binary, v binary")


def collisions(ta: np.ndarray, va: np.ndarray, tb: np.ndarray, vb: np.ndarray, p: int, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Collisions of each pair (row of a, row of b), and whether p is the least projection at
    which they collide."""

    def by_projection(t: np.ndarray, v: np.ndarray) -> tuple:
        order = np.argsort(t, axis=None, kind="stable")
        names, first = np.unique(t.reshape(-1)[order], return_index=True)
        return names, np.append(first, t.size), order // t.shape[1], v.reshape(-1)[order]

    (na, fa, ra, xa), (nb, fb, rb, xb) = by_projection(ta, va), by_projection(tb, vb)
    count, before, here = (np.zeros((len(ta), len(tb)), dtype=kind) for kind in (np.uint8, bool, bool))
    _, ia, ib = np.intersect1d(na, nb, assume_unique=True, return_indices=True)
    for name, i, j in zip(na[ia].tolist(), ia.tolist(), ib.tolist(), strict=True):
        a, b = slice(fa[i], fa[i + 1]), slice(fb[j], fb[j + 1])
        hit = np.abs(xa[a][:, None] - xb[b]) <= window
        at = np.ix_(ra[a], rb[b])
        count[at] += hit
        if name < p:
            before[at] |= hit
        elif name == p:
            here[at] = hit
    return count, here & ~before


def joined(label: np.ndarray, i: int, others: np.ndarray) -> None:
    """Give i and the others one label, the least of theirs."""
    found = label[others]
    least = min(int(found.min()), int(label[i]))
    if label[i] != least or (found != least).any():
        for x in np.unique(np.append(found, label[i])).tolist():
            if x != least:
                label[label == x] = least


def near(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding)."""
    kind = "<f8" if "double" in vectors.schema["embedding"].dataType.simpleString() else "<f4"
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).withColumn("usable", fine)
    rows = cut(rows.withColumn("r", F.monotonically_increasing_id()))
    classes = cut(rows.where("usable").groupBy("v").agg(F.min("r").alias("id"), F.count("*").alias("copies"), F.min("vec_id").alias("least")).withColumn("dim", F.size("v")))
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    made = cut(lists(classes.select("id", "copies", "dim", "v"), sizes, kind))
    half = {dim: calibrated(dim, projections(n))[:2] for dim, n in sizes.items()} or {0: (1.0, 1)}
    window = F.element_at(F.create_map(*[F.lit(x) for dim, (w, _) in half.items() for x in (dim, w)]), F.col("dim"))
    long = window * STRETCH
    place = made.withColumn("s", F.floor(F.col("x") / long)).withColumn("visits", F.col("x") > (F.col("s") + 1) * long - window * 1.0001)
    place = place.withColumn("at", F.explode(F.when(F.col("visits"), F.array("s", F.col("s") + 1)).otherwise(F.array("s")))).withColumn("guest", F.col("at") != F.col("s")).drop("s", "visits")
    # A row a stretch of a projection: how many parts it is dealt in.
    parts = place.groupBy("dim", "p", "at").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("k"))
    dealt = place.join(parts, ["dim", "p", "at"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    dealt = dealt.select("dim", "p", "at", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "guest", "x", "id", "copies", "tops", "vals", "v")

    def links(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim, p, _, i, j = key
        width, least = half[dim]
        pdf = pdf.sort_values(["x", "id"], kind="stable")  # the projection's order
        side = pdf["own"].to_numpy() == i
        left, right = np.flatnonzero(side), np.flatnonzero(side if i == j else ~side)
        of = lambda col, t: np.frombuffer(b"".join(pdf[col]), dtype=t).reshape(len(pdf), -1)
        ids, copies, guest, at = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["guest"].to_numpy(), pdf["x"].to_numpy()
        tops, vals, body = of("tops", "<i4"), of("vals", "<f4"), unit(of("v", kind))
        linked_to, label = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))
        for s in range(0, len(left), 512):
            a = left[s : s + 512]
            # The queries' windows: no vector beyond them collides here.
            low, high = np.searchsorted(at[right], [at[a[0]] - width * 1.0001, at[a[-1]] + width * 1.0001])
            b = right[low:high]
            if not len(b):
                continue
            count, first = collisions(tops[a], vals[a], tops[b], vals[b], p, width)
            found = (count >= least) & first & ~(guest[a][:, None] & guest[b])
            if i == j:
                found &= a[:, None] != b
            if not found.any():
                continue
            found &= body[a] @ body[b].T >= THRESHOLD
            linked_to[a] += found @ copies[b]
            if i != j:
                linked_to[b] += copies[a] @ found
            for row in np.flatnonzero(found.any(axis=1)).tolist():
                joined(label, int(a[row]), b[found[row]])
        some = np.flatnonzero(linked_to)
        return pd.DataFrame({"id": ids[some], "links": linked_to[some], "root": ids[label[some]]}, dtype="int64")

    found = cut(dealt.groupBy("dim", "p", "at", "i", "j").applyInPandas(links, "id long, links long, root long"))
    total = found.groupBy("id").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("root").alias("u"), F.col("id").alias("v")))
    whole = cut(classes.join(total, "id", "left").join(group, "id", "left").select("v", "copies", "links", "least", F.coalesce("component_id", "id").alias("c")))
    named = whole.join(whole.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "component_id")
    linked = rows.where("usable").join(named, "v").select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))

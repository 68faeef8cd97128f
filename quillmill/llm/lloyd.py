"""Lloyd's clustering of integer vectors with two trees: a cover tree over the vectors of each
block, built once, and a cover tree over the centroids, built every round. Pairs of nodes are
followed downwards together, and a pair goes once its distance less both radii is beyond what
the vector node is sure to reach; a vector node left with one centroid takes it for all its
vectors, and what is left at the leaves is compared exactly, in integers.

A tree takes its centres in farthest-first order. The centres farther than 2**i from all those
before them are the net of level i: nets are nested, their centres lie more than 2**i apart, and
each centre has a parent within 2**(i+1) on the level above. Vectors hang below their nearest
centre on the lowest net, about LEAF each; radii are measured to the last vector.

Spark holds the blocks as a table; a round maps them to partial sums, a row a task and cluster,
which are summed and rounded down exactly. No vector is shuffled, and none passes the driver but
the first centroids. Centroids are k x dim numbers (at most MOST_NUMBERS), whatever the table.

Defined cases: vectors of another length, or with null or non-finite components, are left out,
null vectors too; rows without vec_id are clustered but come last as first centroids; repeated
rows count each (ties among first centroids: by components); with fewer than k vectors there are
as many centroids as vectors; scaled components beyond 64 bits and distances beyond are held at
the greatest long; other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tidy, trimmed

CENTROIDS, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
#: Vectors of a block and about as many below a lowest centre.
BLOCK, LEAF = 2048, 16
#: Numbers that all centroids may have together; they go to every task.
MOST_NUMBERS = 1 << 23
#: Components up to here have squared distances that fit 64 bits (DIM of them); beyond, Python integers.
PLAIN = 1 << 27
#: Part by which bounds are widened, for rounding.
SLACK = 1e-9

# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """centres: rows of the points, in farthest-first order; a level's nodes are the first ones
    of them. up[t]: the node above, on level t - 1, of each node of level t. radius[t]: of each
    node of level t. leaf: the lowest node of each point."""

    centres: np.ndarray
    up: list[np.ndarray]
    radius: list[np.ndarray]
    leaf: np.ndarray

    @property
    def last(self) -> int:
        return len(self.up) - 1

    def above(self, t: int) -> np.ndarray:
        """The node of level t over each lowest node."""
        at = np.arange(len(self.up[-1]))
        for u in self.up[: t : -1]:
            at = u[at]
        return at


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def grow(x: np.ndarray, most: int) -> Tree:
    """The tree of points x (float64) with at most `most` centres; equal points share one."""
    n, norm = len(x), (x * x).sum(axis=1)
    pick, far, leaf = [0], [np.inf], np.zeros(n, dtype=np.int64)
    near = np.maximum(norm - 2 * (x @ x[0]) + norm[0], 0)
    while len(pick) < most:
        i = int(near.argmax())
        if near[i] <= 0 or i in pick[-1:]:
            break
        far.append(float(np.sqrt(near[i])))
        new = np.maximum(norm - 2 * (x @ x[i]) + norm[i], 0)
        new[i] = 0
        closer = new < near
        near[closer], leaf[closer] = new[closer], len(pick)
        pick.append(i)
    centres = np.array(pick)
    level = np.ceil(np.log2(np.array(far[1:]))).astype(int) - 1 if len(far) > 1 else np.zeros(0, dtype=int)
    sizes = [1, *(np.flatnonzero(np.diff(level)) + 2), len(pick)] if len(pick) > 1 else [1]
    up = [np.zeros(1, dtype=np.int64)]
    for a, b in zip(sizes[:-1], sizes[1:], strict=True):
        old, new = x[centres[:a]], x[centres[a:b]]
        gap = norm[centres[a:b], None] - 2 * (new @ old.T) + norm[None, centres[:a]]
        up.append(np.concatenate([np.arange(a), gap.argmin(axis=1)]))
    out = Tree(centres, up, [], leaf)
    for t in range(len(up)):
        node = out.above(t)[leaf]
        r = np.zeros(len(up[t]))
        np.maximum.at(r, node, gaps(x, x[centres[node]]))
        out.radius.append(r * (1 + SLACK))
    return out


def opened(pair: np.ndarray, other: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with the first node replaced by each of its children."""
    count = np.bincount(up, minlength=int(pair.max()) + 1 if len(pair) else 1)
    order, first = np.argsort(up, kind="stable"), np.cumsum(count) - count
    each = count[pair]
    at = np.repeat(first[pair] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    return order[at], np.repeat(other, each)


def descend(v: Tree, x: np.ndarray, c: Tree, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The one centroid that each lowest vector node is sure of, or -1, and for the others the
    pairs (lowest vector node, centroid) that bounds cannot tell apart, by node and centroid."""
    members = np.bincount(c.leaf, minlength=len(c.centres))
    only = np.zeros(len(c.centres), dtype=np.int64)
    only[c.leaf] = np.arange(len(y))
    sure = np.full(len(v.centres), -1)
    p, q, a, b = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), 0, 0
    reach = np.array([np.inf])
    while len(p):
        gap = gaps(x[v.centres[p]], y[c.centres[q]])
        # A node's centre is one of its points, so its centroid is within gap + radius of all vectors.
        np.minimum.at(reach, p, gap + v.radius[a][p])
        kept = gap * (1 - SLACK) - v.radius[a][p] - c.radius[b][q] <= reach[p] * (1 + SLACK) + SLACK
        p, q = p[kept], q[kept]
        if b == c.last:
            alone = (np.bincount(p, minlength=len(reach))[p] == 1) & (members[q] == 1)
            settled = np.full(len(reach), -1)
            settled[p[alone]] = only[q[alone]]
            sure = np.maximum(sure, settled[v.above(a)])
            p, q = p[~alone], q[~alone]
            if a == v.last:
                break
        if b < c.last:
            q, p = opened(q, p, c.up[b + 1])
            b += 1
        if a < v.last:
            p, q = opened(p, q, v.up[a + 1])
            reach = reach[v.up[a + 1]]
            a += 1
    of, first = np.argsort(c.leaf, kind="stable"), np.cumsum(members) - members
    each = members[q]
    at = np.repeat(first[q] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    node, centroid = np.repeat(p, each), of[at]
    order = np.lexsort((centroid, node))
    return sure, node[order], centroid[order]


def nearest(v: Tree, x: np.ndarray, exact: np.ndarray, c: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (ties: the smaller number), the sure centroid of each
    lowest node, and how many distances were compared. exact: x in integers."""
    sure, node, centroid = descend(v, x, c, centroids.astype(float))
    out = sure[v.leaf]
    open_ = np.flatnonzero(out < 0)
    if not len(open_):
        return out, sure, 0
    choices = np.bincount(node, minlength=len(sure))
    first = np.cumsum(choices) - choices
    each = choices[v.leaf[open_]]
    start = np.cumsum(each) - each
    at = np.repeat(first[v.leaf[open_]] - start, each) + np.arange(each.sum())
    far = ((exact[np.repeat(open_, each)] - centroids[centroid[at]]) ** 2).sum(axis=1)
    best = far == np.repeat(np.minimum.reduceat(far, start), each)
    hit = np.flatnonzero(best)
    row, place = np.unique(np.repeat(np.arange(len(open_)), each)[hit], return_index=True)
    out[open_[row]] = centroid[at][hit[place]]
    return out, sure, len(far)


# ---------------------------------------------------------------- blocks


def fitting(x: np.ndarray) -> np.ndarray:
    """x in the smallest integer type that holds it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return x.astype(kind)
    return x.astype(np.int64)


def blocked(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, v array<long>) as a written table of blocks with their trees."""

    def make(rows: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(rows)
        x = np.stack(pdf["v"].to_list()).astype(np.int64)
        ids = pdf["vec_id"].astype("Int64")
        known = ids.notna().to_numpy()
        tree = grow(x.astype(float), -(-len(x) // LEAF))
        order = np.argsort(tree.leaf, kind="stable")
        sums = np.add.reduceat(x[order].astype(object) if abs(x.astype(float)).max() > PLAIN else x[order], np.searchsorted(tree.leaf[order], np.arange(len(tree.centres))), axis=0)
        held = io.BytesIO()
        np.savez(held, x=fitting(x), ids=ids.fillna(0).to_numpy(dtype=np.int64), known=known, centres=tree.centres.astype(np.int32), leaf=tree.leaf.astype(np.int32), sums=fitting(sums) if sums.dtype != object else np.array(sums.astype(str)), **{f"u{t}": u.astype(np.int32) for t, u in enumerate(tree.up)}, **{f"r{t}": r for t, r in enumerate(tree.radius)})
        return pd.DataFrame({"n": [len(x)], "block": [held.getvalue()]})

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[pd.DataFrame] = []
        for pdf in batches:
            while len(pdf):
                room = BLOCK - sum(map(len, rows))
                rows.append(pdf[:room])
                pdf = pdf[room:]
                if sum(map(len, rows)) == BLOCK:
                    yield make(rows)
                    rows = []
        if rows:
            yield make(rows)

    return cut(vectors.select("vec_id", "v").mapInPandas(trimmed(build), "n long, block binary"))


def read(block: bytes) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tree, vectors, ids, whether an id is known, sums of the lowest nodes) of a block."""
    z = np.load(io.BytesIO(block))
    up = [z[f"u{t}"].astype(np.int64) for t in range(sum(k[0] == "u" for k in z.files))]
    tree = Tree(z["centres"].astype(np.int64), up, [z[f"r{t}"] for t in range(len(up))], z["leaf"].astype(np.int64))
    x, sums = z["x"].astype(np.int64), z["sums"]
    if sums.dtype.kind == "U":
        x, sums = x.astype(object), np.array([int(s) for s in sums.ravel()], dtype=object).reshape(sums.shape)
    return tree, x, z["ids"], z["known"], sums.astype(object if x.dtype == object else np.int64)


def exactly(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids in the integers in which they are compared with x."""
    small = x.dtype != object and abs(centroids.astype(float)).max() <= PLAIN
    return centroids.astype(np.int64 if small else object)


def summed(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums array<string>): partial sums of a round, a row a task and cluster."""
    tree = grow(centroids.astype(float), len(centroids))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(centroids.shape, dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for pdf in batches:
            for block in pdf["block"]:
                v, x, _, _, sums = read(block)
                to = exactly(x, centroids)
                x = x if to.dtype != object else x.astype(object)
                cluster, sure, _ = nearest(v, x.astype(float), x, tree, to)
                count += np.bincount(cluster, minlength=len(centroids))
                loose = sure[v.leaf] < 0
                for part, of in ((sums[sure >= 0], sure[sure >= 0]), (x[loose], cluster[loose])):
                    if len(of):
                        order = np.argsort(of, kind="stable")
                        own, first = np.unique(of[order], return_index=True)
                        total[own] += np.add.reduceat(part[order], first, axis=0).astype(object)
        kept = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": kept, "n": count[kept], "sums": [[str(s) for s in total[k]] for k in kept]})

    return blocks.select("block").mapInPandas(trimmed(work), "cluster int, n long, sums array<string>")


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: exact floors of their vectors' means; empty ones stay."""
    parts = summed(blocks, centroids).select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    rows = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k x dim rows
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    tree = grow(centroids.astype(float), len(centroids))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf["block"]:
                v, x, ids, known, _ = read(block)
                to = exactly(x, centroids)
                x = x if to.dtype != object else x.astype(object)
                cluster, _, _ = nearest(v, x.astype(float), x, tree, to)
                far = np.minimum(((x - to[cluster]) ** 2).sum(axis=1), (1 << 63) - 1).astype(np.int64)
                yield pd.DataFrame({"vec_id": pd.array(ids, dtype="Int64").copy(), "cluster": cluster, "distance": far}).assign(vec_id=lambda d, k=known: d["vec_id"].where(k))

    return blocks.select("block").mapInPandas(trimmed(work), "vec_id long, cluster int, distance long")


# ---------------------------------------------------------------- clustering


def whole(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of vectors(vec_id, embedding) with dim finite components, scaled and rounded down."""
    e = F.col("embedding")
    fine = (F.size(e) == dim) & F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vectors.where(e.isNotNull() & fine).select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * float(scale))).alias("v"))


def seeds(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of "seed:vec_id", in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(F.asc_nulls_last(digest), "v").limit(k).select("v").collect()  # at most MOST_NUMBERS numbers
    return np.array([[int(x) for x in r["v"]] for r in rows], dtype=object)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> tuple[DataFrame, np.ndarray]:
    """vectors(vec_id, v) as (vec_id, cluster, distance), written, and the final centroids."""
    if k * dim > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dim} components are too many to send to every task")
    centroids = seeds(vectors, k, seed)
    with tidy(vectors.sparkSession):
        blocks = blocked(vectors)
        if len(centroids):
            for _ in range(rounds):
                centroids = moved(blocks, centroids)
            return cut(assigned(blocks, centroids)), centroids
    return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found(vec_id, cluster, distance) with each cluster's inertia, that of all, and the hash
    of its centroid."""
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    most = lambda n: min(n, (1 << 63) - 1)
    total = most(sum(inertia.values()))
    digest = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    rows = [(k, most(s), total, digest[k]) for k, s in sorted(inertia.items())]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*cluster(whole(table(spark, sf_dir, "embeddings"))))

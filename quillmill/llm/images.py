"""Copies of images, also cropped or edited, by local descriptors.

1. Corners (Harris) at several scales; the strongest of an image are kept, one for each AREA
   pixels and POINTS at least.
2. Each corner's orientation is that of its patch's intensity centroid; binary intensity
   tests, turned by it, give a descriptor of BITS bits.
3. Descriptors meet by equal chunks of 32 bits: with BITS / 32 chunks, two that differ in
   fewer bits than there are chunks always share one. Closer ones than FAR bits match.
4. Matches vote for the turn, scale step and shift that maps one image on the other; a pair
   is a copy if VOTES corners agree, and SHARE of the corners of the image that has fewer: large
   images have many corners, some of which agree by chance.

Equal images with corners are one image here. In a bucket of at most SMALL descriptors all pairs
are compared. In a larger one, as of many copies, each image is first compared with one leader,
another in each of ROUNDS rounds, and only images not yet connected take part; a group of copies
so costs a few pairs an image. A last round takes every pair of every bucket whose images are not
connected by then, with all their matches, so no link that joins two components is lost: images
are dealt to groups, every two groups meet in one task, and pairs are made, counted and voted on
there, on arrays, some at a time. What is shuffled is the packed descriptors, once a pair of
groups; what leaves a task is a spanning forest of its links.

Images are binary PGM (P5). Defined cases: null, empty or unreadable bytes, and images too
small or flat for corners, link with nothing; equal images link; repeated rows share a
component, an id names one image; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, components, cut, expand, known_id, null_id, squeeze, table

BITS, FAR, POINTS, SCALES, VOTES = 128, 20, 24, 2, 4
#: Pixels for each corner kept, so that a part of a large image has corners enough of its own.
AREA = 170
SHARE = 0.25
#: Half the side of a patch; turns told apart; pixels a shift may vary within a vote.
REACH, TURNS, STEP = 7, 24, 8
SMALL, ROUNDS, PART = 12, 3, 256
#: Descriptors of a group of images; pairs of descriptors made at once, and held before they vote.
GROUP, STRIDE, HELD = 100_000, 1 << 18, 1 << 21
_TESTS = np.clip(np.random.default_rng(7).normal(0, REACH / 2.2, (BITS, 4)), -REACH, REACH)
_HEAD = re.compile(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s")


def read_pgm(b: bytes | None) -> np.ndarray | None:
    m = _HEAD.match(b or b"")
    if not m:
        return None
    w, h, most = (int(x) for x in m.groups())
    if not w or not h or most > 255 or len(b) - m.end() < w * h:
        return None
    return np.frombuffer(b, dtype=np.uint8, count=w * h, offset=m.end()).reshape(h, w)


def write_pgm(a: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)-squares of the last two axes, edges repeated."""
    p = np.pad(a, [(0, 0), (r + 1, r), (r + 1, r)], mode="edge").cumsum(1).cumsum(2)
    k = 2 * r + 1
    return p[:, k:, k:] - p[:, :-k, k:] - p[:, k:, :-k] + p[:, :-k, :-k]


def corners(images: np.ndarray) -> np.ndarray:
    """Harris response of a stack of images, local maxima only, zero near the borders."""
    a = images.astype(np.float32)
    dy, dx = np.gradient(a, axis=(1, 2))
    xx, yy, xy = box(dx * dx, 2), box(dy * dy, 2), box(dx * dy, 2)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    peak = np.ones(r.shape, dtype=bool)
    for sy in (-1, 0, 1):
        for sx in (-1, 0, 1):
            if sy or sx:
                peak &= r >= np.roll(r, (sy, sx), (1, 2))
    edge = REACH + 1
    out = np.zeros_like(r)
    inner = (slice(None), slice(edge, -edge), slice(edge, -edge))
    out[inner] = np.where(peak & (r > 1e4), r, 0)[inner]
    return out


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(image, x, y, turn, scale) and packed descriptors of a stack of equal-sized images; x
    and y in pixels of the image itself."""
    found, bits = [], []
    level = images.astype(np.float32)
    most = max(POINTS, level.shape[1] * level.shape[2] // AREA)
    for s in range(SCALES):
        if min(level.shape[1:]) < 2 * REACH + 6:
            break
        quota = most * 2 // 3 if s == 0 else most // 3
        r = corners(level).reshape(len(level), -1)
        quota = min(quota, r.shape[1])
        top = np.argpartition(-r, quota - 1, axis=1)[:, :quota]
        image, k = np.nonzero(np.take_along_axis(r, top, axis=1) > 0)
        at = top[image, k]
        y, x = np.divmod(at, level.shape[2])
        span = np.arange(-REACH, REACH + 1)
        patch = level[image[:, None, None], y[:, None, None] + span[:, None], x[:, None, None] + span]
        angle = np.arctan2((patch * span[:, None]).sum((1, 2)), (patch * span).sum((1, 2)))
        turn = np.round(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        c, sn = np.cos(2 * np.pi * np.arange(TURNS) / TURNS), np.sin(2 * np.pi * np.arange(TURNS) / TURNS)
        turned = lambda px, py: (np.clip(np.rint(c[:, None] * px - sn[:, None] * py), -REACH, REACH).astype(int), np.clip(np.rint(sn[:, None] * px + c[:, None] * py), -REACH, REACH).astype(int))
        ax, ay = turned(_TESTS[:, 0], _TESTS[:, 1])
        bx, by = turned(_TESTS[:, 2], _TESTS[:, 3])
        smooth = box(level, 1)
        value = lambda ox, oy: smooth[image[:, None], y[:, None] + oy[turn], x[:, None] + ox[turn]]
        bits.append(np.packbits(value(ax, ay) < value(bx, by), axis=1))
        found.append(np.stack([image, x << s, y << s, turn, np.full(len(x), s)], axis=1))
        h, w = level.shape[1] // 2 * 2, level.shape[2] // 2 * 2
        level = (level[:, :h:2, :w:2] + level[:, 1:h:2, :w:2] + level[:, :h:2, 1:w:2] + level[:, 1:h:2, 1:w:2]) / 4
    if not found:
        return np.zeros((0, 5), dtype=int), np.zeros((0, BITS // 8), dtype=np.uint8)
    return np.concatenate(found), np.concatenate(bits)


def descriptors(images: DataFrame) -> DataFrame:
    """(id, x, y, turn, scale, of, d) of images(id, image); of: the image's corners."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            by_size: dict[tuple, list] = {}
            for i, b in zip(pdf["id"].tolist(), pdf["image"], strict=True):
                a = read_pgm(b)
                if a is not None:
                    by_size.setdefault(a.shape, []).append((i, a))
            for rows in by_size.values():
                for k in range(0, len(rows), 128):
                    part = rows[k : k + 128]
                    points, bits = describe(np.stack([a for _, a in part]))
                    ids = np.array([i for i, _ in part], dtype=np.int64)
                    yield pd.DataFrame({"id": ids[points[:, 0]], "x": points[:, 1], "y": points[:, 2], "turn": points[:, 3], "scale": points[:, 4], "of": np.bincount(points[:, 0], minlength=len(part))[points[:, 0]], "d": [r.tobytes() for r in bits]})

    return images.mapInPandas(extract, "id long, x int, y int, turn int, scale int, of int, d binary")


def copies(pairs: DataFrame) -> DataFrame:
    """(u, v) of pairs of images that enough matches map on each other in one way; pairs has
    the two descriptors of each match."""
    near = F.lit(0)
    for k in range(BITS // 32):
        near = near + F.bit_count(F.col(f"a.c{k}").bitwiseXOR(F.col(f"b.c{k}")))
    rows = pairs.where(near <= FAR).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.least("a.of", "b.of").alias("of"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("x", "y", "turn", "scale")])
    rows = rows.repartition("u", "v").distinct()  # all that follows stays with a pair: matches are shuffled once
    spin = F.pmod(F.col("turn_b") - F.col("turn_a"), F.lit(TURNS))
    angle = spin * F.lit(2 * np.pi / TURNS)
    zoom = F.pow(F.lit(2.0), F.col("scale_b") - F.col("scale_a"))
    tx = F.col("x_b") - zoom * (F.cos(angle) * F.col("x_a") - F.sin(angle) * F.col("y_a"))
    ty = F.col("y_b") - zoom * (F.sin(angle) * F.col("x_a") + F.cos(angle) * F.col("y_a"))
    # A vote goes to both bins of two shifted grids in each direction, so none is cut by a border.
    votes = rows.select("u", "v", "of", "x_a", "y_a", "scale_a", spin.alias("spin"), (F.col("scale_b") - F.col("scale_a")).alias("zoom"), F.explode(F.array(*[F.struct(F.lit(sx * 2 + sy).alias("grid"), F.floor(tx / (2 * STEP) + sx / 2).alias("x"), F.floor(ty / (2 * STEP) + sy / 2).alias("y")) for sx in (0, 1) for sy in (0, 1)])).alias("bin"))
    votes = votes.groupBy("u", "v", "of", "spin", "zoom", "bin").agg(F.count_distinct("x_a", "y_a", "scale_a").alias("n"))
    return votes.where((F.col("n") >= VOTES) & (F.col("n") >= F.col("of") * SHARE)).select("u", "v").distinct()


def apart(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b), a of the smaller id, of all pairs of a bucket of listed(key, p) that found(id,
    component_id) does not connect: a row a pair. `crossing` finds the links among these without
    such rows; tests hold it against them."""
    now = listed.join(found, F.col("p.id") == F.col("id"), "left").select("key", "p", F.coalesce("component_id", "p.id").alias("c"))
    several = now.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    parts = F.ceil(F.col("n") / PART).cast("int")
    own = F.pmod(F.xxhash64("p"), F.col("parts")).cast("int")
    rows = now.join(several.select("key", parts.alias("parts")), "key").withColumn("own", own)
    cell = lambda i, j, name: rows.select("key", i.alias("i"), j.alias("j"), F.col("p").alias(name), F.col("c").alias(f"c{name}"))
    left = cell(F.col("own"), F.explode(F.sequence("own", F.col("parts") - 1)), "a")
    right = cell(F.explode(F.sequence(F.lit(0), F.col("own"))), F.col("own"), "b")
    met = left.join(right.hint("merge"), ["key", "i", "j"]).where("ca <> cb and (i < j or a.id < b.id)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


_FIELDS = ["id", "c", "x", "y", "turn", "scale", "of", *[f"c{k}" for k in range(BITS // 32)]]


def words_of(points: dict[str, np.ndarray]) -> np.ndarray:
    """A row a descriptor, of 64-bit words that hold two chunks each."""
    c = [points[f"c{k}"].astype(np.uint64) for k in range(BITS // 32)]
    return np.stack([c[k] << np.uint64(32) | c[k + 1] for k in range(0, len(c), 2)])


def joint(columns: list[np.ndarray]) -> np.ndarray:
    """One number for each combination of columns of whole numbers, in their order."""
    key, size = np.zeros(len(columns[0]), dtype=np.int64), 1
    for c in columns:
        low = c.min()
        width = int(c.max() - low) + 1
        if size * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            size = int(key.max()) + 1
        key, size = key * width + (c - low).astype(np.int64), size * width
    return key


def least_votes(of: np.ndarray) -> np.ndarray:
    return np.maximum(VOTES, np.ceil(SHARE * of)).astype(np.int64)


def voted(u: dict[str, np.ndarray], v: dict[str, np.ndarray], pair: np.ndarray) -> np.ndarray:
    """Those of pair, a number for each match of a descriptor of u with one of v, that `copies`
    would take; u has the smaller id."""
    spin, zoom = (v["turn"] - u["turn"]) % TURNS, v["scale"] - u["scale"]
    angle, scale = spin * (2 * np.pi / TURNS), np.exp2(zoom)
    tx = v["x"] - scale * (np.cos(angle) * u["x"] - np.sin(angle) * u["y"])
    ty = v["y"] - scale * (np.sin(angle) * u["x"] + np.cos(angle) * u["y"])
    least, point = least_votes(np.minimum(u["of"], v["of"])), joint([u["x"], u["y"], u["scale"]])
    taken = [pair[:0]]
    for sx in (0, 1):
        for sy in (0, 1):
            place = joint([pair, spin, zoom, np.floor(tx / (2 * STEP) + sx / 2), np.floor(ty / (2 * STEP) + sy / 2)])
            each = joint([place, point])
            order = np.argsort(each)
            first = np.flatnonzero(np.diff(place[order], prepend=-1))
            n = np.add.reduceat((np.diff(each[order], prepend=-1) != 0).astype(np.int64), first)
            order = order[first]
            taken.append(pair[order][n >= least[order]])
    return np.unique(np.concatenate(taken))


def links(a: dict[str, np.ndarray], b: dict[str, np.ndarray], own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v), u < v, of images of a and b that are of different components and copies; own: a and
    b are the same, so each pair is taken from one side. Descriptors of b are sorted by chunk and
    component, so those of an image's own component are never met. The matches of two images are
    counted first, and only those that are enough vote."""
    order = np.argsort(a["id"], kind="stable")
    a = {k: x[order] for k, x in a.items()}
    names_a, image_a = np.unique(a["id"], return_inverse=True)
    names_b, image_b = np.unique(b["id"], return_inverse=True)
    parts = np.unique(np.concatenate([a["c"], b["c"]]))
    ca, cb = (np.searchsorted(parts, x["c"]).astype(np.uint64) for x in (a, b))
    wa, wb = words_of(a), words_of(b)
    spans = []
    for k in range(BITS // 32):
        key = b[f"c{k}"].astype(np.uint64) << np.uint64(32) | cb
        place = np.argsort(key)
        key, value = key[place], a[f"c{k}"].astype(np.uint64) << np.uint64(32)
        sorted_b = place.astype(np.int32), wb[:, place]
        after = np.searchsorted(key, value | ca, "right")
        spans.append((k, after, np.searchsorted(key, value | np.uint64(0xFFFFFFFF), "right") - after, *sorted_b))
        if not own:
            start = np.searchsorted(key, value)
            spans.append((k, start, np.searchsorted(key, value | ca) - start, *sorted_b))
    edge = np.searchsorted(image_a, np.arange(len(names_a) + 1))
    upto = np.concatenate([[0], np.cumsum(sum(s[2] for s in spans))])[edge]
    least_a, least_b = np.zeros(len(names_a), dtype=np.int64), np.zeros(len(names_b), dtype=np.int64)
    least_a[image_a], least_b[image_b] = least_votes(a["of"]), least_votes(b["of"])
    i = 0
    while i < len(names_a):
        e = int(np.searchsorted(upto, upto[i] + HELD, "right")) - 1
        e = min(max(e, i + 1), i + max(1, HELD // len(names_b)), len(names_a))
        found = list(matches(spans, wa, int(edge[i]), int(edge[e])))
        pa, pb = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int32) for k in (0, 1))
        pair = (image_a[pa] - i) * len(names_b) + image_b[pb]
        count = np.bincount(pair, minlength=(e - i) * len(names_b)).reshape(e - i, -1)
        enough = (count >= VOTES) & (count >= np.minimum(least_a[i:e, None], least_b))
        many = np.flatnonzero(enough.reshape(-1)[pair])
        if len(many):
            pa, pb, pair = pa[many], pb[many], pair[many]
            swap = a["id"][pa] > b["id"][pb]
            u, v = ({f: np.where(swap == s, a[f][pa], b[f][pb]) for f in ("x", "y", "turn", "scale", "of")} for s in (False, True))
            x, y = np.divmod(voted(u, v, pair), len(names_b))
            yield np.minimum(names_a[x + i], names_b[y]), np.maximum(names_a[x + i], names_b[y])
        i = e


def matches(spans: list[tuple], wa: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(descriptor of a, descriptor of b) of those from lo to hi that are near the ones they share a
    chunk with, each match once."""
    for k, start, count, place, wb in spans:
        n = count[lo:hi]
        upto = np.concatenate([[0], np.cumsum(n)])
        p = 0
        while p < hi - lo:
            q = max(int(np.searchsorted(upto, upto[p] + STRIDE, "right")) - 1, p + 1)
            of = np.repeat(np.arange(lo + p, lo + q, dtype=np.int32), n[p:q])
            at = np.arange(upto[q] - upto[p]) + np.repeat(start[lo + p : lo + q] - upto[p:q] + upto[p], n[p:q])
            differ = [wa[w][of] ^ wb[w][at] for w in range(len(wa))]
            near = np.flatnonzero(sum(np.bitwise_count(d) for d in differ) <= FAR)
            for earlier in range(k):  # a chunk before has the match already
                half = differ[earlier // 2][near]
                near = near[(half & np.uint64(0xFFFFFFFF) if earlier % 2 else half >> np.uint64(32)) != 0]
            yield of[near], place[at[near]]
            p = q


def crossing(points: DataFrame, found: DataFrame) -> DataFrame:
    """(u, v), a spanning forest a task of the links between images of points that found(id,
    component_id) does not connect."""
    groups = max(1, -(-points.count() // GROUP))
    now = points.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id"))
    now = now.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g"), *[F.col(f).cast("long") for f in _FIELDS])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(g, squeeze(part[_FIELDS].to_numpy().T.reshape(-1))) for g, part in pdf.groupby("g")]
            yield pd.DataFrame(rows, columns=["g", "points"])

    def unpack(packs: pd.Series) -> dict[str, np.ndarray]:
        rows = np.concatenate([expand(b, np.int64).reshape(len(_FIELDS), -1) for b in packs], axis=1)
        return dict(zip(_FIELDS, rows, strict=True))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        forest, sides = Forest(), [pdf["points"][pdf["g"] == g] for g in (i, j)]
        if all(map(len, sides)):
            a = unpack(sides[0])
            for us, vs in links(a, a if i == j else unpack(sides[1]), i == j):
                for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                    forest.join(u, v)
        nodes, roots = forest.pairs()
        return pd.DataFrame({"u": roots, "v": nodes}, dtype="int64")

    packs = now.repartition("g").mapInPandas(pack, "g int, points binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    cells = packs.select("g", "points", other.alias("o")).select(F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), "g", "points")
    return cells.repartition(groups * (groups + 1) // 2, "i", "j").groupBy("i", "j").applyInPandas(meet, "u long, v long")


def classes(images: DataFrame) -> DataFrame:
    """(id, n_points, component_id) of every row of images(id, image)."""
    images = cut(images.select(known_id("id").alias("id"), F.sha2("image", 256).alias("same"), "image"))
    first = images.groupBy(F.coalesce("same", F.col("id").cast("string")).alias("same")).agg(F.min("id").alias("first"), F.min_by("image", "id").alias("image"))
    of = linked(first.select(F.col("first").alias("id"), "image")).select(F.col("id").alias("first"), "n_points", "component_id").dropDuplicates(["first"])
    named = images.select("id", F.coalesce("same", F.col("id").cast("string")).alias("same")).join(first.select("same", "first"), "same").join(of, "first")
    out = named.select("id", "n_points", F.when(F.col("n_points") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.select(null_id(F.col("id")).alias("id"), "n_points", null_id(F.col("component_id")).alias("component_id"))


def linked(images: DataFrame) -> DataFrame:
    """classes for different images, with ids that are known."""
    chunk = [F.conv(F.hex(F.substring("d", 4 * k + 1, 4)), 16, 10).cast("long").alias(f"c{k}") for k in range(BITS // 32)]
    points = cut(descriptors(images).select("id", "x", "y", "turn", "scale", "of", *chunk))
    point = F.struct("id", "x", "y", "turn", "scale", "of", *[f"c{k}" for k in range(BITS // 32)])
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("chunk"), F.col(f"c{k}").alias("value")) for k in range(BITS // 32)]))
    listed = points.select(keys.alias("key"), point.alias("p"))
    shared = listed.groupBy("key").agg(F.min("p.id").alias("lo"), F.max("p.id").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    listed = cut(listed.join(shared.select("key", "n"), "key"))
    few = listed.where(f"n <= {SMALL}")
    pairs = few.select("key", F.col("p").alias("a")).join(few.select("key", F.col("p").alias("b")), "key").where("a.id < b.id")
    edges = cut(copies(pairs))
    many = listed.where(f"n > {SMALL}").select("key", "p")
    found = components(edges)
    for k in range(ROUNDS):
        now = many.join(found, F.col("p.id") == F.col("id"), "left").withColumn("c", F.coalesce("component_id", "p.id")).select("key", "p", "c")
        lead = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("p.id", F.lit(k)).alias("h"), "p", "c")).alias("l"))
        met = now.join(lead.select("key", F.col("l.p").alias("a"), F.col("l.c").alias("ca")), "key").where("ca <> c").select("a", F.col("p").alias("b"))
        edges = cut(edges.union(copies(met)).distinct())
        found = components(edges)
    edges = cut(edges.union(crossing(points, found)).distinct())
    found = components(edges)
    count = points.groupBy("id").agg(F.count("*").alias("n_points"))
    out = images.select("id").join(count, "id", "left").join(found, "id", "left")
    return out.select("id", F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"), F.coalesce("component_id", "id").alias("component_id"))


# ---------------------------------------------------------------- the query's images

SIDE = 64


def shapes() -> np.ndarray:
    """64 fixed patterns of rectangles; an image is their sum, weighted by a row's vector."""
    r = np.random.default_rng(11)
    out = np.zeros((64, SIDE, SIDE))
    for k in range(64):
        for _ in range(3):
            x, y = r.integers(0, SIDE - 8, 2)
            w, h = r.integers(6, 24, 2)
            out[k, y : y + h, x : x + w] += r.choice([-1.0, 1.0])
    return out.reshape(64, -1)


def render(vectors: DataFrame) -> DataFrame:
    """(id, image): a picture of each row of vectors(vec_id, embedding). The tables hold no
    images, so the query draws one from each embedding; near vectors give edited copies."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = shapes()
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                x = np.zeros((len(part), 64))
                for i, v in enumerate(part["embedding"]):
                    v = np.array([np.nan if c is None else c for c in (v if v is not None else [])], dtype=float)[:64]
                    if v.size and np.isfinite(v).all() and np.abs(v).max() > 0:
                        x[i, : v.size] = v / np.abs(v).max()
                a = x @ base
                a = np.clip(128 + a * (90 / np.maximum(a.std(axis=1, keepdims=True), 1e-9)) * 0.6, 0, 255).reshape(-1, SIDE, SIDE)
                yield pd.DataFrame({"id": part["vec_id"].to_numpy(), "image": [write_pgm(r) for r in a]})

    return vectors.select(known_id("vec_id").alias("vec_id"), "embedding").mapInPandas(draw, "id long, image binary").withColumn("id", null_id(F.col("id")))


def op1_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    pictures = cut(render(table(spark, sf_dir, "embeddings")))
    out = classes(pictures)
    return out.select(F.col("id").alias("vec_id"), "n_points", "component_id")

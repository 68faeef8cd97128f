"""Shared pieces of the training-data operators: table access, lineage cuts,
byte hashing, compact blocks of sorted hashes, and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
#: Odd multiplier of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text hashed at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19


#: Rows and bytes handed to Python at once; texts are long, and Spark's defaults hold too many.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def prepare(spark: SparkSession) -> None:
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        size = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if size and int(size[1]) > most:
            spark.conf.set(key, str(most))


#: Stands for a null id inside the operators, after all others.
NO_ID = 1 << 62


def known_id(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(NO_ID))


def null_id(c: Column) -> Column:
    return F.when(c != NO_ID, c)


def packed(docs: DataFrame, *also: Column) -> DataFrame:
    """docs as one column `row`, with the columns that an operator needs beside it: columns of
    docs then clash with none of its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *also)


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of docs from rows(row, ...), those in new replaced."""
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a run on one machine
    gets a temporary one; on a cluster that would lose data, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        if option.isDefined():
            return option.get()
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/quillmill-checkpoint"
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def folder(spark: SparkSession, name: str = "quillmill") -> str:
    """A new path under the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextmanager
def settings(spark: SparkSession, changed: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tidy(spark: SparkSession) -> AbstractContextManager:
    """Queries made and run within remove their shuffle files when they end."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: later stages
    start from files that outlive any executor."""
    spark = df.sparkSession
    path = folder(spark)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bloom_joins(spark: SparkSession) -> AbstractContextManager:
    """Let Spark drop rows that cannot join before it shuffles a scanned table: its own
    Bloom filters, of bounded size, also on tables under its usual threshold."""
    return settings(spark, {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"})


def give_back() -> None:
    """Hand memory that is done with back to the system: workers stay for later stages, and
    what they once held would count against the executor."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(f: Callable) -> Callable:
    """A function of batches that gives memory back at the end of its partition."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from f(batches)
        give_back()

    return wrapped


def trimmed_group(f: Callable) -> Callable:
    """A function of a key and its rows that gives memory back after each group."""

    def wrapped(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(key, pdf)
        give_back()
        return out

    return wrapped


def partitions(spark: SparkSession) -> int:
    prepare(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 16 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


class PrefixHash:
    """Polynomial prefix hashes of a byte array: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * powers(BASE, n), out=self.prefix[1:])
        self.inverse = powers(BASE_INV, n + 1)

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.inverse[start]

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], well mixed; the length takes part."""
        return mix(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most limit bytes, or of one text."""
    first, size = 0, 0
    for i, x in enumerate(texts):
        if i > first and size + len(x) > limit:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes other than 0x20 and 0x09-0x0D) of all
    texts in order, A-Z lower-cased, and the number of words of each text."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    hashes = PrefixHash(data).span(start, end)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), dtype=np.int64, count=len(texts)))
    count = np.diff(np.searchsorted(start, ends, side="left"), prepend=0)
    return hashes, count


_C = zstandard.ZstdCompressor(level=1)
_D = zstandard.ZstdDecompressor()


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes; an empty array as no bytes."""
    if not len(a):
        return b""
    width = a.dtype.itemsize
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T)
    keep = [p for p in range(width) if planes[p].any()]
    head = bytes([width, sum(1 << p for p in keep)])
    return head + len(a).to_bytes(4, "little") + _C.compress(planes[keep].tobytes())


def expand(b: bytes, dtype: type) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype=dtype)
    width, kept, n = b[0], b[1], int.from_bytes(b[2:6], "little")
    planes = np.zeros((width, n), dtype=np.uint8)
    if kept:
        raw = np.frombuffer(_D.decompress(b[6:]), dtype=np.uint8).reshape(-1, n)
        planes[[p for p in range(width) if kept >> p & 1]] = raw
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, np.uint64), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 by range of the hash, so that sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class Forest:
    """Union-find over 64-bit ids, smallest id as root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, x: int, y: int) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True

    def pairs(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.up if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace a partition's edges by a spanning forest of stars (u < v)."""
    forest = Forest()
    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            if u != v:
                forest.join(u, v)
    nodes, roots = forest.pairs()
    for i in range(0, len(nodes), 100_000):
        yield pd.DataFrame({"u": roots[i : i + 100_000], "v": nodes[i : i + 100_000]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each node: edges(u, v) -> (id, component_id).

    Alternates large-star and small-star steps (each joins a node's neighbours to
    their least) until nothing changes. A partition's edges are first replaced by a
    spanning forest, so a clique costs one row a member. No edges: no rows."""
    e = cut(edges.select("u", "v").where("u <> v").mapInPandas(contract, "u long, v long").distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("u"), F.explode(F.array("a", "b")).alias("v"))
        new = cut(small.where("u <> v").distinct())
        if not new.exceptAll(e).limit(1).count():
            return new.select(F.col("v").alias("id"), F.col("u").alias("component_id"))
        e = new


def utf8(texts: pd.Series) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else b"" for x in texts]

"""Content-addressed store of token-id streams.

Layout under one folder, all Parquet, all written and read by Spark:

* chunks(digest, width, ids): each distinct chunk once, ids little-endian in 2 or 4 bytes;
* recipes(part, seq, doc_id, n_tokens, digests): documents in ascending doc_id order, part by
  part; seq is a document's place in this order;
* manifest(part, n_docs, root): the Merkle root over a part's recipes, and in part -1 the root
  over the parts' roots.

A rolling hash over the last ids decides where a stream is cut, so equal passages give
equal chunks wherever they stand. Reading checks every chunk against its digest and
every part against its root, and fails on a mismatch. `read` gives places, lengths and checksums
without moving a chunk; `rebuild` gives the ids themselves.

Defined cases: a null or empty text is a document of the end id alone; rows with the same
doc_id, or without one (after all others), are kept, ordered among themselves by their recipe; extra input columns are ignored;
an empty table gives an empty store."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, folder, known_id, null_id, partitions, table, trimmed
from .encoding import encoded

#: Ids under the rolling window, the mean length of a chunk, and its bounds.
WINDOW, MEAN, LEAST, MOST = 5, 512, 128, 4096
FACTOR, THRESHOLD = np.uint64(BASE), np.uint64((1 << 64) // MEAN)
VOCABULARY = "word_bpe_49k.json"
END_ID = 1


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    value = ids.astype(np.uint64) * FACTOR
    value ^= value >> np.uint64(29)
    rolled = value.copy()
    for k in range(1, WINDOW):
        rolled[k:] += value[:-k] * np.uint64(2 * k + 3)
    rolled *= FACTOR
    marks = np.flatnonzero(rolled < THRESHOLD) + 1
    ends, last, at = [], 0, 0
    while n - last > LEAST:
        at = int(np.searchsorted(marks, last + LEAST))
        end = int(marks[at]) if at < len(marks) else n
        end = min(end, last + MOST, n)
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


def payload(ids: np.ndarray) -> tuple[int, bytes]:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def digest(width: int, body: bytes) -> bytes:
    return hashlib.blake2b(bytes([width]) + body, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def leaf(doc_id: int, n: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(repr((doc_id, n)).encode() + b"".join(digests)).digest()


def combine_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation, from (crc, length in bytes) of its parts."""
    total = 0
    for crc, size in parts:
        total = _shift(total, size) ^ crc
    return total


_ZEROS: dict[int, list[int]] = {}


def _apply(m: list[int], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


def _shift(crc: int, size: int) -> int:
    """crc after size zero bytes, without the CRC's own conditioning."""
    if size not in _ZEROS:
        step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
        for _ in range(3):
            step = [_apply(step, x) for x in step]
        out, n = [1 << i for i in range(32)], size
        while n:
            if n & 1:
                out = [_apply(step, x) for x in out]
            step = [_apply(step, x) for x in step]
            n >>= 1
        if len(_ZEROS) > 20_000:
            _ZEROS.clear()
        _ZEROS[size] = out
    return _apply(_ZEROS[size], crc)


def write(docs: DataFrame, root: str, path: str, end_id: int = END_ID, spaced: bool = False) -> None:
    """Encode docs(doc_id, text) with the vocabulary at path and write the store at root."""

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc_ids = pdf["doc_id"].tolist()
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            rows: list[tuple] = []
            size, sent = 0, set()
            for i, ids in encoded(texts, path, spaced):
                ids = np.append(ids, np.uint32(end_id))
                recipe, last = [], 0
                for end in cuts(ids):
                    width, body = payload(ids[last:end])
                    key = digest(width, body)
                    recipe.append(key)
                    if key not in sent:
                        sent.add(key)
                        rows.append((key, width, body, None, None, None))
                        size += len(body)
                    last = end
                rows.append((None, None, None, doc_ids[i], len(ids), recipe))
                if size > 4 << 20:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    columns = ["digest", "width", "ids", "doc_id", "n_tokens", "digests"]
    schema = "digest binary, width int, ids binary, doc_id long, n_tokens long, digests array<binary>"
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    # Chunks meet by digest; recipes are spread by document, and both leave in one shuffle.
    both = docs.select(known_id("doc_id").alias("doc_id"), "text").mapInPandas(trimmed(chunked), schema)
    both = both.repartition(n, F.when(F.col("digest").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("digest"))).sortWithinPartitions("digest")

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in batches:
            keep = []
            for key in pdf["digest"]:
                keep.append(key is None or key != last)
                last = key if key is not None else last
            yield pdf[keep]

    both.mapInPandas(once, schema).withColumn("kind", F.when(F.col("digest").isNull(), "recipe").otherwise("chunk")).write.option("compression", "zstd").partitionBy("kind").parquet(f"{root}/raw")
    raw = spark.read.schema(f"{schema}, kind string").parquet(f"{root}/raw")
    ordered = raw.where("kind = 'recipe'").select("doc_id", "n_tokens", "digests")
    ordered = ordered.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "digests")
    ordered.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "doc_id", "n_tokens", "digests").write.option("compression", "zstd").parquet(f"{root}/recipes")
    whole(roots(spark, root)).coalesce(1).write.parquet(f"{root}/manifest")


def recipes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("part int, seq long, doc_id long, n_tokens long, digests array<binary>").parquet(f"{root}/recipes")


def chunks(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.schema("digest binary, width int, ids binary, kind string").parquet(f"{root}/raw")
    return raw.where("kind = 'chunk'").select("digest", "width", "ids")


def roots(spark: SparkSession, root: str) -> DataFrame:
    """Merkle root of each part as its files stand now: no task holds more than a part's hashes,
    a leaf of 32 bytes a document."""

    def part_root(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "n_docs": [len(pdf)], "root": [merkle(pdf.sort_values("seq")["leaf"].tolist())]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [leaf(d, n, list(x)) for d, n, x in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), pdf["digests"], strict=True)]
            yield pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "leaf": made})

    made = recipes(spark, root).mapInPandas(leaves, "part int, seq long, leaf binary")
    return made.groupBy("part").applyInPandas(part_root, "part int, n_docs long, root binary")


def whole(parts: DataFrame) -> DataFrame:
    """parts(part, n_docs, root), a row a part, with the root over them as part -1."""
    rows = parts.orderBy("part").collect()
    top = (-1, sum(r["n_docs"] for r in rows), bytearray(merkle([bytes(r["root"]) for r in rows])))
    return parts.sparkSession.createDataFrame([top, *[(r["part"], r["n_docs"], r["root"]) for r in rows]], "part int, n_docs long, root binary")


def verify(spark: SparkSession, root: str) -> None:
    """Fail unless the recipes give the roots of the manifest."""
    wrong = whole(roots(spark, root)).alias("a").join(spark.read.parquet(f"{root}/manifest").alias("b"), "part", "full")
    if wrong.where("not (a.root <=> b.root) or not (a.n_docs <=> b.n_docs)").limit(1).count():
        raise ValueError("recipes do not match the manifest")


def rebuild(spark: SparkSession, root: str) -> DataFrame:
    """(seq, doc_id, n_tokens, ids) of a store's documents, checked: ids as little-endian
    unsigned 32-bit integers, put together from the chunks that the recipe names."""
    verify(spark, root)
    steps = recipes(spark, root).select("seq", "doc_id", "n_tokens", F.posexplode("digests").alias("k", "digest"))
    joined = steps.join(chunks(spark, root), "digest", "left")
    docs = joined.groupBy("seq", "doc_id", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("k", "digest", "width", "ids"))).alias("steps"))

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for want, steps in zip(pdf["n_tokens"].tolist(), pdf["steps"], strict=True):
                if any(x["ids"] is None or digest(x["width"], bytes(x["ids"])) != bytes(x["digest"]) for x in steps):
                    raise ValueError("a chunk of the store does not match its digest")
                out.append(b"".join(np.frombuffer(x["ids"], dtype=f"<u{x['width']}").astype("<u4").tobytes() for x in steps))
                if len(out[-1]) != 4 * want:
                    raise ValueError("a document cannot be rebuilt from its recipe")
            yield pdf[["seq", "doc_id", "n_tokens"]].assign(ids=out)

    made = docs.mapInPandas(trimmed(put_together), "seq long, doc_id long, n_tokens long, ids binary")
    return made.withColumn("doc_id", null_id(F.col("doc_id")))


def read(spark: SparkSession, root: str) -> DataFrame:
    """Documents of a store, checked: (doc_id, start, n_tokens, ids_crc32).

    Each chunk is hashed where it lies; only its length and CRC travel to the recipes."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, crc = [], []
            for key, width, body in zip(pdf["digest"], pdf["width"].tolist(), pdf["ids"], strict=True):
                if digest(width, body) != bytes(key):
                    raise ValueError("a chunk of the store does not match its digest")
                ids = np.frombuffer(body, dtype=f"<u{width}").astype("<u4")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.tobytes()))
            yield pd.DataFrame({"digest": pdf["digest"], "n": n, "crc": crc})

    verify(spark, root)
    sums = chunks(spark, root).mapInPandas(trimmed(summed), "digest binary, n long, crc long")
    steps = recipes(spark, root).select("part", "doc_id", "n_tokens", F.col("seq").alias("row"), F.posexplode("digests").alias("seq", "digest"))
    joined = steps.join(sums, "digest", "left")
    docs = joined.groupBy("part", "doc_id", "row").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", F.coalesce("n", F.lit(-1)).alias("n"), "crc"))).alias("steps"))

    def rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            crc = []
            for want, steps in zip(pdf["n_tokens"].tolist(), pdf["steps"], strict=True):
                if sum(s["n"] for s in steps) != want or any(s["n"] < 0 for s in steps):
                    raise ValueError("a document cannot be rebuilt from its recipe")
                crc.append(combine_crc([(s["crc"], 4 * s["n"]) for s in steps]))
            yield pd.DataFrame({"part": pdf["part"], "doc_id": pdf["doc_id"], "row": pdf["row"], "n_tokens": pdf["n_tokens"], "ids_crc32": crc})

    rows = docs.mapInPandas(rebuilt, "part int, doc_id long, row long, n_tokens long, ids_crc32 long")
    before = recipes(spark, root).groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a part
    offsets, total = {}, 0
    for r in before:
        offsets[r["part"]] = total
        total += r["n"]
    base = spark.createDataFrame(list(offsets.items()) or [(0, 0)], "part int, base long")
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(base), "part")
    return out.select(null_id(F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "store")
    write(table(spark, sf_dir, "documents"), root, public_tokenizers.path(VOCABULARY))
    return read(spark, root)

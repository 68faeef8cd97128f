"""Packing of token streams into fixed windows by minimum bin slack.

A document longer than the window gives whole windows and one remainder. Remainders are
packed by their lengths alone: a histogram of at most `window` counts reaches the driver,
where a bitset subset-sum programme picks, around the longest length left, the multiset that
fills a window best; backtracking gives its counts, and the choice is repeated while the
counts last. Pieces then find their place by their rank within their length.

Defined cases: a null or empty text is its end id alone; rows with the same doc_id are packed
each on its own; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, known_id, null_id, prepare, table, trimmed
from .encoding import encoded

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 1024
END_ID = 0
#: Characters encoded at once.
BLOCK = 1 << 20
#: Parts of a length whose ranks are counted apart.
SALTS = 32


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths within counts whose sum is nearest to capacity from below."""
    reach, trail = 1, []
    full = (1 << capacity + 1) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length], capacity // length)
        if not most:
            continue
        trail.append((length, most, reach))
        left, step = most, 1
        while left:  # binary split of the copies
            step = min(step, left)
            reach |= reach << step * length & full
            left -= step
            step *= 2
        if reach >> capacity & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, most, before in reversed(trail):
        for k in range(most + 1):
            rest = at - k * length
            if rest >= 0 and before >> rest & 1:
                if k:
                    out[length] = k
                at = rest
                break
    return out


def patterns(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a window with their counts, how many such windows) until nothing is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        fill = best_fill({k: v for k, v in left.items() if v and k <= window - longest}, window - longest)
        left[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[k] // v for k, v in fill.items())
        out.append((fill, times))
        for k, v in fill.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a window, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for fill, times in plan:
        offset = 0
        for length in sorted(fill, reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), sequence, fill[length], offset))
            used[length] = used.get(length, 0) + fill[length] * times
            offset += length * fill[length]
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, path: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc_ids = pdf["doc_id"].tolist()
            rows: list[tuple] = []
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            for i, ids in encoded(texts, path, True, BLOCK):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for s in range(0, len(ids), window):
                    body = ids[s : s + window].tobytes()
                    rows.append((doc_ids[i], s, len(body) // 4, zlib.crc32(body), len(ids), *([body] if keep_ids else [])))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return docs.select(known_id("doc_id").alias("doc_id"), "text").mapInPandas(trimmed(cut_up), schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): its document's part, its sequence and the
    offset there; with keep_ids also the ids, little-endian in 4 bytes."""
    prepare(docs.sparkSession)
    made = cut(pieces(docs, path, window, end_id, keep_ids).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))))
    # Counts by length and salt: at most window * SALTS rows; they rank a hot length without gathering it.
    sizes = made.groupBy("length", "salt").count()
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(sizes.withColumn("base", F.coalesce(F.sum("count").over(earlier), F.lit(0))))
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most window rows
    places = slots(patterns(counts, window))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = made.withColumn("within", F.row_number().over(inside) - 1)
    ranked = ranked.join(base.select("length", "salt", "base"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
            for x in np.unique(length):
                own, rows = length == x, places[int(x)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                k = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + k // row[:, 2]
                offset[own] = row[:, 3] + k % row[:, 2] * x
            yield pdf.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInPandas(placed, schema).withColumn("doc_id", null_id(F.col("doc_id")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))

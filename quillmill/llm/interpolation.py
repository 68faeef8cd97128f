"""Language-model scores by deleted interpolation of bigrams, unigrams and a uniform floor.

P(w | h) = a(b) c(h w) / c(h) + u(b) c(w) / N + z(b) / (V + 1), where c counts tokens of the
training rows, N is their number, V the distinct ones, and b is the bucket of c(h) by powers
of two. The weights a, u, z of each bucket sum to one and are learned by expectation-
maximisation on held-out counts: every training token is held out in turn, that is scored by
counts less itself. A text's first token follows a start mark, its last one is the end token.

Counting is exact and in blocks: a task hashes about BLOCK_TOKENS tokens, ships its distinct
words and word pairs, sorted, by hash range, and gets their totals back, so a frequent word
costs one entry a block. What reaches the driver is a histogram with a bounded number of
cells (bucket x bigram share x unigram share).

Defined cases: a null or empty text is the end token alone; rows without doc_id count as
training and are scored; repeated rows count each; without any training row the model is
uniform; extra columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, blocks, bucket_of, cut, expand, expand_sorted, known_id, mix, null_id, partitions, squeeze, squeeze_sorted, table, tidy, trimmed, trimmed_group, utf8, word_hashes

BLOCK_TOKENS = 700_000
#: Hash values of the end token and of the mark before a text; no word is looked up by them.
END, START = np.uint64(0x5DEECE66D1234567), np.uint64(0xB5297A4D76543210)
#: Cells a factor of two of a share, cells of a share, and buckets of a context's frequency.
FINE, CELLS, BUCKETS = 4, 128, 40
ROUNDS = 60
#: Bits of a pair's hash that shipping leaves out.
SPARED = np.uint64(16)


def pairs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of (token before, token) at each token of texts of the given lengths (end included)."""
    before = np.concatenate([[START], words[:-1]])
    before[np.cumsum(lengths)[:-1]] = START
    return mix(before * np.uint64(BASE) + mix(words)) >> SPARED


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.minimum(np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, BUCKETS - 1), 0)


def shipped(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of blocks, words and pairs for docs(doc_id, text, train)."""

    def ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        total = 0

        def flush() -> pd.DataFrame:
            ids, train, lengths, words = (np.concatenate(x) for x in zip(*held, strict=True))
            block = uuid4().hex
            learn = np.repeat(train, lengths)
            rows = []
            names, which = np.unique(words, return_inverse=True)
            for kind, own, at, short in (("word", names, which, squeeze_sorted), ("pair", *np.unique(pairs(words, lengths), return_inverse=True), squeeze_sorted)):
                count = np.bincount(at, weights=learn, minlength=len(own)).astype(np.uint32)
                place = bucket_of(own if kind == "word" else own << SPARED, ranges)
                bounds = np.searchsorted(place, np.arange(ranges + 1))
                rows += [(kind, r, block, short(own[a:b]), squeeze(count[a:b]), None, None) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            rows.append(("block", -1, block, squeeze_sorted(names), squeeze(which.astype(np.uint32)), squeeze(ids), np.stack([lengths, train]).astype("<i8").tobytes()))
            return pd.DataFrame(rows, columns=["kind", "range", "block", "a", "b", "c", "d"])

        for pdf in batches:
            texts, ids, train = utf8(pdf["text"]), pdf["doc_id"].to_numpy(), pdf["train"].to_numpy(dtype=bool)
            for i, j in blocks(texts):
                words, count = word_hashes(texts[i:j])
                ends = np.cumsum(count)
                held.append((ids[i:j], train[i:j].astype(np.int64), count + 1, np.insert(words, ends, END)))
                total += len(words) + j - i
                if total >= BLOCK_TOKENS:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return docs.mapInPandas(trimmed(ship), "kind string, range int, block string, a binary, b binary, c binary, d binary")


def totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers to the blocks of one range: total counts in the order shipped; a "sum" row of
    distinct and all training tokens for words. A block's own row passes."""
    kind = key[0]
    if kind == "block":
        return pdf[["kind", "range", "block", "a", "b", "c", "d"]]
    hashes = [expand_sorted(x) for x in pdf["a"]]
    names, at = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([expand(x, np.uint32) for x in pdf["b"]])).astype(np.uint64)
    rows, first = [], 0
    for block, own in zip(pdf["block"], hashes, strict=True):
        rows.append((kind, int(key[1]), block, squeeze(count[at[first : first + len(own)]]), None, None, None))
        first += len(own)
    if kind == "word":
        rows.append(("sum", int(key[1]), "", int((count > 0).sum()).to_bytes(8, "little"), int(count.sum()).to_bytes(8, "little"), None, None))
    return pd.DataFrame(rows, columns=["kind", "range", "block", "a", "b", "c", "d"])


def opened(pdf: pd.DataFrame) -> tuple:
    """(ids, lengths, train, c(w), c(h), c(h w)) of a block, the counts per token."""
    own = pdf[pdf["kind"] == "block"].iloc[0]
    names, which, ids = expand_sorted(own["a"]), expand(own["b"], np.uint32), expand(own["c"], np.int64)
    lengths, train = np.frombuffer(own["d"], dtype="<i8").reshape(2, -1)
    answer = lambda kind: np.concatenate([expand(x, np.uint64) for x in pdf[pdf["kind"] == kind].sort_values("range")["a"]]).astype(np.int64)
    count = answer("word")
    word = count[which]
    before = np.concatenate([[0], word[:-1]])
    end = np.searchsorted(names, END)
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = count[end] if end < len(names) and names[end] == END else 0
    pair = answer("pair")[np.unique(pairs(names[which], lengths), return_inverse=True)[1]]
    return ids, lengths, train.astype(bool), word, before, pair


def cell(share: np.ndarray) -> np.ndarray:
    """0 for share 0, else 1 + position on a logarithmic scale."""
    safe = np.where(share > 0, share, 1.0)
    return np.where(share > 0, np.minimum(1 + np.floor(-np.log2(safe) * FINE).astype(np.int64), CELLS - 1), 0)


def fit(cells: pd.DataFrame, vocabulary: int) -> np.ndarray:
    """Weights (bucket, [bigram, unigram, uniform]) from cells(bucket, n, two, one): n held-out
    tokens with sums of their bigram and unigram shares."""
    weights = np.tile(np.array([0.0, 0.5, 0.5]), (BUCKETS, 1))
    pooled = []
    for b in range(BUCKETS):
        own = cells[cells["bucket"] == b]
        pooled.append(own)
        if not len(own):
            if b:
                weights[b] = weights[b - 1]
            continue
        n = own["n"].to_numpy(dtype=float)
        parts = np.stack([own["two"].to_numpy() / n, own["one"].to_numpy() / n, np.full(len(own), 1.0 / (vocabulary + 1))], axis=1)
        w = np.array([1 / 3, 1 / 3, 1 / 3]) if b else np.array([0.0, 0.5, 0.5])
        for _ in range(ROUNDS):
            mass = parts * w
            w = (mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-300) * n[:, None]).sum(axis=0)
            w /= w.sum()
        w = np.maximum(w, [0.0, 1e-6, 1e-6])
        weights[b] = w / w.sum()
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of
    docs(doc_id, text, train)."""
    spark = docs.sparkSession
    ranges = 3 * partitions(spark)
    schema = "kind string, range int, block string, a binary, b binary, c binary, d binary"
    sent = shipped(docs.select(known_id("doc_id").alias("doc_id"), "text", "train"), ranges)
    own = F.when(F.col("kind") == "block", F.col("block"))
    back = cut(sent.groupBy("kind", "range", own.alias("own")).applyInPandas(trimmed_group(totals), schema))
    sums = back.where("kind = 'sum'").select("a", "b").toPandas()  # a row a range
    vocabulary = sum(int.from_bytes(x, "little") for x in sums["a"])
    n = sum(int.from_bytes(x, "little") for x in sums["b"])
    open_blocks = back.where("kind <> 'sum'").groupBy("block")

    def held_out(pdf: pd.DataFrame) -> pd.DataFrame:
        _, lengths, train, word, before, pair = opened(pdf)
        own = np.repeat(train, lengths)
        word, before, pair = word[own] - 1, before[own] - 1, pair[own] - 1
        two = np.where(before > 0, pair / np.maximum(before, 1), 0.0)
        one = word / max(1, n - 1)
        code = (bucket(before) * CELLS + cell(two)) * CELLS + cell(one)
        found, at = np.unique(code, return_inverse=True)
        total = lambda x: np.bincount(at, weights=x, minlength=len(found))
        return pd.DataFrame({"code": found, "n": total(np.ones(len(at))), "two": total(two), "one": total(one)})

    with tidy(spark):
        cells = open_blocks.applyInPandas(held_out, "code long, n double, two double, one double")
        cells = cells.groupBy("code").agg(F.sum("n").alias("n"), F.sum("two").alias("two"), F.sum("one").alias("one")).toPandas()  # at most BUCKETS * CELLS**2 rows
    weights = fit(cells.sort_values("code").assign(bucket=lambda x: x["code"] // CELLS**2), vocabulary)
    if not n:  # nothing was learned: all mass on the uniform floor
        weights = np.tile(np.array([0.0, 0.0, 1.0]), (BUCKETS, 1))

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, lengths, _, word, before, pair = opened(pdf)
        w = weights[bucket(before)]
        p = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * word / max(1, n) + w[:, 2] / (vocabulary + 1)
        first = np.cumsum(lengths) - lengths
        base = np.log10((word + 0.5) / (n + 0.5 * (vocabulary + 1)))
        of = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({"doc_id": ids, "n_tokens": lengths.astype(np.int64), "n_known": of((word > 0).astype(np.int64)), "base_score": of(base), "score": of(np.log10(p))})

    out = open_blocks.applyInPandas(scored, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select(null_id(F.col("doc_id")).alias("doc_id"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train")))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

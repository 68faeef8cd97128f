"""Language identification by compression.

A bounded sample of labelled rows gives each language a raw-content zstandard dictionary; a
text belongs to the language whose dictionary compresses it smallest, and is rejected where
the runner-up is nearly as small.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected; rows
without a label or text teach nothing; ties go to the alphabetically first language; with no
labelled row at all every text is `und`; rows without doc_id are not held out; an empty table gives no rows; extra columns are
ignored by `predict` and kept by `keep_confident`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, trimmed

#: The training sample bounds a dictionary: documents a language, taken whole, and characters
#: after which no further one is taken.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 300_000
#: Bytes compressed at once, so that a long text keeps leaning on the dictionaries, and the
#: zstandard level.
PIECE, LEVEL = 1500, 12
#: Share of the runner-up's size by which the winner must be smaller.
MARGIN = 0.002

_FOLD = bytes(i if i >= 128 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def folded(text: str) -> bytes:
    """Lower case, with runs of ASCII other than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split())


def dictionaries(labelled: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Raw-content dictionary of each language, from the rows of labelled(doc_id, text, lang)
    with the least hashes: at most docs whole texts a language reach the driver, the last of
    them the one that brings their characters to chars or beyond."""
    rows = labelled.where("text is not null and lang is not null and text <> ''").withColumn("h", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    first = rows.select("lang", "h", "doc_id", "text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = first.withColumn("before", before).where(F.col("before") < chars)
    found: dict[str, list[tuple[int, str]]] = {}
    for r in chosen.select("lang", "k", "text").collect():
        found.setdefault(r["lang"], []).append((r["k"], r["text"]))
    return {lang: b" ".join(folded(x) for _, x in sorted(v)) for lang, v in sorted(found.items())}


def compressor(content: bytes, level: int, size: int) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(level, source_size=size, dict_size=len(content), write_content_size=False, write_dict_id=False)
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=made)


def predict(docs: DataFrame, dictionary: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score (share by which the winner beats the runner-up) and rejected
    for docs(doc_id, text, ...). Only the text is looked at."""
    langs = list(dictionary)
    prepare(docs.sparkSession)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = [compressor(dictionary[x], LEVEL, PIECE) for x in langs]
        for pdf in batches:
            pred, score = [], []
            for text in pdf["text"]:
                best, share = "und", 0.0
                if isinstance(text, str) and langs and any(c.isalpha() for c in text):
                    data = folded(text)
                    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)] or [b""]
                    sizes = np.array([sum(len(t.compress(p)) for p in pieces) for t in tools])
                    first = int(sizes.argmin())
                    rest = np.delete(sizes, first)
                    best, share = langs[first], 1.0 - sizes[first] / rest.min() if len(rest) else 1.0
                pred.append(best)
                score.append(share)
            yield pdf.drop(columns=["text"]).assign(lang_pred=pred, score=np.array(score, dtype=np.float64))

    fields = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double"
    rejected = (F.col("lang_pred") == "und") | (F.col("score") < margin)
    return docs.mapInPandas(trimmed(scored), schema).withColumn("rejected", rejected)


def fold_of(n: int) -> Column:
    """A document's fold; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def keep_confident(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents whose language is told with a sufficient margin, their columns unchanged."""
    known = dictionaries(docs.select("doc_id", "text", "lang").where(fold_of(4) != 2))
    marked = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), known)
    return marked.where("not rejected").select("row.*")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = dictionaries(docs.where(fold_of(4) != 2))
    out = predict(docs.select("doc_id", "text"), known)
    return out.select("doc_id", (fold_of(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")

"""Streams of posts: the batch expressions on micro-batches, with state where order matters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import match, text
from ..plans.config import Rules


#: Posts as a scan leaves them.
POSTS = "seq long, id string, uuid string, detail_api_type string, title string, keyword string, search_content string"


def read_posts(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """New files of a folder, a bounded number a micro-batch (the back pressure)."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def matching(posts: DataFrame, rules: Rules = Rules(), content: str = "search_content") -> DataFrame:
    """Posts whose title and text match; stateless."""
    t, c = text.normalize(F.col("title"), rules.normalization), text.normalize(F.col(content), rules.normalization)
    kept = posts.withColumns({"_t": t, "_c": c}).where(match.title_passes(F.col("_t"), rules) & match.relevant(F.col("_t"), F.col("_c"), rules))
    return kept.drop("_t", "_c")


def clean_stream(posts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Relevant posts with archive content; stateless, so any sink and mode will do."""
    return matching(posts, rules, "content").withColumn("content", text.archive_content(F.col("content")))


def first_seen(posts: DataFrame, *keys: str, time: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key; with an event time, state is dropped behind the watermark."""
    if time:
        return posts.withWatermark(time, lateness).dropDuplicatesWithinWatermark(list(keys))
    return posts.dropDuplicates(list(keys))


def quota(posts: DataFrame, n: int, by: str = "keyword") -> DataFrame:
    """The first n rows of each keyword over the whole stream; the state is one counter."""
    names = posts.columns
    schema = posts.schema

    def take(key: tuple, batches, state):
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("seq")
        out = rows.head(max(0, n - used)) if key[0] else rows
        state.update((used + len(out),))
        yield out[names]

    return posts.groupBy(by).applyInPandasWithState(take, schema, "used long", "append", "NoTimeout")


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything there is now, micro-batch by micro-batch, through each; an error in it ends
    the query and is raised by awaitTermination."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, each input once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

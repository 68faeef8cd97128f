"""Ordered operators: first arrivals, top-k pools, early stop, quotas. `seq` is the order of
arrival; ties always have a last key, so results do not depend on partitions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.config import Selection
from ..sources.tables import cut
from . import order


def first_arrivals(posts: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return posts.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def heap_order() -> list[Column]:
    """Best first: score, length, then id as a string."""
    return [F.desc("quality_score"), F.desc("content_chars"), F.desc(F.col("id").cast("string"))]


def ranked(rows: DataFrame, by: str, order: list[Column], only: str | None) -> DataFrame:
    """rows with `rank` in their keyword, those for which the column `only` holds first; the
    others are dropped after the ranking, so what makes the column is computed once."""
    first = [F.desc(only)] if only else []
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*first, *order)))


def top_pool(scored: DataFrame, k: int, by: str = "keyword", only: str | None = None) -> DataFrame:
    """The k best rows of each keyword, with their rank."""
    out = ranked(scored, by, heap_order(), only).where(F.col("rank") <= k)
    return out.where(only) if only else out


def first_rows(scored: DataFrame, k: int, by: str = "keyword", only: str | None = None) -> DataFrame:
    """The first k rows of each keyword by arrival."""
    out = ranked(scored, by, [F.col("seq")], only).where(F.col("rank") <= k).drop("rank")
    return out.where(only) if only else out


def stops(rows: DataFrame, s: Selection, by: str = "keyword") -> DataFrame:
    """(keyword, stop): the place in `seq` of the first full batch of rows(seq, keyword, passed)
    after which the pool is full; keywords that never fill it are missing. Counts run over
    ranges of `seq`, so no task sees a whole keyword."""
    sums = {"_n": F.lit(1), "_ok": F.col("passed").cast("int")}
    counted = order.running(rows.select("seq", by, "passed"), by, ["seq"], sums)
    full = (F.col("_n") % s.batch == 0) & (F.col("_ok") >= s.pool)
    return counted.where(full).groupBy(by).agg(F.min("seq").alias("stop"))


def early_stop_pool(scored: DataFrame, s: Selection = Selection(), by: str = "keyword") -> DataFrame:
    """The pool when a keyword's scan stops at the first full batch after which the pool is
    full; scored(passed, ...) holds all rows with content. scored is written once, as it is read
    to find the stops and again to choose; only a task's k best of a keyword meet in the choice."""
    rows = cut(scored)
    last = stops(rows, s, by).select(F.col(by).alias("_by"), "stop")
    kept = rows.where("passed").join(last, F.col(by).eqNullSafe(F.col("_by")), "left").where("stop is null or seq <= stop")
    return top_pool(kept.drop("_by", "stop"), s.pool, by)


def elastic_pool(scored: DataFrame, s: Selection = Selection(), by: str = "keyword") -> DataFrame:
    """The pool with a limit that grows while newcomers replace many and shrinks when they do
    not. Its course depends on arrival, so a keyword's passed rows are folded in `seq` order;
    the state is a bounded heap, whatever the keyword's size.

    Rows come to the fold sorted and in Arrow batches, several keywords a partition."""
    fields = scored.schema.fields
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", rank int"

    class Fold:
        def __init__(self) -> None:
            self.heap: list[tuple] = []
            self.limit, self.idle, self.seen, self.replaced, self.stopped = s.pool, 0, 0, 0, False

        def push(self, row: tuple, at: dict[str, int]) -> None:
            if self.stopped:
                return
            self.seen += 1
            if row[at["passed"]]:
                key = (int(row[at["quality_score"]]), int(row[at["content_chars"]]), str(row[at["id"]]), -int(row[at["seq"]]))
                if len(self.heap) < self.limit:
                    heapq.heappush(self.heap, (key, row))
                elif key > self.heap[0][0]:
                    heapq.heapreplace(self.heap, (key, row))
                    self.replaced += 1
            if self.seen % s.batch == 0:
                self.batch_done()

        def batch_done(self) -> None:
            if s.elastic:
                if self.replaced >= s.replace_threshold and self.limit < s.pool_max:
                    self.limit, self.idle = min(self.limit + s.pool_step, s.pool_max), 0
                else:
                    self.idle += 1
                    if self.limit > s.pool and self.idle >= s.idle_rounds:
                        self.limit, self.idle = max(self.limit - s.pool_step, s.pool), 0
                        while len(self.heap) > self.limit:
                            heapq.heappop(self.heap)
            self.replaced = 0
            self.stopped = not s.fill_quota and len(self.heap) >= self.limit

        def rows(self) -> list[tuple]:
            return [(*row, i + 1) for i, (_, row) in enumerate(sorted(self.heap, key=lambda x: x[0], reverse=True))]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {n: i for i, n in enumerate(names)}
        now, state = None, None
        for pdf in batches:
            for row in pdf[names].itertuples(index=False, name=None):
                if state is None or row[at[by]] != now:
                    if state is not None and state.heap:
                        yield pd.DataFrame(state.rows(), columns=[*names, "rank"])
                    now, state = row[at[by]], Fold()
                state.push(row, at)
        if state is not None and state.heap:
            yield pd.DataFrame(state.rows(), columns=[*names, "rank"])

    return scored.repartition(F.col(by)).sortWithinPartitions(by, "seq").mapInPandas(fold, schema)


def running_quota(rows: DataFrame, n: int, kept: Column, by: str = "keyword") -> DataFrame:
    """Rows in arrival order with `is_kept` (kept and among the first n such of a non-empty
    keyword) and `is_dropped` (not kept, before the quota was full). Counts run over ranges of
    `seq`, which tells rows apart; rows should be slim, and be joined by `seq` afterwards."""
    out = order.running(rows.withColumn("_k", kept), by, ["seq"], {"_used": F.col("_k").cast("int")}, before=True)
    open_ = (F.col("_used") < n) | (F.length(text_of(by)) == 0)
    return out.withColumn("is_kept", F.col("_k") & open_).withColumn("is_dropped", ~F.col("_k") & open_).drop("_k", "_used")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def page_schedule(pages: DataFrame, strategy: str = "bfs", frontload: int = 3, stride: int = 5) -> DataFrame:
    """pages(page) with priority and visit (from 1): ascending, descending, or best first with
    the first pages ahead and later ones interleaved."""
    p = F.col("page")
    offset = p - frontload - 1
    best = F.when(p <= frontload, p / F.lit(100.0)).otherwise(frontload + offset % stride + F.floor(offset / stride) / F.lit(100.0))
    priority = {"dfs": -p.cast("double"), "best_first": best.cast("double")}.get(strategy, p.cast("double"))
    out = pages.withColumn("priority", priority)
    return out.withColumn("visit", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("priority", "page")))

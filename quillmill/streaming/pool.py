"""The best posts of each keyword from a stream, in one stateful operator: posts seen before are
left out, and a post goes on if it is among the k best (or the k first) that its key has had so
far. What goes on holds the pool of all posts at any time, so the pool is the k best of it: the
stream only appends, and results do not depend on how files fall into micro-batches.

A keyword may be dealt to several keys by its posts' ids, so a keyword that most posts have is
not one task's; the posts of one id share a key. State of a key: the ids seen, each forgotten
after `forget`, and the k best sort keys. The k first by arrival are a quota. A key without posts
for `idle` gives up its pool, not its ids; what goes on afterwards is more than needed, never less.

Defined cases: posts of a null keyword share a key; a null id is an id; of copies in one
micro-batch that with the least `seq` is the first; posts that did not pass are seen but do not
go on; state lives in RocksDB, in the checkpoint."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import rank
from . import posts as streams

#: Columns that the operator reads; all others go along.
NEEDED = ("seq", "id", "uuid", "passed", "quality_score", "content_chars")
KEY, PART = "_key", "_part"


class Entrants(StatefulProcessor):
    """Posts that enter the k best (or, by arrival, the k first) of their key. Sort keys are
    kept, not posts; greater ones are better."""

    def __init__(self, k: int, best: bool, idle: int | None, forget: int | None) -> None:
        self.k, self.best, self.idle, self.forget = k, best, idle, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string, uuid string", "seq long", self.forget)
        self.pool = handle.getListState("pool", "score long, chars long, id string, seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        pdf = pdf[~pdf[["id", "uuid"]].duplicated()]
        heap = list(self.pool.get())
        heapq.heapify(heap)
        out = []
        for at, (seq, i, u, passed, score, chars) in enumerate(pdf[list(NEEDED)].itertuples(index=False, name=None)):
            name = ("\0" if i is None else i, "\0" if u is None else u)  # state takes no nulls
            if self.seen.containsKey(name):
                continue
            self.seen.updateValue(name, (int(seq),))
            if not passed:
                continue
            mine = (int(score), int(chars), i or "", -int(seq)) if self.best else (0, 0, "", -int(seq))
            if len(heap) < self.k:
                heapq.heappush(heap, mine)
            elif self.k and mine > heap[0]:
                heapq.heapreplace(heap, mine)
            else:
                continue
            out.append(at)
        if out:
            self.pool.put(heap)
        if self.idle:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pdf.iloc[out]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.pool.clear()
        return iter([])

    def close(self) -> None:
        pass


def entrants(scored: DataFrame, k: int, by: str = "keyword", best: bool = True, parts: int = 1, idle: int | None = None, forget: int | None = None) -> DataFrame:
    """The posts of a stream that enter the pool of their keyword; scored has NEEDED and the
    keyword. idle and forget in milliseconds, None for ever."""
    name = F.coalesce(F.col(by), F.lit(""))
    dealt = scored.withColumns({KEY: name, PART: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), "id": F.col("id").cast("string"), "uuid": F.col("uuid").cast("string")})
    schema = dealt.drop(KEY, PART).schema
    return dealt.groupBy(KEY, PART).transformWithStateInPandas(Entrants(k, best, idle, forget), schema, "Append", "ProcessingTime" if idle or forget else "None")


def pool(entered: DataFrame, k: int, by: str = "keyword", best: bool = True) -> DataFrame:
    """The pool of what entered, as a table: the k best (or first) of each keyword."""
    once = rank.first_arrivals(entered, by, "id", "uuid")
    return rank.top_pool(once, k, by) if best else rank.first_rows(once, k, by)


#: State in RocksDB; no micro-batch without data, for with timers there would always be another.
#: Timers that have run out are served by the next micro-batch.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession) -> Iterator[None]:
    """Queries started within have SETTINGS."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def to_table(entered: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended to Parquet; a later call goes on where this one ends."""
    with settings(entered.sparkSession):
        return streams.to_parquet(entered, path, checkpoint)

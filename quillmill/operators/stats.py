"""Counts, rates and timings of runs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def company_counts(rows: DataFrame, name: str = "company", separator: str = ", ") -> DataFrame:
    """Rows per organisation, of lists too; blank names left out; most frequent first."""
    one = rows.select(F.explode(F.split(F.col(name), separator)).alias("company")).where("trim(company) <> ''")
    return one.groupBy("company").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company")


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / F.greatest(whole, F.lit(1)), 2)


def crawl_metrics(events: DataFrame, *keys: str) -> DataFrame:
    """Counters and rates of events(stage, ok, hit, seconds), by keys: requests and failures,
    success and hit rates, archived share, requests a second."""
    n = lambda c: F.count_if(c)
    stage, ok = F.col("stage"), F.coalesce(F.col("ok"), F.lit(False))
    total, good = F.count("*"), n(ok)
    return events.groupBy(*keys).agg(
        total.alias("requests"), good.alias("successes"), (total - good).alias("failures"), n(F.col("hit")).alias("hits"),
        n((stage == "archive") & ok).alias("archived"), percent(good, total).alias("success_pct"), percent(n(F.col("hit")), good).alias("hit_pct"),
        percent(n((stage == "archive") & ok), n(stage == "candidate")).alias("yield_pct"), F.round(total / F.greatest(F.sum("seconds"), F.lit(1e-6)), 2).alias("qps"),
    )


def stage_timing(events: DataFrame, top: int | None = None) -> DataFrame:
    """Sum, count and mean of events(stage, seconds) by stage, longest first."""
    out = events.groupBy("stage").agg(F.sum("seconds").alias("total"), F.count("*").alias("n"), F.avg("seconds").alias("mean")).orderBy(F.desc("total"), "stage")
    return out.limit(top) if top else out


def timing_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Timings of after less those of before, where anything was added."""
    b = before.select("stage", F.col("total").alias("t0"), F.col("n").alias("n0"))
    out = after.join(b, "stage", "left").select("stage", (F.col("total") - F.coalesce("t0", F.lit(0.0))).alias("total"), (F.col("n") - F.coalesce("n0", F.lit(0))).alias("n"))
    return out.where("n > 0").withColumn("mean", F.col("total") / F.col("n"))


def run_counts(rows: DataFrame) -> DataFrame:
    """One row: candidates, with content, passed, rejected, kept and dropped ones."""
    c = F.count_if
    return rows.agg(F.count("*").alias("candidates"), c(F.length("content") > 0).alias("with_content"), c(F.col("passed")).alias("passed"), c(~F.col("passed")).alias("rejected"), c(F.col("is_kept")).alias("kept"), c(F.col("is_dropped")).alias("dropped_unknown"))


class RunCounts:
    """The counts of run_counts taken while a run's plans execute: each point of the run is
    observed where its rows pass, so nothing is counted by a further pass. A point's numbers are
    those of the first execution that it is part of."""

    POINTS = {"found": ("candidates",), "scored": ("with_content", "passed", "rejected"), "cleaned": ("kept", "dropped_unknown")}

    def __init__(self) -> None:
        self.points: dict[str, Observation] = {}

    def at(self, point: str, rows: DataFrame) -> DataFrame:
        """rows with the point's counts observed."""
        every = F.count(F.lit(1))
        count = {"candidates": every, "with_content": every, "passed": F.count_if(F.col("passed")), "rejected": F.count_if(~F.col("passed")), "kept": F.count_if(F.col("is_kept")), "dropped_unknown": F.count_if(F.col("is_dropped"))}
        self.points[point] = Observation()
        return rows.observe(self.points[point], *[count[c].alias(c) for c in self.POINTS[point]])

    def get(self) -> dict[str, int]:
        """The counts of all points; waits for their executions."""
        return {name: n for seen in self.points.values() for name, n in seen.get.items()}

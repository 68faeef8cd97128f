"""Order without a task a group: place numbers and running sums over ranges of the order.

Rows are dealt to partitions by ranges of the order, written once, and summed a range: the
carry of a range, which is the sum of those before it, has a row a range (and key) and is joined
back. What has to be in order in one task is a range's rows, never a key's, so a key that holds
most rows is spread like any other.

Defined cases: an empty table gives no rows; null keys are a key; null values add nothing; rows
that tie in the order come in the order's further columns, and where those tie as well, in any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Working columns; rows must not have them.
PART, AT = "_part", "_at"


def ranged(rows: DataFrame, *order: str | Column, parts: int | None = None) -> DataFrame:
    """rows written in ranges of the order, with the range's number."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()))


def carried(counts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """counts(keys, range, sums) with each sum replaced by that of the ranges before: a window
    over the ranges of a key, of which there are a bounded number."""
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, PART, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])


def running(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column], before: bool = False, parts: int | None = None) -> DataFrame:
    """rows with the running sums of a key in the order, the row itself included or not
    (before). rows should be slim: they are shuffled twice. The order must tell rows apart."""
    own = [c for c in rows.columns]
    made = {f"_v{k}": F.coalesce(v, F.lit(0)).cast("long") for k, v in enumerate(sums.values())}
    kept = ranged(rows.withColumns(made), *order, parts=parts)
    carry = carried(kept.groupBy(key, PART).agg(*[F.sum(v).alias(v) for v in made]), [key], list(made))
    carry = carry.select(F.col(key).alias("_key"), F.col(PART).alias("_of"), *[F.col(v).alias(f"_c{v}") for v in made])
    local = Window.partitionBy(PART, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    within = kept.withColumns({f"_l{v}": F.coalesce(F.sum(v).over(local), F.lit(0)) for v in made})
    met = within.join(carry, F.col(key).eqNullSafe(F.col("_key")) & (F.col(PART) == F.col("_of")), "left")
    return met.select(*own, *[(F.col(f"_l{v}") + F.col(f"_c{v}")).alias(name) for v, name in zip(made, sums, strict=True)])


def numbered(rows: DataFrame, *order: str | Column, name: str = "number", first: int = 1) -> DataFrame:
    """rows with their place in the order, first, first + 1, ...: places in sorted ranges, after
    the rows of the ranges before."""
    own = rows.columns
    spot = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = cut(rows.orderBy(*order).withColumns({PART: F.spark_partition_id(), AT: spot}))
    counts = kept.groupBy(PART).agg(F.count("*").alias("_n"))
    before = carried(counts.withColumn("_all", F.lit(0)), ["_all"], ["_n"]).select(F.col(PART).alias("_of"), "_n")
    met = kept.join(F.broadcast(before), F.col(PART) == F.col("_of"))  # a row a range
    return met.select(*own, (F.col("_n") + F.col(AT) + first).alias(name))

"""Saved lookups (token, value, at) that are read while they are written. A version is a folder
that is never changed: an upsert adds one with its rows alone, a compaction one with the latest
row of every token and a list of the versions that it replaces. A version counts once its writer
has finished it, so a reader sees whole versions only, and a writer that fails leaves nothing that
counts; an upsert that comes while another compacts is in no list, and stays.

Replaced versions are deleted by the next compaction, for those who still read them. Names of
folders are listed on the driver, rows are not."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import hadoop_path

#: Upserts after which a compaction follows.
UPSERTS = 8
NAME = re.compile(r"v(\d{10})-(all|new)-[0-9a-f]+")
REPLACES = "_replaces"


def versions(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, all or new, name) of the finished versions, in their order."""
    at, files = hadoop_path(spark, path)
    if not files.exists(at):
        return []
    done = {"new": "_SUCCESS", "all": REPLACES}
    names = (status.getPath().getName() for status in files.listStatus(at))
    return sorted((int(m[1]), m[2], name) for name in names if (m := NAME.fullmatch(name)) and files.exists(hadoop_path(spark, f"{path}/{name}/{done[m[2]]}")[0]))


def replaced(spark: SparkSession, folder: str, name: str) -> set[str]:
    """Names of the versions that a compaction stands for."""
    at, files = hadoop_path(spark, f"{folder}/{name}/{REPLACES}")
    held = files.open(at)
    try:
        return set(spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8").split())
    finally:
        held.close()


def current(spark: SparkSession, folder: str, found: list[tuple[int, str, str]]) -> tuple[list[str], set[str]]:
    """The names to be read, the last compaction and what it does not replace, and those not."""
    whole = [name for _, kind, name in found if kind == "all"]
    gone = replaced(spark, folder, whole[-1]) | set(whole[:-1]) if whole else set()
    return [name for *_, name in found if name not in gone], gone


def latest(rows: DataFrame) -> DataFrame:
    """The latest row of each token; at equal times that with the greater value."""
    own = F.max(F.struct("at", "value")).alias("x")
    return rows.groupBy("token").agg(own).select("token", "x.value", "x.at")


def read(spark: SparkSession, path: str, kind: str, value: str = "array<string>") -> DataFrame:
    """The latest value of each token; no rows where nothing was saved."""
    schema = f"token string, value {value}, at long"
    folder = f"{path}/{kind}"
    names, _ = current(spark, folder, versions(spark, folder))
    if not names:
        return spark.createDataFrame([], schema)
    return latest(spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in names]))


def _add(rows: DataFrame, folder: str, number: int, kind: str) -> str:
    name = f"v{number:010}-{kind}-{uuid.uuid4().hex}"
    rows.select("token", "value", F.col("at").cast("long").alias("at")).write.parquet(f"{folder}/{name}")
    return name


def upsert(rows: DataFrame, path: str, kind: str, value: str = "array<string>") -> None:
    """Save rows(token, value, at) over what is known of their tokens; rows may come from a read
    of the same lookup."""
    spark, folder = rows.sparkSession, f"{path}/{kind}"
    found = versions(spark, folder)
    _add(latest(rows), folder, max((n for n, *_ in found), default=0) + 1, "new")
    if len(current(spark, folder, versions(spark, folder))[0]) > UPSERTS:
        compact(spark, path, kind, value)


def compact(spark: SparkSession, path: str, kind: str, value: str = "array<string>") -> None:
    """One version with the latest row of every token. Versions that an earlier compaction
    replaced are deleted."""
    folder = f"{path}/{kind}"
    found = versions(spark, folder)
    names, gone = current(spark, folder, found)
    if not names:
        return
    schema = f"token string, value {value}, at long"
    made = _add(latest(spark.read.schema(schema).parquet(*[f"{folder}/{n}" for n in names])), folder, max(n for n, *_ in found) + 1, "all")
    at, files = hadoop_path(spark, f"{folder}/{made}/{REPLACES}")
    out = files.create(at)
    out.writeBytes("\n".join(names))
    out.close()  # from here on it counts
    for name in gone:
        files.delete(hadoop_path(spark, f"{folder}/{name}")[0], True)

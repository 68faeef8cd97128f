"""Command line: `posts` scores and archives posts, `library` builds the library of problems.

    python -m quillmill posts --posts IN --companies FILE --output DIR [--config DIR] ...
    python -m quillmill library --ranking IN --list FILE --output DIR
"""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import entity, knowledge, posts, quality, stats
from .plans import config
from .sources import lookups, readers, sinks
from .sources.tables import cut, prepare
from .streaming import pool
from .streaming import posts as streams


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="quillmill", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("posts")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--posts", help="Parquet: seq, id, uuid, detail_api_type, title, keyword, search_content")
    source.add_argument("--responses", help="JSON search responses: keyword, page, data")
    p.add_argument("--pages", type=int, help="pages of a keyword among which an empty one ends its scan")
    p.add_argument("--details", help="Parquet: kind, key, content, and page (HTML) if there is any")
    p.add_argument("--comments", help="JSON comment responses: post_id, page, data")
    p.add_argument("--library", help="JSON library of problems, as `library` writes it")
    p.add_argument("--companies", required=True, help="JSON list of organisations")
    p.add_argument("--config", help="folder of configuration layers")
    p.add_argument("--keywords", nargs="*", help="keep only these")
    p.add_argument("--items", type=int)
    p.add_argument("--fill-valid-quota", action="store_true")
    p.add_argument("--mode", choices=["pool", "early", "elastic", "first"], default="early")
    p.add_argument("--stream", help="folder of a stream's state: --posts is read file by file, and a later run goes on with new files (modes pool and first)")
    p.add_argument("--with", dest="extra", nargs="*", default=[], choices=["id", "comments", "outline", "annotations"], help="further columns of the archive")
    p.add_argument("--keep-unknown", action="store_true", help="keep posts of no known organisation")
    p.add_argument("--lookups", help="folder of saved lookups of names beyond the dictionary; goes with --suggestions")
    p.add_argument("--suggestions", help="JSON search suggestions: token, arr")
    p.add_argument("--formats", default="md,txt")
    p.add_argument("--samples", type=int, default=0, help="so many rejected and dropped posts are written beside the reports")
    p.add_argument("--output", required=True)
    k = sub.add_parser("library")
    k.add_argument("--ranking", help="JSON ranking responses")
    k.add_argument("--list", help="written list of problems, or a folder of lists")
    k.add_argument("--rows", action="store_true", help="write JSON lines instead of one JSON document")
    k.add_argument("--output", required=True)
    return top.parse_args(args)


def chosen_posts(spark: SparkSession, a: argparse.Namespace, s: config.Settings, pick: config.Selection, library: quality.LibraryTables | None, counts: stats.RunCounts) -> DataFrame:
    """The posts that the selection keeps, scored, with a number that tells them apart."""
    details = spark.read.parquet(a.details) if a.details else spark.createDataFrame([], "kind string, key string, content string")
    if "page" in details.columns:  # pages as they were fetched, for what the service did not give
        details = details.withColumn("content", readers.detail_content(F.col("content"), F.col("page")))
    mine = F.col("keyword").isin(*a.keywords) if a.keywords else F.lit(True)
    if a.stream:
        if a.mode not in ("pool", "first") or not a.posts:
            raise SystemExit("--stream goes with --posts and the modes pool and first")
        best = a.mode == "pool"
        k = pick.pool if best else pick.items
        found = streams.matching(streams.read_posts(spark, a.posts, streams.POSTS), s.rules).where(mine)
        scored = quality.evaluate(posts.with_details(found, details), s.quality, s.rules, library).withColumn("content_chars", F.col("breakdown.content_chars"))
        entered = pool.entrants(scored, k, best=best)
        pool.to_table(entered, f"{a.stream}/entered", f"{a.stream}/state").awaitTermination()
        return readers.arrival(pool.pool(spark.read.schema(entered.schema).parquet(f"{a.stream}/entered"), k, best=best), a.keywords or ())
    if a.responses:
        found = readers.search_posts(spark.read.schema(readers.SEARCH).json(a.responses), a.keywords or (), a.pages or s.pages, s.rules)
    else:
        found = readers.arrival(spark.read.parquet(a.posts), a.keywords or ())
    full = posts.with_details(counts.at("found", posts.filter_candidates(found.where(mine), s.rules)), details)
    out = posts.select_posts(full, s.rules, s.quality, pick, library, a.mode, counts)
    if a.samples:
        posts.rejected_sample(out.rejected, a.samples).write.mode("overwrite").json(f"{a.output}/samples/rejected")
    return out.selected


def refreshed(spark: SparkSession, a: argparse.Namespace, chosen: DataFrame, entries: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The saved lookups (verified, owners) after this run has added what its titles and the
    suggestions say about tokens not yet known."""
    read = lambda: (lookups.read(spark, a.lookups, "verified", "boolean"), lookups.read(spark, a.lookups, "owners", "string"))
    if a.suggestions:
        said = spark.read.schema("token string, arr array<string>").json(a.suggestions)
        titles = chosen.select("seq", "title")
        named = entity.best_company(titles, entity.candidates(titles, entries, only=names))
        verified, owners = read()
        for kind, value, rows in zip(("verified", "owners"), ("boolean", "string"), entity.learnt(named.where(F.col("company") == entity.UNKNOWN), said, entries, verified, owners, int(time.time())), strict=True):
            lookups.upsert(rows, a.lookups, kind, value)
    verified, owners = read()
    return verified.select("token", F.col("value").alias("is_company")), owners.select("token", F.col("value").alias("company"))


def run_posts(spark: SparkSession, a: argparse.Namespace, counts: stats.RunCounts | None = None) -> dict[str, str]:
    """Reports by format. counts gets the run's counts, observed while it runs."""
    counts = counts or stats.RunCounts()
    s = config.settings(config.load(a.config)) if a.config else config.Settings()
    pick = replace(s.selection, items=a.items or s.selection.items, fill_quota=a.fill_valid_quota or s.selection.fill_quota)
    names = readers.companies(spark, a.companies)
    known = [r["company"] for r in names.collect()]  # a dictionary, some hundred names
    parts = readers.algorithm_library(spark, a.library) if a.library else {}
    chosen = chosen_posts(spark, a, s, pick, library_of(parts, s), counts)
    if a.comments:
        chosen = posts.with_comments(chosen, readers.flat_comments(spark.read.schema(readers.COMMENTS).json(a.comments)))
    extra = set(a.extra) - ({"comments"} if not a.comments else set()) - ({"annotations"} if not parts else set())
    if "annotations" in extra:
        chosen = posts.with_matches(chosen, knowledge.entries(parts["hot"]), s.rules)
    chosen, entries = cut(chosen), entity.dictionary(spark, known, readers.owner_aliases(dict(s.owners)))
    beyond = refreshed(spark, a, chosen, entries, names) if a.lookups else None
    done = cut(counts.at("cleaned", posts.clean(chosen, entries, names, pick.items, not a.keep_unknown, beyond)))
    if a.samples:
        posts.dropped_sample(done, a.samples).write.mode("overwrite").json(f"{a.output}/samples/dropped")
    rows = posts.archive(done, **{f"with_{x}": True for x in extra}, order=("seq",))
    return sinks.export(rows, a.output, "posts", a.formats.split(","))


def library_of(parts: dict, s: config.Settings) -> quality.LibraryTables | None:
    """The library as the score takes it, from the parts of its file."""
    if not parts:
        return None
    hot = knowledge.entries(parts["hot"]).select("id", "title", "frequency")
    return quality.library_tables(parts["titles"], hot, parts["ids"], parts["markers"].select("word"), parts["topics"].select("word"), s.rules, s.quality)


def run_library(spark: SparkSession, a: argparse.Namespace) -> str:
    sources = []
    if a.ranking:
        sources.append(readers.ranking(spark.read.schema(readers.RANKING).json(a.ranking), whole=False))
    if a.list:
        sources.append(readers.written_lists(spark, a.list).withColumn("seq", F.col("seq") + (1 << 40)))
    if not sources:
        raise SystemExit("nothing to read: give --ranking or --list")
    merged = knowledge.merge(knowledge.entries(knowledge.unite(*sources)))
    (sinks.save_library_rows if a.rows else sinks.save_library)(knowledge.slim(merged), a.output)
    return a.output


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("quillmill").getOrCreate()
    prepare(spark)
    if a.command == "library":
        print(run_library(spark, a))
        return
    counts = stats.RunCounts()
    print(run_posts(spark, a, counts))
    print(counts.get())


if __name__ == "__main__":
    main()

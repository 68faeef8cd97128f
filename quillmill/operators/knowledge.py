"""The knowledge base of problems: entries from several sources, merged and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import order
from .components import components

ENTRY = "seq long, id int, frontend_id string, title string, difficulty string, last_date string, frequency int, url string, source string"


def entries(raw: DataFrame) -> DataFrame:
    """Rows with any of the usual names for a field, as entries; a frequency is 1 at least."""
    has = set(raw.columns)

    def pick(*names: str) -> Column:
        own = [F.nullif(text.strip(F.col(n).cast("string")), F.lit("")) for n in names if n in has]
        return F.coalesce(*own) if own else F.lit(None).cast("string")

    number = text.positive(pick("id", "problem_id", "frontend_id"))
    frequency = F.coalesce(text.positive(pick("frequency", "freq", "count", "value")), F.lit(1))
    level = pick("difficulty", "level")
    difficulty = F.when(level.isin("1", "2", "3"), text.difficulty_of_level(level)).otherwise(text.difficulty_of_name(level))
    return raw.select(
        F.col("seq").cast("long").alias("seq"), F.when(number <= 9999, number).alias("id"), F.coalesce(pick("frontend_id"), number.cast("string"), F.lit("")).alias("frontend_id"),
        F.coalesce(pick("title"), F.lit("")).alias("title"), difficulty.alias("difficulty"), text.day_of(pick("last_date", "time")).alias("last_date"),
        frequency.alias("frequency"), F.coalesce(pick("url", "link"), F.lit("")).alias("url"), F.coalesce(pick("source"), F.lit("")).alias("source"),
    ).where("title <> ''")


def unite(*sources: DataFrame) -> DataFrame:
    """Entries of several sources in their order."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


GAPS = ("id", "frontend_id", "difficulty", "last_date", "url")


def gathered(found: DataFrame, *key: str, gaps: tuple[str, ...] = GAPS) -> DataFrame:
    """One entry a key: the most frequent row (the first at a tie), its gaps filled.

    A row that is more frequent than all before it takes the lead and is filled from what the
    leaders before it left; any other row fills what is still empty when it arrives. So a gap
    takes the value of the latest leader that has one, else of the first other row that has."""
    before = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    leads = F.col("frequency") > F.coalesce(F.max("frequency").over(before), F.lit(-1))
    rows = found.withColumn("_o", F.struct(~leads, F.when(leads, -F.col("seq")).otherwise(F.col("seq"))))
    filled = lambda c: F.length(F.col(c).cast("string")) > 0
    first = [F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col("_o"))).alias(c) for c in gaps]
    whole = [F.min_by(c, "_o").alias(c) for c in ("seq", "title", "frequency", *(g for g in GAPS if g not in gaps))]
    named = F.array_sort(F.collect_list(F.when(filled("source"), F.struct("_o", "source"))))
    return rows.groupBy(*key).agg(*first, *whole, F.array_distinct(F.transform(named, lambda x: x["source"])).alias("_sources"))


def groups(found: DataFrame) -> DataFrame:
    """found with `_t` (title key) and `_g`: the least title key that a chain of shared titles
    and numbers leads to. Rows without a number connect nothing by it."""
    rows = found.withColumn("_t", text.title_key(F.col("title"))).where("_t <> ''")
    pairs = rows.where("id is not null").select("id", "_t").distinct()
    # A number joins each of its titles to the least of them: a row a title, however many.
    least = pairs.groupBy("id").agg(F.min("_t").alias("u"))
    edges = pairs.join(least, "id").select("u", F.col("_t").alias("v")).where("u <> v")
    label, _ = components(edges)
    joined = rows.join(label, F.col("_t") == F.col("node"), "left")
    return joined.withColumn("_g", F.coalesce("component", "_t")).drop("node", "component")


def merge(found: DataFrame) -> DataFrame:
    """Entries joined wherever a number or a title connects them, most frequent first."""
    out = gathered(groups(found), "_g").withColumn("source", F.array_join("_sources", ","))
    url = F.when(F.length("url") > 0, F.col("url")).otherwise(text.search_url(F.col("title")))
    none = F.lit("")
    out = out.withColumns({"url": url, **{c: F.coalesce(c, none) for c in ("frontend_id", "difficulty", "last_date")}})
    return out.select([c.split()[0] for c in ENTRY.split(", ")]).orderBy(F.desc("frequency"), "title")


def slim(found: DataFrame) -> DataFrame:
    """Entries for the library: empty fields null, numbers 1 to 9999, most frequent first."""
    n = lambda c: F.nullif(text.strip(F.col(c)), F.lit(""))
    number = F.when(F.col("id").between(1, 9999), F.col("id"))
    url = F.coalesce(n("url"), F.nullif(text.search_url(F.col("title")), F.lit("")))
    out = found.select(number.alias("id"), n("title").alias("title"), n("difficulty").alias("difficulty"), F.greatest(F.coalesce("frequency", F.lit(1)), F.lit(1)).alias("frequency"), url.alias("url"))
    return out.where("title is not null or id is not null").orderBy(F.desc("frequency"), "title")


def library(found: DataFrame) -> DataFrame:
    """One row: version, problem_ids, problem_titles (most frequent first) and the entries."""
    order = F.struct((-F.col("frequency")).alias("f"), F.coalesce("title", F.lit("")).alias("t"), F.struct(*found.columns).alias("e"))
    one = found.agg(F.array_sort(F.collect_set("id")).alias("problem_ids"), F.array_sort(F.collect_list(order)).alias("all"))
    return one.select(F.lit(1).alias("version"), "problem_ids", F.array_distinct(F.filter(F.transform("all", lambda x: x["t"]), lambda t: F.length(t) > 0)).alias("problem_titles"), F.transform("all", lambda x: x["e"]).alias("interview_hot_problems"))


def library_rows(found: DataFrame) -> DataFrame:
    """The library as rows (kind, place, id, title, difficulty, frequency, url): its entries, most
    frequent first; the titles, each at its first entry's place; the numbers, ascending. Places
    come from sorted ranges, so a library of any size is nobody's single row."""
    own = ["id", "title", "difficulty", "frequency", "url"]
    entries = order.numbered(found.select(*own), F.desc("frequency"), F.coalesce("title", F.lit("")), *own, name="place")
    titles = entries.where("length(title) > 0").groupBy("title").agg(F.min("place").alias("first"))
    titles = order.numbered(titles, "first", name="place")
    ids = order.numbered(found.where("id is not null").select("id").distinct(), "id", name="place")
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), "place", *[(F.col(c) if c in df.columns else F.lit(None).cast(found.schema[c].dataType)).alias(c) for c in own])
    return row(entries, "entry").union(row(titles, "title")).union(row(ids, "id"))


def hot_scores(found: DataFrame) -> DataFrame:
    """Score of each title by its greatest frequency."""
    out = found.groupBy(text.title_key(F.col("title")).alias("title")).agg(F.max("frequency").alias("frequency"))
    return out.withColumn("score", text.frequency_score(F.col("frequency")))


def keep_best(found: DataFrame, key: Column) -> DataFrame:
    """For each key the most frequent entry (the first at a tie), its gaps but the number filled
    from the others."""
    out = gathered(found.withColumn("key", key), "key", gaps=GAPS[1:])
    return out.withColumn("source", F.element_at("_sources", 1)).drop("_sources", "seq")


def match_details(posts: DataFrame, hot: DataFrame) -> DataFrame:
    """(seq, key, title, frequency, matched_by, id, frontend_id, difficulty, url) of the entries
    that posts(seq, ids, titles) name by number or by title; an entry named by both appears once.
    Titles meet by `_t` where hot has it, else by their title key.

    An entry is brought to one row before it meets posts, which carry their numbers and titles,
    so each meeting is a finished row and the result, which grows with posts times entries of a
    title, is not shuffled. Only numbers that stand for several titles are gathered afterwards."""
    fields = ("frontend_id", "difficulty", "url")
    hot = hot.drop("seq").withColumns({c: F.col(c) if c in hot.columns else F.lit("") for c in fields})
    hot = hot if "_t" in hot.columns else hot.withColumn("_t", text.title_key(F.col("title")))
    key = F.when(F.col("id").isNotNull(), F.concat(F.lit("id:"), F.col("id"))).otherwise(F.concat(F.lit("title:"), F.col("_t")))
    hot = hot.withColumn("key", key)
    listed = lambda c: F.array_compact(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    posts = posts.groupBy("seq").agg(listed("ids"), listed("titles"))
    values = ("title", "frequency", "id", *fields)
    best = lambda *first: [F.min_by(c, F.struct(*first, -F.col("frequency"), F.col("title"))).alias(c) for c in values]
    entry = hot.groupBy("key").agg(*best(), F.min("_t").alias("_t"), F.max("_t").alias("_last"))
    # Merges: both sides grow with the input, and neither is sent to all tasks.
    one = entry.where("_t = _last").drop("_last").hint("merge")
    row = lambda rows, by: rows.select("seq", "key", *values, by.alias("matched_by"))
    by = lambda *names: F.array(*[F.lit(n) for n in names])
    named = posts.select("seq", "titles", F.explode("ids").alias("id")).join(one, "id")
    titled = posts.select("seq", "ids", F.explode("titles").alias("_t")).join(one, "_t").where(F.col("id").isNull() | ~F.array_contains("ids", F.col("id")))
    done = row(named, F.when(F.array_contains("titles", F.col("_t")), by("id", "title")).otherwise(by("id"))).unionByName(row(titled, by("title")))
    several = hot.join(entry.where("_t <> _last").select("key").hint("merge"), "key", "left_semi").hint("merge")
    by_id = posts.select("seq", F.explode("ids").alias("id")).join(several, "id")
    by_title = posts.select("seq", F.explode("titles").alias("_t")).join(several, "_t")
    found = lambda rows, by, o: rows.select("seq", "key", *values, F.lit(by).alias("by"), F.lit(o).alias("o"))
    rest = found(by_id, "id", 0).unionByName(found(by_title, "title", 1)).groupBy("seq", "key").agg(*best(F.col("o")), F.array_sort(F.collect_set("by")).alias("matched_by"))
    return done.unionByName(rest)


def annotations(matches: Column, most: int = 20) -> Column:
    """Lines "id. title | 频度:f | 难度:d | 链接:u" of the first matches, empty parts and entries
    without a title left out."""

    def line(m: Column) -> Column:
        number = F.coalesce(F.nullif(m["id"].cast("string"), F.lit("")), F.nullif(m["frontend_id"], F.lit("")))
        title = text.strip(F.coalesce(m["title"], F.lit("")))
        head = F.when(number.isNotNull(), F.concat(number, F.lit(". "), title)).otherwise(title)
        part = lambda label, c: F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(label), c.cast("string")))
        return F.when(F.length(title) > 0, F.concat_ws(" | ", head, part("频度:", F.when(m["frequency"] > 0, m["frequency"])), part("难度:", m["difficulty"]), part("链接:", m["url"])))

    return F.array_join(F.array_compact(F.transform(F.slice(matches, 1, most), line)), "\n")


def outline_text(items: Column, most: int = 30) -> Column:
    """The first items, spaces folded, each once, one a line."""
    folded = F.transform(F.slice(items, 1, most), lambda x: text.strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.array_distinct(F.filter(folded, lambda x: F.length(x) > 0)), "\n")

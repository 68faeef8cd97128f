"""The whole run over posts: candidates, enrichment, scoring, selection, cleaning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match, text
from ..plans.config import Quality, Rules, Selection
from . import entity, knowledge, quality, rank, stats


def filter_candidates(posts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Posts whose title and found text match, the first of each (keyword, id, uuid); a post
    that does not match hides no later one."""
    n = posts.withColumn("_t", text.normalize(F.col("title"), rules.normalization)).withColumn("_c", text.normalize(F.col("search_content"), rules.normalization))
    kept = n.where(match.title_passes(F.col("_t"), rules) & match.relevant(F.col("_t"), F.col("_c"), rules)).drop("_t", "_c")
    return rank.first_arrivals(kept, "keyword", "id", "uuid")


def with_details(posts: DataFrame, details: DataFrame) -> DataFrame:
    """posts with content and url: from details(kind, key, content), by the kind that the post
    names first, then the other; else the text that the search gave. Posts without any go."""
    d = details.where("length(content) > 0").groupBy("kind", "key").agg(F.first("content").alias("content"))
    of = lambda kind, name: d.where(F.col("kind") == kind).select(F.col("key").alias(f"_{name}k"), F.col("content").alias(f"_{name}"))
    both = posts.join(of("content-data", "c"), F.col("id") == F.col("_ck"), "left").join(of("moment-data", "m"), F.col("uuid") == F.col("_mk"), "left")
    own = F.col("detail_api_type") == "content-data"
    found = F.when(own, F.coalesce("_c", "_m")).otherwise(F.coalesce("_m", "_c"))
    content = F.coalesce(F.nullif(F.replace(found, F.lit("​"), F.lit("")), F.lit("")), F.nullif(F.col("search_content"), F.lit("")))
    out = both.withColumn("content", content).withColumn("url", detail_url()).drop("_c", "_m", "_ck", "_mk")
    return out.where(F.col("content").isNotNull())


def with_comments(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """posts with the array `comments` of comments(post_id, comments), pages in their order;
    empty for posts without any."""
    page = F.col("page") if "page" in comments.columns else F.lit(0)
    lists = comments.groupBy("post_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(page.alias("page"), "comments"))), lambda x: x["comments"])).alias("comments"))
    return posts.join(lists, F.col("id") == F.col("post_id"), "left").drop("post_id").withColumn("comments", F.coalesce("comments", F.array().cast("array<string>")))


def with_matches(scored: DataFrame, hot: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Scored posts with `algorithm_matches`: the entries of hot that a post names by number or
    title, most frequent first; empty for posts that name none."""
    named = scored.select("seq", F.col("breakdown.algorithm.ids").alias("ids"), F.transform("breakdown.algorithm.hot_titles", text.title_key).alias("titles"))
    keyed = hot.withColumn("_t", text.title_key(text.normalize(F.col("title"), rules.normalization)))
    item = F.struct((-F.col("frequency")).alias("order"), "title", "id", "frontend_id", "frequency", "difficulty", "url")
    lists = knowledge.match_details(named, keyed).groupBy("seq").agg(F.array_sort(F.collect_list(item)).alias("algorithm_matches"))
    out = scored.join(lists, "seq", "left")
    return out.withColumn("algorithm_matches", F.coalesce("algorithm_matches", F.array().cast(lists.schema["algorithm_matches"].dataType)))


def detail_url(host: str = "https://www.nowcoder.com") -> Column:
    """A post's page."""
    return F.when((F.col("detail_api_type") == "content-data") & (F.length("id") > 0), F.concat(F.lit(f"{host}/discuss/"), F.col("id"))).otherwise(F.concat(F.lit(f"{host}/feed/main/detail/"), F.coalesce("uuid", F.lit(""))))


@dataclass(frozen=True)
class Outcome:
    selected: DataFrame
    rejected: DataFrame


def select_posts(posts: DataFrame, rules: Rules = Rules(), q: Quality = Quality(), s: Selection = Selection(), library: quality.Library | quality.LibraryTables | None = None, mode: str = "pool", counts: stats.RunCounts | None = None) -> Outcome:
    """Scored posts of each keyword: "pool" the best of all, "early" those up to the batch
    that fills the pool, "elastic" with the moving limit, "first" the first that pass."""
    scored = quality.evaluate(posts, q, rules, library).withColumn("content_chars", F.col("breakdown.content_chars"))
    scored = counts.at("scored", scored) if counts else scored
    chosen = {
        "pool": lambda: rank.top_pool(scored, s.pool, only="passed"),
        "early": lambda: rank.early_stop_pool(scored, s),
        "elastic": lambda: rank.elastic_pool(scored, s),
        "first": lambda: rank.first_rows(scored, s.items, only="passed"),
    }[mode]()
    return Outcome(chosen, scored.where("not passed"))


def clean(posts: DataFrame, entries: DataFrame, companies: DataFrame, per_keyword: int = 0, drop_unknown: bool = True, lookups: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Archive rows of posts(seq, id, title, keyword, url, content, ...): markup gone, the
    organisation found, a quota a keyword; `is_kept` and `is_dropped` say what became of each.
    `seq` must tell posts apart. Names and quota are found on titles alone; the contents are
    shuffled once, when what was found is joined back. lookups: (verified, owners) as
    entity.dynamic_candidates takes them, for titles beyond the dictionary."""
    titles = posts.select("seq", "title", "keyword")
    found = entity.candidates(titles.select("seq", "title"), entries, only=companies)
    if lookups:
        found = found.unionByName(entity.dynamic_candidates(titles, *lookups))
    named = entity.best_company(titles, found).select("seq", "keyword", "company")
    kept = (F.col("company") != entity.UNKNOWN) if drop_unknown else F.lit(True)
    flags = rank.running_quota(named, per_keyword or (1 << 31) - 1, kept).drop("keyword")
    out = posts.join(flags.hint("merge"), "seq").withColumn("content", text.archive_content(F.col("content")))
    if "comments" in posts.columns:
        out = out.withColumn("comments", text.archive_content(F.array_join("comments", "\n")))
    return out


#: The archive's columns.
COLUMNS = {"id": "ID", "title": "标题", "company": "公司", "keyword": "搜索关键词", "url": "帖子链接", "content": "正文", "comments": "评论及回复", "question_outline": "面试题清单", "annotations": "算法标注"}


def archive(rows: DataFrame, with_id: bool = False, with_comments: bool = False, with_outline: bool = False, with_annotations: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """Kept rows in the archive's columns, after those of order as they are."""
    wanted = [c for c, on in (("id", with_id), ("title", True), ("company", True), ("keyword", True), ("url", True), ("content", True), ("comments", with_comments), ("question_outline", with_outline), ("annotations", with_annotations)) if on]
    out = rows.where("is_kept")
    if with_outline:
        out = out.withColumn("question_outline", knowledge.outline_text(F.col("question_outline")))
    if with_annotations:
        out = out.withColumn("annotations", knowledge.annotations(F.col("algorithm_matches")))
    return out.select(*order, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(COLUMNS[c]) for c in wanted])


def rejected_sample(rows: DataFrame, most: int = 30) -> DataFrame:
    """The first rejected posts, for a report."""
    return rows.select("seq", "keyword", "title", "quality_score", "breakdown").orderBy("seq").limit(most)


def dropped_sample(rows: DataFrame, most: int = 30) -> DataFrame:
    """The first posts that cleaning dropped as of no known organisation, for a report."""
    return rows.where("is_dropped").select("seq", "keyword", "title", "company").orderBy("seq").limit(most)

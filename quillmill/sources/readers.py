"""Sources: search and detail records, comments, pages, dictionaries, rankings, caches.

Network services stay outside: their saved responses (JSON, HTML) are read as files, in
parallel; a paged service can be read live through `PagedSource`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import match, text
from ..operators import entity, order
from ..plans.config import Rules
from . import lookups
from .tables import cut

_PART = "struct<id:string,uuid:string,title:string,content:string>"
SEARCH = f"keyword string, page int, data struct<records:array<struct<data:struct<momentData:{_PART},contentData:{_PART}>>>>"
COMMENTS = "post_id string, page int, data struct<records:array<struct<content:string,replyList:array<struct<content:string>>>>>"
RANKING = "count int, page int, list array<struct<leetcode:struct<title:string,frontend_question_id:string,question_id:string,level:int,slug_title:string>,time:string,value:int>>"


def keyword_place(keywords: tuple[str, ...] | list[str], name: str = "keyword") -> Column:
    """A keyword's place in the list of those asked for; others come after, by name."""
    if not keywords:
        return F.lit(0)
    place = F.array_position(F.array(*[F.lit(k) for k in keywords]), F.coalesce(F.col(name), F.lit("")))
    return F.when(place > 0, place).otherwise(len(keywords) + 1)


def scan_ends(pages: DataFrame, most: int) -> DataFrame:
    """(keyword, last): the page with which a keyword's scan ends, of pages(keyword, page,
    records, matched): an empty one among the first `most`; after those, an empty one that
    follows a page without records or matches. Keywords that are read to their last page are
    missing. A keyword has a bounded number of pages; a page saved twice counts once."""
    once = pages.groupBy("keyword", "page").agg(F.max("records").alias("records"), F.max("matched").alias("matched"))
    at = Window.partitionBy("keyword").orderBy("page")
    numbered = once.withColumns({"_visit": F.row_number().over(at), "_before": F.lag("matched").over(at)})
    idle = F.coalesce((F.col("_visit") - 1 > most) & (F.col("_before") == 0), F.lit(False))
    return numbered.where((F.col("records") == 0) & ((F.col("_visit") <= most) | idle)).groupBy("keyword").agg(F.min("page").alias("last"))


def search_records(responses: DataFrame) -> DataFrame:
    """Records of search responses (SEARCH) that have both ids, with their place (page, at): the
    moment gives id, uuid and title, the content part the text."""
    rows = responses.select("keyword", "page", F.posexplode("data.records").alias("at", "r"))
    m, c = "r.data.momentData", "r.data.contentData"
    first = lambda name, a, b, empty="": F.coalesce(F.nullif(F.col(f"{a}.{name}"), F.lit("")), F.nullif(F.col(f"{b}.{name}"), F.lit("")), F.lit(empty))
    kind = F.when(F.length(f"{m}.uuid") > 0, "moment-data").otherwise("content-data")
    made = rows.select("page", "at", first("id", m, c).alias("id"), first("uuid", m, c).alias("uuid"), kind.alias("detail_api_type"), first("title", m, c, "untitled").alias("title"), "keyword", first("content", c, m).alias("search_content"))
    return made.where("id <> '' and uuid <> ''")


def search_posts(responses: DataFrame, keywords: tuple[str, ...] | list[str] = (), most_pages: int | None = None, rules: Rules = Rules()) -> DataFrame:
    """Posts of search responses (SEARCH) in the order of keywords, pages and records, which
    `seq` counts from 1: one number a post over all keywords. With most_pages, a keyword's scan
    ends as scan_ends says; a page matches with the posts that pass the rules there first."""
    found = search_records(responses)
    if most_pages is not None:
        t, c = text.normalize(F.col("title"), rules.normalization), text.normalize(F.col("search_content"), rules.normalization)
        good = found.withColumns({"_t": t, "_c": c}).where(match.title_passes(F.col("_t"), rules) & match.relevant(F.col("_t"), F.col("_c"), rules))
        hits = good.groupBy("keyword", "id", "uuid").agg(F.min("page").alias("page")).groupBy("keyword", "page").agg(F.count("*").alias("matched"))
        pages = responses.select("keyword", "page", F.coalesce(F.size("data.records"), F.lit(0)).alias("records"))
        pages = pages.withColumn("records", F.greatest("records", F.lit(0))).join(hits, ["keyword", "page"], "left").fillna(0, ["matched"])
        ends = scan_ends(pages, most_pages).select(F.col("keyword").alias("_keyword"), "last")
        found = found.join(ends, F.col("keyword").eqNullSafe(F.col("_keyword")), "left").where("last is null or page < last").drop("_keyword", "last")
    placed = order.numbered(found.withColumn("_k", keyword_place(keywords)), "_k", "keyword", "page", "at", "id", "uuid", name="seq")
    return placed.select("seq", "id", "uuid", "detail_api_type", "title", "keyword", "search_content", "page", "at")


def arrival(posts: DataFrame, keywords: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """posts(seq, keyword, id, uuid, ...) with `seq` made unique: saved scans may count each
    keyword, or each run, from the start. Order: keywords, then the old number, then the ids."""
    own = [c for c in posts.columns if c != "seq"]
    rows = posts.withColumnRenamed("seq", "_old").withColumn("_k", keyword_place(keywords))
    return order.numbered(rows, "_k", "keyword", "_old", "id", "uuid", name="seq").select("seq", *[F.col(f"`{c}`") for c in own])


def flat_comments(responses: DataFrame) -> DataFrame:
    """(post_id, comments): each comment, then its replies; with the page where there is one."""
    one = F.transform("data.records", lambda r: F.concat(F.array(r["content"]), F.transform(F.coalesce(r["replyList"], F.array().cast("array<struct<content:string>>")), lambda x: x["content"])))
    page = [c for c in ("page",) if c in responses.columns]
    return responses.select("post_id", *page, F.filter(F.flatten(one), lambda x: F.length(x) > 0).alias("comments"))


def initial_state(page: Column) -> Column:
    """Content in the state that a page embeds as JSON, percent-encoded or quoted twice; null
    if there is none."""
    raw = F.nullif(F.regexp_extract(text.or_empty(page), r"(?s)window\.__INITIAL_STATE__\s*=\s*(.*?)\s*;?\s*</script>", 1), F.lit(""))
    plain = F.when(raw.contains("%7B") | raw.contains("%22"), F.try_url_decode(raw)).otherwise(raw)
    # A doubly quoted value is a JSON string that holds JSON.
    plain = F.when(F.startswith(plain, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), plain, F.lit("}")), "$.v")).otherwise(plain)
    entry = "struct<ssrCommonData:struct<contentData:struct<content:string>,momentData:struct<content:string>>>"
    values = F.map_values(F.from_json(plain, f"prefetchData map<string,{entry}>")["prefetchData"])
    found = F.transform(values, lambda v: F.coalesce(F.nullif(v["ssrCommonData"]["contentData"]["content"], F.lit("")), F.nullif(v["ssrCommonData"]["momentData"]["content"], F.lit(""))))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


#: Classes of the element that holds a post, in order of preference.
POST_CLASSES = ("feed-content-text", "nc-slate-editor-content", "nc-post-content", "post-content", "feed-content", "content-box")


def dom_text(page: Column, classes: tuple[str, ...] = POST_CLASSES, tag: str = "div") -> Column:
    """Text of the first element of the first class that there is, its pieces joined by
    spaces. Uses the standard parser in an Arrow function."""
    @F.pandas_udf("string")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: element_text(p or "", tag, classes))

    return found(page)


def element_text(page: str, tag: str, classes: tuple[str, ...]) -> str:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        """Pieces of text of the first element of each class."""

        def __init__(self) -> None:
            super().__init__(convert_charrefs=True)
            self.level = 0
            self.open: dict[str, int] = {}
            self.found: dict[str, list[str]] = {}

        def handle_starttag(self, name: str, attrs: list) -> None:
            if name == tag:
                self.level += 1
                for c in (dict(attrs).get("class") or "").split():
                    if c in classes and c not in self.found:
                        self.found[c], self.open[c] = [], self.level

        def handle_endtag(self, name: str) -> None:
            if name == tag and self.level:
                self.open = {c: k for c, k in self.open.items() if k < self.level}
                self.level -= 1

        def handle_data(self, data: str) -> None:
            for c in self.open:
                self.found[c] += [data.strip()] if data.strip() else []

    reader = Reader()
    reader.feed(page)
    reader.close()
    return next((" ".join(reader.found[c]) for c in classes if c in reader.found), "")


def page_tags(page: Column) -> Column:
    """Texts of the links that a page marks as tags."""
    found = F.regexp_extract_all(text.or_empty(page), F.lit(r'(?is)<a[^>]*class="[^"]*discuss-tag-item[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    return F.filter(F.transform(found, lambda x: text.strip(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: F.length(x) > 0)


def detail_content(api: Column, page: Column) -> Column:
    """A post's content: from the service, else from the page's state, else from its elements."""
    full = F.coalesce(F.nullif(api, F.lit("")), initial_state(page), F.nullif(dom_text(page), F.lit("")))
    return F.replace(full, F.lit("​"), F.lit(""))


def ranking_end(responses: DataFrame) -> int | None:
    """The page with which a scan of ranking responses ends: an empty one, or the one that brings
    the named entries to the number that the first page says there are; None if neither comes.
    Entries are counted over ranges of pages."""
    named = F.size(F.filter("list", lambda x: F.length(text.strip(text.or_empty(x["leetcode"]["title"]))) > 0))
    pages = cut(responses.groupBy("page").agg(F.max("count").alias("count"), F.max(F.size("list")).alias("rows"), F.max(named).alias("named")))
    said = pages.agg(F.min_by("count", "page").alias("n")).first()["n"] or 0
    counted = order.running(pages.withColumn("_all", F.lit(0)), "_all", ["page"], {"_sum": F.greatest("named", F.lit(0))})
    ends = (F.coalesce("rows", F.lit(0)) <= 0) | ((F.lit(said) > 0) & (F.col("_sum") >= said))
    return counted.where(ends).agg(F.min("page").alias("page")).first()["page"]


def ranking(responses: DataFrame, source: str = "codetop", whole: bool = True) -> DataFrame:
    """Raw entries of ranking responses (RANKING); `seq` counts them from 1 in the order of pages
    and rows. whole: all pages; else up to where a scan ends."""
    if not whole:
        last = ranking_end(responses)
        responses = responses if last is None else responses.where(F.col("page") <= last)
    rows = responses.select("page", F.posexplode("list").alias("at", "x"))
    slug = F.col("x.leetcode.slug_title")
    url = F.when(F.length(slug) > 0, F.concat(F.lit("https://leetcode.cn/problems/"), slug)).otherwise("")
    number = F.coalesce(text.positive(F.col("x.leetcode.frontend_question_id")), text.positive(F.col("x.leetcode.question_id")))
    made = rows.select(
        "page", "at", number.alias("id"), F.coalesce("x.leetcode.frontend_question_id", F.lit("")).alias("frontend_id"),
        text.strip(text.or_empty(F.col("x.leetcode.title"))).alias("title"), text.difficulty_of_level(F.col("x.leetcode.level")).alias("difficulty"),
        text.day_of(F.col("x.time")).alias("last_date"), F.col("x.value").alias("frequency"), url.alias("url"), F.lit(source).alias("source"),
    ).where("title <> ''")
    placed = order.numbered(made, "page", "at", "title", "frontend_id", name="seq")
    return placed.select("seq", "id", "frontend_id", "title", "difficulty", "last_date", "frequency", "url", "source")


def ranking_list(content: str, source: str = "raw_alg_md") -> list[dict]:
    """Entries of a written list. A block starts with "N. title"; the next line may name the
    difficulty and a link, then a date and a frequency may follow. Blank lines do not count."""
    # The patterns below.
    import re

    rows = [x.strip() for x in content.replace("\ufeff", "").splitlines()]
    rows = [x for x in rows if x]
    out: list[dict] = []
    at = 0

    def taken(pattern: str) -> str:
        nonlocal at
        if at < len(rows) and re.fullmatch(pattern, rows[at]):
            at += 1
            return rows[at - 1]
        return ""

    while at < len(rows):
        head = re.match(r"^(.+?)\.\s*(.+)$", rows[at])
        at += 1
        if not head:
            continue
        about = rows[at] if at < len(rows) else ""
        at += 1
        level = re.search("简单|容易|中等|困难|easy|medium|hard", about, re.IGNORECASE)
        link = re.search(r"https?://\S+", about)
        day, frequency = taken(r"\d{4}-\d{2}-\d{2}"), taken(r"\d+")
        out.append({
            "seq": len(out), "id": int(head[1]) or None if head[1].strip().isdigit() else None, "frontend_id": head[1].strip(), "title": head[2].strip(), "difficulty": text.DIFFICULTY_NAMES[level[0].lower()] if level else "",
            "last_date": day, "frequency": int(frequency or 0), "url": link[0] if link else "", "source": source,
        })
    return out


ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk")


def decoded(body: bytes) -> str:
    """Text in the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return body.decode(name)
        except UnicodeDecodeError:
            continue
    return body.decode("utf-8", "replace")


#: Columns of a written list's entries, in the order in which the table function gives them.
LIST_ENTRY = "at int, id int, frontend_id string, title string, difficulty string, last_date string, frequency int, url string"


@F.udtf(returnType=LIST_ENTRY)
class ListEntries:
    """Table function: the entries of one written list, given as bytes."""

    def eval(self, body: bytes):
        for x in ranking_list(decoded(bytes(body or b""))):
            yield x["seq"], x["id"], x["frontend_id"], x["title"], x["difficulty"], x["last_date"], x["frequency"], x["url"]


def listed_entries(files: DataFrame, source: str = "raw_alg_md") -> DataFrame:
    """Entries of files(path, content), each parsed where it was read; `seq` counts them from 1
    in the order of paths and places. A file is one task's, a folder is many tasks'."""
    spark = files.sparkSession
    spark.udtf.register("list_entries", ListEntries)
    rows = spark.sql("select f.path, e.* from {files} f, lateral list_entries(f.content) e", files=files)
    placed = order.numbered(rows, "path", "at", name="seq")
    return placed.select("seq", "id", "frontend_id", "title", "difficulty", "last_date", "frequency", "url", F.lit(source).alias("source"))


def written_lists(spark: SparkSession, path: str, source: str = "raw_alg_md") -> DataFrame:
    """Entries of the written lists in a file, or in the files of a folder."""
    return listed_entries(spark.read.format("binaryFile").load(path).select("path", "content"), source)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary of organisations (a JSON list), plausible names only."""
    names = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("company"))
    return names.select(text.strip(F.col("company")).alias("company")).where(entity.plausible_name(F.col("company"))).distinct()


def algorithm_library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Parts of a library: markers, topics (categories among them), titles, ids (1 to 9999) and hot
    entries. A library is one JSON document, or rows as sinks.save_library_rows writes them."""
    head = spark.read.text(path).first()
    if head and head[0].startswith('{"kind":'):
        rows = spark.read.schema("kind string, place long, id int, title string, difficulty string, frequency int, url string").json(path)
        of = lambda kind, *c: rows.where(F.col("kind") == kind).select(F.col("place").alias("seq"), *c)
        none = spark.createDataFrame([], "seq long, word string")
        return {"markers": none, "topics": none, "titles": of("title", "title"), "ids": of("id", "id").where("id between 1 and 9999"), "hot": of("entry", "id", "title", "frequency", "difficulty", "url")}
    hot = "struct<id:string,frontend_id:string,title:string,frequency:string,count:string,difficulty:string,last_date:string,url:string,link:string,source:string>"
    schema = f"markers array<string>, categories array<string>, topic_keywords array<string>, problem_titles array<string>, problem_ids array<int>, interview_hot_problems array<{hot}>"
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("x"))
    part = lambda c, name: one.select(F.posexplode(f"x.{c}").alias("seq", name))
    return {
        "markers": part("markers", "word"), "topics": one.select(F.posexplode(F.concat(*[F.coalesce(f"x.{c}", F.array().cast("array<string>")) for c in ("categories", "topic_keywords")])).alias("seq", "word")), "titles": part("problem_titles", "title"),
        "ids": part("problem_ids", "id").where("id between 1 and 9999"), "hot": part("interview_hot_problems", "x").select("seq", "x.*"),
    }


def lookup_cache(spark: SparkSession, path: str, kind: str, most: int = 20_000, most_values: int = 20, value: str = "array<string>") -> DataFrame:
    """A saved lookup (token, value, at): the last rows, lists cut to most_values."""
    rows = lookups.read(spark, path, kind, value).orderBy(F.desc("at"), "token").limit(most)
    return rows.withColumn("value", F.slice("value", 1, most_values)) if value.startswith("array") else rows


class _Page(InputPartition):
    def __init__(self, page: int):
        self.page = page


class PagedSource(DataSource):
    """Pages of a service as rows (page, body). `url` holds {page}; `pages` says how many;
    failed requests are tried again `retries` times with growing pauses."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Page(k) for k in range(1, int(self.options.get("pages", "1")) + 1)]

    def read(self, partition):
        yield partition.page, fetched(self.options["url"].format(page=partition.page), int(self.options.get("retries", "2")), float(self.options.get("timeout", "15")))


def fetched(url: str, retries: int = 2, timeout: float = 15) -> str:
    """The text at a URL. Overload, errors of the server and no answer at all are tried again,
    with growing pauses."""
    import time
    import urllib.error
    import urllib.request

    for k in range(retries + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except (urllib.error.URLError, TimeoutError) as e:  # an answer with a code, or none at all
            code = getattr(e, "code", None)
            if code is not None and code != 429 and code < 500 or k == retries:
                raise
            time.sleep(min(2**k, 30 if code == 429 else 10))
    raise AssertionError("not reached")


def owner_aliases(over: dict[str, str] | None = None) -> dict[str, str]:
    """Built-in owners of products with a configuration's own laid on top."""
    return entity.OWNER_ALIASES | {k.strip(): v.strip() for k, v in (over or {}).items() if k.strip() and v.strip()}



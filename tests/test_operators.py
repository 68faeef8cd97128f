"""Operators whose results depend on order, against plain Python; sources, sinks, streams."""

import heapq
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmill.operators import entity, knowledge, posts, quality, rank, stats
from quillmill.functions import text
from quillmill.plans import config
from quillmill.sources import lookups, paged, readers, reports, sinks
from quillmill.streaming import posts as streams


def plain_pool(rows, s):
    heap, limit, idle, repl, n = [], s.pool, 0, 0, 0
    for r in rows:
        n += 1
        if r["passed"]:
            key = (r["quality_score"], r["content_chars"], r["id"])
            if len(heap) < limit:
                heapq.heappush(heap, key)
            elif key > heap[0]:
                heapq.heapreplace(heap, key)
                repl += 1
        if n % s.batch == 0:
            if repl >= s.replace_threshold and limit < s.pool_max:
                limit, idle = min(limit + s.pool_step, s.pool_max), 0
            else:
                idle += 1
                if limit > s.pool and idle >= s.idle_rounds:
                    limit, idle = max(limit - s.pool_step, s.pool), 0
                    while len(heap) > limit:
                        heapq.heappop(heap)
            repl = 0
            if not s.fill_quota and len(heap) >= limit:
                break
    return sorted(heap, reverse=True)


@pytest.mark.parametrize("fill", [True, False])
def test_elastic_pool(spark, fill):
    r = random.Random(3)
    rows = [{"seq": i, "id": str(i), "keyword": f"k{i % 3}", "quality_score": min(100, i // 8 + r.randrange(40)), "content_chars": r.randrange(500), "passed": r.random() < 0.8} for i in range(600)]
    s = config.Selection(items=6, fill_quota=fill)
    got = {}
    for x in rank.elastic_pool(spark.createDataFrame(rows).repartition(5), s).collect():
        got.setdefault(x["keyword"], []).append((x["rank"], (x["quality_score"], x["content_chars"], x["id"])))
    for k in ("k0", "k1", "k2"):
        assert [v for _, v in sorted(got[k])] == plain_pool([x for x in rows if x["keyword"] == k], s)


def test_quota_counts_dropped_before_it_is_full(spark):
    rows = spark.createDataFrame([(0, "k", "x"), (1, "k", "ok"), (2, "k", "x"), (3, "k", "ok")], "seq long, keyword string, company string")
    out = {r["seq"]: (r["is_kept"], r["is_dropped"]) for r in rank.running_quota(rows, 1, F.col("company") == "ok").collect()}
    assert out == {0: (False, True), 1: (True, False), 2: (False, False), 3: (False, False)}


def test_page_order(spark):
    pages = spark.range(1, 11).select(F.col("id").cast("int").alias("page"))
    order = lambda s: [r["page"] for r in rank.page_schedule(pages, s).orderBy("visit").collect()]
    assert order("best_first") == [1, 2, 3, 4, 9, 5, 10, 6, 7, 8]
    assert order("dfs") == list(range(10, 0, -1)) and order("bfs") == list(range(1, 11))


def test_merge_of_entries(spark):
    rows = [(0, 1, "A", 5, "x", ""), (1, None, "a ", 9, "y", "u"), (2, 2, "b", 3, "x", ""), (3, 2, "B2", 4, "y", ""), (4, None, "b2", 1, "z", "v"), (5, None, "c", 2, "x", "")]
    df = spark.createDataFrame(rows, "seq long, id int, title string, frequency int, source string, url string").repartition(3)
    out = {r["title"]: r for r in knowledge.merge(knowledge.entries(df)).collect()}
    assert (out["a"]["id"], out["a"]["frequency"], out["a"]["url"], out["a"]["source"]) == (1, 9, "u", "y,x")
    assert (out["B2"]["id"], out["B2"]["frequency"], out["B2"]["source"], out["B2"]["url"]) == (2, 4, "y,x,z", "v")
    assert out["c"]["url"].endswith("=c") and len(out) == 3


def test_company_of_titles(spark):
    rows = [(1, "字节跳动后端一面"), (2, "【美团】后端"), (3, "鹅厂面经"), (4, "无名小站"), (5, "mongo 开发"), (6, None)]
    titles = spark.createDataFrame(rows, "seq long, title string")
    entries = entity.dictionary(spark, ["字节", "美团", "腾讯", "go"])
    known = spark.createDataFrame([("字节",), ("美团",), ("腾讯",), ("go",)], "company string")
    found = entity.candidates(titles, entries, only=known)
    got = {r["seq"]: r["company"] for r in entity.best_company(titles, found).collect()}
    assert got == {1: "字节", 2: "美团", 3: "腾讯", 4: "其他", 5: "其他", 6: "其他"}


def test_whole_evaluation(spark):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 的 原理 {i}" for i in range(1, 10))
    rows = [(1, "后端面经", body, ["#内推"]), (2, "短", "短", None), (3, "训练营", "简历优化 卖课", [])]
    df = spark.createDataFrame(rows, "seq long, title string, content string, tags array<string>")
    rules = config.Rules(must=("面经", "后端", "mysql"))
    library = quality.Library([{"id": 1, "title": "两数之和", "frequency": 99}], titles=["最长子串"], rules=rules)
    got = {r["seq"]: r for r in quality.evaluate(df, rules=rules, library=library).collect()}
    assert got[1]["question_outline_count"] == 9 and got[1]["breakdown"]["structure_score"] == 50
    assert got[1]["quality_score"] > got[2]["quality_score"] and 0 <= got[3]["quality_score"] <= 100
    assert got[3]["breakdown"]["promo_blocked"] and not got[3]["passed"]


def test_selection_modes_agree_with_passed(spark):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 {i}" for i in range(1, 9))
    rows = [(i, str(i), f"后端面经{i}", "k", body if i % 2 else "短") for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, id string, title string, keyword string, content string")
    rules = config.Rules(must=("面经", "mysql"))
    for mode in ("pool", "early", "elastic", "first"):
        out = posts.select_posts(df, rules, config.Quality(threshold=40), config.Selection(items=4), mode=mode)
        assert all(r["passed"] for r in out.selected.collect()) and out.rejected.where("passed").count() == 0


# ---------------------------------------------------------------- sources and sinks


def test_layers(tmp_path):
    (tmp_path / "advanced.template.json").write_text(json.dumps({"a": {"x": 1, "y": [1]}, "b": 1}))
    (tmp_path / "app.json").write_text(json.dumps({"a": {"y": [2]}, "b": 0}))
    (tmp_path / "local.override.json").write_text("broken")
    assert config.load(tmp_path) == {"a": {"x": 1, "y": [2]}, "b": 0}
    s = config.settings({"filter_rules": {"score_filter": {"threshold": 0, "weighted_keywords": [{"keyword": "k", "weight": 0, "count": "repeat"}]}}})
    assert s.quality.threshold == 0 and s.quality.keywords[0].repeated


def test_search_and_comments(spark):
    raw = {"keyword": "k", "page": 1, "data": {"records": [{"data": {"momentData": {"id": "1", "uuid": "u", "title": "t", "content": "m"}, "contentData": {"id": "9", "content": "c"}}}, {"data": {"contentData": {"id": "2", "uuid": "v", "title": "t2", "content": "c2"}}}, {"data": {"contentData": {"id": "3", "title": "no uuid"}}}, {"data": {}}]}}
    df = spark.read.schema(readers.SEARCH).json(spark.sparkContext.parallelize([json.dumps(raw)]))
    rows = readers.search_posts(df).orderBy("seq").collect()
    assert [(r["id"], r["title"], r["search_content"], r["detail_api_type"]) for r in rows] == [("1", "t", "c", "moment-data"), ("2", "t2", "c2", "content-data")]
    raw = {"post_id": "p", "data": {"records": [{"content": "a", "replyList": [{"content": "b"}, {"content": ""}]}, {"content": "c"}]}}
    df = spark.read.schema(readers.COMMENTS).json(spark.sparkContext.parallelize([json.dumps(raw)]))
    assert readers.flat_comments(df).first()["comments"] == ["a", "b", "c"]


def test_pages(spark):
    html = '<div class="x">no</div><div class="post-content">a<br>b<div>c</div> &amp; d</div><div class="post-content">z</div><a class="discuss-tag-item" href="#"> t1 </a>'
    df = spark.createDataFrame([(html,), (None,), ("<p>x",)], "h string")
    assert [r[0] for r in df.select(readers.dom_text(F.col("h"))).collect()] == ["a b c & d", "", ""]
    assert df.select(readers.page_tags(F.col("h"))).first()[0] == ["t1"]


def test_written_list_and_encodings(tmp_path):
    rows = readers.ranking_list("﻿1. 两数之和\n\n简单 https://x.y/z\n2024-01-02\n12\n2. b\nhard\nnoise\n3. c\n中等\n7\n")
    assert [(r["id"], r["title"], r["difficulty"], r["last_date"], r["frequency"], r["url"]) for r in rows] == [(1, "两数之和", "容易", "2024-01-02", 12, "https://x.y/z"), (2, "b", "困难", "", 0, ""), (3, "c", "中等", "", 7, "")]
    assert readers.decoded("中文".encode("gb18030")) == "中文" == readers.decoded("中文".encode())


def test_written_lists_of_a_folder(spark, tmp_path):
    (tmp_path / "b.md").write_bytes("1. 二\n中等\n7\n".encode("gb18030"))
    (tmp_path / "a.md").write_text("9. x\nhard\n2024-01-02\n3\n10. y\n")
    (tmp_path / "c.md").write_text("")
    got = readers.written_lists(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["seq"], r["id"], r["title"], r["difficulty"], r["frequency"]) for r in got] == [(1, 9, "x", "困难", 3), (2, 10, "y", "", 0), (3, 1, "二", "中等", 7)]
    one = readers.written_lists(spark, str(tmp_path / "b.md")).collect()
    assert [r["title"] for r in one] == ["二"]


def test_paged_source(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"p{k}.json").write_text(f'{{"n": {k}}}')
    spark.dataSource.register(readers.PagedSource)
    rows = spark.read.format("paged").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", "2").load()
    assert sorted((r["page"], json.loads(r["body"])["n"]) for r in rows.collect()) == [(1, 1), (2, 2)]


def test_paged_stream_ends_and_goes_on(spark, tmp_path):
    """Pages served from files: an empty one ends the scan, a restart reads no page twice."""
    spark.dataSource.register(paged.PagedStream)

    def serve(page, n):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"data": {"records": [{"id": f"{page}-{i}"} for i in range(n)]}}))

    def run():
        stream = spark.readStream.format("paged_stream").option("url", f"file://{tmp_path}/p{{page}}.json").option("pages", "2").option("most", "7").load()
        query = streams.to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(60)
        return sorted(r["page"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for page in (1, 2):
        serve(page, 2)
    serve(3, 2), serve(4, 0), serve(5, 2)
    seen = run()
    while len(now := run()) > len(seen):
        seen = now
    assert seen == [1, 2, 3]
    reader = paged.PagedStreamReader({"url": f"file://{tmp_path}/p{{page}}.json", "pages": "2"})
    assert [p for p, _ in reader.readBetweenOffsets({"page": 1}, {"page": 3})] == [1, 2] and [p for p, _ in reader.readBetweenOffsets({"page": 3}, {"page": 0})] == [3]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(["字节", " 美团 ", "面经", "7"], ensure_ascii=False))
    assert {r[0] for r in readers.companies(spark, str(tmp_path / "c.json")).collect()} == {"字节", "美团"}
    known = spark.createDataFrame([("字节",)], "company string")
    new = spark.createDataFrame([("字节",), ("新厂",)], "company string")
    assert [r[0] for r in sinks.add_companies(known, new, str(tmp_path / "out")).collect()] == ["新厂"]
    lookups.upsert(spark.createDataFrame([("t", ["a"] * 30, 1)], "token string, value array<string>, at long"), str(tmp_path), "s")
    assert len(readers.lookup_cache(spark, str(tmp_path), "s").first()["value"]) == 20


def test_lookups_are_read_while_written(spark, tmp_path):
    path, schema = str(tmp_path), "token string, value string, at long"
    rows = lambda *x: spark.createDataFrame(x, schema)
    known = lambda: {r["token"]: r["value"] for r in lookups.read(spark, path, "k", "string").collect()}
    assert known() == {}
    want = {}
    for n in range(lookups.UPSERTS + 3):
        before = lookups.read(spark, path, "k", "string")  # planned before the write, run after it
        lookups.upsert(rows((f"t{n % 4}", f"v{n}", n), ("old", "x", -n)), path, "k", "string")
        assert {r["token"]: r["value"] for r in before.collect()} == want
        want = want | {f"t{n % 4}": f"v{n}", "old": "x"}
        assert known() == want
    kinds = [k for _, k, _ in lookups.versions(spark, f"{path}/k")]
    assert kinds.count("all") == 1 and len(kinds) > 1
    lookups.upsert(lookups.read(spark, path, "k", "string").withColumn("value", F.upper("value")).withColumn("at", F.lit(99)), path, "k", "string")
    assert known() == {k: v.upper() for k, v in want.items()}
    (tmp_path / "k" / f"v{10**9:010}-new-ab").mkdir()  # a writer that has not finished
    assert known() == {k: v.upper() for k, v in want.items()}
    lookups.compact(spark, path, "k", "string")
    lookups.compact(spark, path, "k", "string")
    assert known() == {k: v.upper() for k, v in want.items()}


def test_reports_and_library(spark, tmp_path):
    rows = spark.createDataFrame([(2, "t2", "b"), (1, "t1", "# a")], "seq long, title string, content string").withColumnsRenamed({k: v for k, v in posts.COLUMNS.items() if k in ("title", "content")})
    at = datetime(2024, 5, 6)
    out = sinks.export(rows, str(tmp_path), "r", ["MD", "text", "parquet"], at=at)
    assert all("/2024/05/06/" in p for p in out.values())
    report = reports.read_report(out["md"])
    assert report.startswith("# Report\n\nRows: 2\n")
    assert report.index("## t1") < report.index("## t2") and "# a" not in report.replace("## a", "")
    with pytest.raises(ValueError, match="unknown format"):
        sinks.export(rows, str(tmp_path), "r", ["pdf"])
    entries = knowledge.entries(spark.createDataFrame([(0, 1, "A", 5), (1, 20000, "B", 9)], "seq long, id int, title string, frequency int"))
    sinks.save_library(knowledge.slim(entries), str(tmp_path / "lib"))
    lib = json.loads(spark.read.text(str(tmp_path / "lib")).first()[0])
    assert lib["problem_ids"] == [1] and lib["problem_titles"] == ["B", "A"]
    parts = readers.algorithm_library(spark, str(tmp_path / "lib"))
    assert parts["hot"].count() == 2 and parts["ids"].first()["id"] == 1
    sinks.save_library_rows(knowledge.slim(entries), str(tmp_path / "rows"))
    parts = readers.algorithm_library(spark, str(tmp_path / "rows"))
    assert [r["title"] for r in parts["titles"].orderBy("seq").collect()] == ["B", "A"] and [r["id"] for r in parts["ids"].collect()] == [1]
    assert [(r["title"], r["frequency"]) for r in parts["hot"].orderBy("seq").collect()] == [("B", 9), ("A", 5)]


def test_a_report_is_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = lambda n: spark.range(n).select((F.lit(n) - F.col("id")).alias("seq"), F.concat(F.lit("row "), F.lit(n) - F.col("id")).alias("value")).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.save_report(rows(50), "{rows} rows", path, "txt")
        assert len(list((tmp_path / "r").glob("part-*"))) > 2
        assert reports.read_report(path).splitlines() == ["50 rows", *(f"row {i}" for i in range(1, 51))]
        bad = rows(40).withColumn("value", F.when(F.col("seq") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
        with pytest.raises(Exception, match="broken"):
            reports.save_report(bad, "{rows} rows", path, "txt")
        assert reports.read_report(path).startswith("50 rows") and not list((tmp_path / "r").glob("_staged*"))
        with pytest.raises(Exception, match="broken"):
            reports.save_report(bad, "{rows} rows", str(tmp_path / "new"), "txt")
        assert not list((tmp_path / "new").glob("*"))
        reports.save_report(rows(0), "{rows} rows", path, "txt")
        assert reports.read_report(path) == "0 rows\n"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tokens_and_owners(spark):
    titles = spark.createDataFrame([("星云科技 后端 一面 面经",), ("字节 一面",)], "title string")
    known = spark.createDataFrame([("x",)], "token string")
    pending = {r["token"] for r in entity.pending_tokens(titles, known).collect()}
    assert "星云科技" in pending
    entries = spark.createDataFrame([("腾讯", "腾讯", "known_company", 100, 0)], "alias string, company string, source string, weight int, rule int")
    lookups = spark.createDataFrame([("小鹅", ["小鹅是腾讯旗下的", "小鹅"])], "token string, arr array<string>")
    got = entity.infer_owner(lookups, entries).collect()
    assert [(r["company"], r["score"]) for r in got] == [("腾讯", 5)]


def test_lookups_beyond_the_dictionary(spark):
    titles = spark.createDataFrame([(1, "星云科技 后端 一面"), (2, "小鹅直播 面经"), (3, "甲乙 一面")], "seq long, title string")
    entries = spark.createDataFrame([("腾讯", "腾讯", "known_company", 100, 0)], "alias string, company string, source string, weight int, rule int")
    pending = titles.select(F.explode(entity.title_tokens(F.col("title"))).alias("token"))
    said = spark.createDataFrame([("星云科技", ["星云科技有限公司"]), ("小鹅直播", ["小鹅直播是腾讯旗下的", "小鹅直播 属于腾讯"])], "token string, arr array<string>")
    verified, owners = entity.refresh_lookups(pending, said, entries)
    assert {r["token"]: r["is_company"] for r in verified.collect()} == {"星云科技": True, "小鹅直播": False, "甲乙": False}
    found = entity.dynamic_candidates(titles, verified, owners)
    assert {r["seq"]: r["company"] for r in entity.best_company(titles, found).collect()} == {1: "星云科技", 2: "腾讯", 3: "其他"}
    assert config.stable_hash({"a": 1, "b": 2}) == config.stable_hash({"b": 2, "a": 1})


def test_timings(spark):
    a = spark.createDataFrame([("s", 1.0)], "stage string, seconds double")
    b = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("t", 2.0)], "stage string, seconds double")
    out = {r["stage"]: (r["total"], r["n"]) for r in stats.timing_change(stats.stage_timing(a), stats.stage_timing(b)).collect()}
    assert out == {"s": (3.0, 1), "t": (2.0, 1)}


# ---------------------------------------------------------------- streams


def test_stream_quota_and_duplicates(spark, tmp_path):
    schema = "seq long, keyword string"
    for k in range(3):
        spark.createDataFrame([(10 * k + i, "a" if i % 2 else "b") for i in range(6)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{k}"))
    folder = str(tmp_path / "in" / "*")
    stream = streams.read_posts(spark, folder, schema)
    seen = []
    streams.run(streams.quota(stream, 4), lambda df, k: seen.extend(df.collect()), str(tmp_path / "c1")).awaitTermination()
    count = {k: sum(r["keyword"] == k for r in seen) for k in "ab"}
    assert count == {"a": 4, "b": 4}
    first = []
    streams.run(streams.first_seen(streams.read_posts(spark, folder, schema), "keyword"), lambda df, k: first.extend(df.collect()), str(tmp_path / "c2")).awaitTermination()
    assert sorted(r["keyword"] for r in first) == ["a", "b"]


def test_stream_errors_reach_the_caller(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))

    def fail(df, k):
        raise ValueError("stop here")

    with pytest.raises(Exception, match="stop here"):
        streams.run(streams.read_posts(spark, str(tmp_path / "in"), "id long"), fail, str(tmp_path / "c")).awaitTermination()


def test_gaps_are_filled_in_order_of_arrival(spark):
    schema = "seq long, id int, frontend_id string, title string, difficulty string, last_date string, frequency int, url string, source string"
    rows = [(1, None, "", "t", "", "", 3, "", "x"), (2, 5, "", "t", "a", "", 1, "", "y"), (3, 6, "", "t", "b", "d1", 2, "", "x"), (4, 7, "", "t", "", "", 9, "u", "z")]
    df = spark.createDataFrame(rows, schema)
    three = knowledge.keep_best(df.where("seq < 4"), F.col("title")).first()
    assert (three["frequency"], three["difficulty"], three["id"]) == (3, "a", None)
    whole = knowledge.merge(df).first()
    assert (whole["frequency"], whole["id"], whole["difficulty"], whole["last_date"], whole["url"], whole["source"]) == (9, 7, "a", "d1", "u", "z,x,y")


def test_entries_join_along_chains_of_numbers_and_titles(spark):
    schema = "seq long, id int, frontend_id string, title string, difficulty string, last_date string, frequency int, url string, source string"
    rows = [(1, 1, "", "a", "", "", 1, "", ""), (2, 1, "", "B", "", "", 2, "", ""), (3, 2, "", "b", "", "", 1, "", ""), (4, 2, "", "c", "", "", 5, "", ""), (5, None, "", "d", "", "", 1, "", ""), (6, None, "", "D ", "", "", 1, "", "")]
    got = knowledge.merge(spark.createDataFrame(rows, schema)).collect()
    assert [(r["title"], r["frequency"], r["id"]) for r in got] == [("c", 5, 2), ("d", 1, None)]


def test_titles_are_gated_before_longer_ones_hide_shorter_ones(spark):
    rules = config.Rules(normalization=config.Normalization(nfkc=False))
    q = config.Quality(alg_context=("手撕",))
    library = quality.Library([{"title": "最长子", "frequency": 5}], ["最长子串", "最长子"], [1], rules)
    rows = [("手撕 最长子 题。" + "x" * 40 + "最长子串", "第一题"), ("最长子串", "第1题"), ("手撕 最 长 子 串", "")]
    df = spark.createDataFrame(rows, "t string, raw string")
    got = [r["x"] for r in df.select(quality.algorithm_signal(F.col("t"), F.lit(""), F.col("raw"), q, rules, library).alias("x")).collect()]
    assert [(r["titles"], r["ids"], r["hot_titles"]) for r in got] == [(["最长子"], [], ["最长子"]), ([], [1], []), ([], [], [])]
    free = config.Quality(alg_context=())
    assert df.select(quality.algorithm_signal(F.col("t"), F.lit(""), F.col("raw"), free, rules, library)["titles"].alias("x")).collect()[2]["x"] == ["最长子串"]


def test_pattern_texts_are_parted_into_words():
    s = config.settings({"filter_rules": {"must_contain": ["a、b", "<c>"], "score_filter": {"weighted_keywords": ["x|y", {"keyword": "z w", "weight": 9}], "tail_drain_words": {"m,n": 2}}}})
    assert s.rules.must == ("a", "b", "c")
    assert [(k.keyword, k.weight) for k in s.quality.keywords] == [("x", 6), ("y", 6), ("z", 9), ("w", 9)]
    assert s.quality.tail_drain == (("m,n", 2),)  # keys of a map stay whole


@pytest.mark.parametrize("words, want", [(None, ()), ("a，b", ("a", "b")), (["a", None, "b c"], ("a", "b", "c")), (7, ())])
def test_forms_of_must_contain(words, want):
    assert config.settings({"filter_rules": {"must_contain": words}}).rules.must == want


@pytest.mark.parametrize("words, want", [(None, ()), ({"Ｍ,N": 2, "z": 0, "": 5}, (("m,n", 2),)), ("m，n", (("m", 6), ("n", 6))), (["m n", {"keyword": "p q", "penalty": "x"}, {"keyword": "m", "weight": 9}, 3], (("m", 9), ("n", 6), ("p q", 6)))])
def test_forms_of_drain_words(words, want):
    assert config.settings({"filter_rules": {"score_filter": {"tail_drain_words": words}}}).quality.tail_drain == want


@pytest.mark.parametrize("words, want", [(None, []), ({"a": 3, "b": "x"}, [("a", 3, "both"), ("b", 6, "both")]), ("a b", [("a", 6, "both"), ("b", 6, "both")]), ([{"keyword": "a", "weight": -2, "scope": "TITLE"}, {"keyword": "b", "scope": "q"}, 4, None], [("a", 0, "title"), ("b", 6, "both")])])
def test_forms_of_weighted_keywords(words, want):
    assert [(k.keyword, k.weight, k.scope) for k in config.settings({"filter_rules": {"score_filter": {"weighted_keywords": words}}}).quality.keywords] == want


@pytest.mark.parametrize("form", [{"TikTok": " Byte "}, [{"from": "TikTok", "to": "Byte"}, {"to": "x"}, "y"]])
def test_forms_of_aliases(spark, form):
    rules = config.settings({"filter_rules": {"normalization": {"semantic_aliases": form}}}).rules.normalization
    df = spark.createDataFrame([("TIKTOK 面经",)], "t string")
    assert df.select(text.normalize(F.col("t"), rules)).first()[0] == "byte 面经" == text.normalize_local("TIKTOK 面经", rules)


def test_switches_of_the_normal_form(spark):
    df = spark.createDataFrame([(" A，  b ",)], "t string")
    for punctuation, spaces, want in ((True, True, "a, b"), (False, True, "a， b"), (True, False, " a,  b "), (False, False, " a，  b ")):
        rules = config.settings({"filter_rules": {"normalization": {"enable_nfkc": False, "unify_punctuation": punctuation, "fold_spaces": spaces}}}).rules.normalization
        assert df.select(text.normalize(F.col("t"), rules)).first()[0] == want == text.normalize_local(" A，  b ", rules)


def test_settings_without_sections():
    assert config.settings({"filter_rules": None}) == config.settings({"filter_rules": {"score_filter": None, "normalization": [], "force_combine": None}})


def responses(spark, pages):
    """Search responses of {(keyword, page): ids of records}."""
    part = lambda i: {"id": i, "uuid": f"u{i}", "title": f"t {i}", "content": f"c {i}"}
    rows = [json.dumps({"keyword": k, "page": p, "data": {"records": [{"data": {"momentData": part(i)}} for i in ids]}}) for (k, p), ids in pages.items()]
    return spark.read.schema(readers.SEARCH).json(spark.sparkContext.parallelize(rows, 3))


def test_scan_numbers_are_unique_over_keywords(spark):
    pages = {("b", 1): ["1", "2"], ("a", 1): ["1", "3"], ("a", 2): ["4"], ("c", 1): ["5"]}
    rows = readers.search_posts(responses(spark, pages), ["b", "a"]).orderBy("seq").collect()
    assert [(r["seq"], r["keyword"], r["id"]) for r in rows] == [(1, "b", "1"), (2, "b", "2"), (3, "a", "1"), (4, "a", "3"), (5, "a", "4"), (6, "c", "5")]


def test_posts_of_two_keywords_keep_their_companies(spark):
    found = readers.search_posts(responses(spark, {("后端 面经", 1): ["字节", "x"], ("腾讯 面经", 1): ["美团", "腾讯"]}))
    rows = found.withColumns({"content": F.col("search_content"), "url": F.lit("")})
    known = spark.createDataFrame([("字节",), ("美团",), ("腾讯",)], "company string")
    got = posts.clean(rows, entity.dictionary(spark, ["字节", "美团", "腾讯"]), known, 1).collect()
    assert sorted((r["keyword"], r["id"], r["company"], r["is_kept"], r["is_dropped"]) for r in got) == [("后端 面经", "x", "其他", False, False), ("后端 面经", "字节", "字节", True, False), ("腾讯 面经", "美团", "美团", True, False), ("腾讯 面经", "腾讯", "腾讯", False, False)]


def plain_scan(pages, most, good):
    """Ids that a scan page by page finds, and where it ends."""
    out, streak, seen = [], 0, set()
    for n, page in enumerate(sorted(pages), start=1):
        ids = pages[page]
        if not ids:
            streak += 1
            if n <= most or streak >= 2:
                break
            continue
        streak, matched = 0, 0
        for i in ids:
            out.append(i)
            if i in good and i not in seen:
                seen.add(i)
                matched += 1
        if matched == 0 and n > most:
            streak += 1
    return out


def test_scans_end_at_empty_pages(spark):
    r = random.Random(8)
    for _ in range(4):
        pages = {(k, p): [str(r.randrange(12)) for _ in range(r.choice([0, 1, 2, 2, 3]))] for k in "abcdef" for p in range(1, 9)}
        rules = config.Rules(must=("1", "3", "5"))
        got = readers.search_posts(responses(spark, pages), most_pages=3, rules=rules).orderBy("seq").collect()
        good = {str(i) for i in range(12) if set(str(i)) & set("135")}
        for k in "abcdef":
            assert [x["id"] for x in got if x["keyword"] == k] == plain_scan({p: v for (q, p), v in pages.items() if q == k}, 3, good)


def test_ranking_scan_ends(spark):
    entry = lambda i: {"leetcode": {"title": f"t{i}" if i else "", "frontend_question_id": str(i), "level": 1}, "time": "2024-01-02", "value": i}
    rank_pages = lambda count, pages: spark.read.schema(readers.RANKING).json(spark.sparkContext.parallelize([json.dumps({"count": count, "page": p, "list": [entry(i) for i in ids]}) for p, ids in enumerate(pages, 1)], 2))
    ids = lambda df: [r["id"] for r in readers.ranking(df, whole=False).orderBy("seq").collect()]
    assert ids(rank_pages(4, [[1, 2], [0, 3], [4, 5], [6]])) == [1, 2, 3, 4, 5]
    assert ids(rank_pages(0, [[1, 2], [], [3]])) == [1, 2]
    assert ids(rank_pages(99, [[1], [2], [3]])) == [1, 2, 3]


def test_numbers_of_saved_posts_are_made_unique(spark):
    rows = [(1, "b", "7", "u"), (1, "a", "8", "u"), (2, "a", "9", "u")]
    got = readers.arrival(spark.createDataFrame(rows, "seq long, keyword string, id string, uuid string"), ["b"]).orderBy("seq").collect()
    assert [(r["seq"], r["id"]) for r in got] == [(1, "7"), (2, "8"), (3, "9")]


def test_segments_of_many_lines(spark):
    """Cut by bounds: 16,000 lines take no copies of what came before."""
    import time

    body = "\n".join(f"{i % 90 + 1}. 介绍一下 mysql 索引 {i}" if i % 2 else f"答：说明 {i}" for i in range(16_000))
    df = spark.createDataFrame([(body,)], "c string")
    df.select(quality.numbered_ads(F.lit("1. abc\nx"))).collect()
    began = time.time()
    got = df.select(quality.numbered_ads(F.col("c")).alias("x")).first()["x"]
    assert got["segments"] == 8000 and time.time() - began < 4


@pytest.mark.parametrize("body, outline, want", [("b", "", "b"), (" b ", None, "b"), ("", " 1. x ", "1. x"), ("b 1. x", "1. x\n2. y", "b 1. x"), ("b", "1. x\r\n2. y", "1. x\r\n2. y\n\nb"), (None, None, "")])
def test_body_with_outline(spark, body, outline, want):
    assert spark.createDataFrame([(body, outline)], "b string, o string").select(text.body_with_outline(F.col("b"), F.col("o"))).first()[0] == want


def test_details_come_from_the_service_then_the_state_then_the_page(spark):
    state = '{"prefetchData":{"1":{"ssrCommonData":{"contentData":{"content":"state"}}}}}'
    html = lambda s: f"<html><script>window.__INITIAL_STATE__={s};</script><div class='post-content'>page</div></html>"
    df = spark.createDataFrame([("api", html(state)), ("", html(state)), (None, html("")), (None, None)], "c string, p string")
    assert [r[0] for r in df.select(readers.detail_content(F.col("c"), F.col("p"))).collect()] == ["api", "state", "page", None]


def test_owners_of_a_configuration(spark):
    s = config.settings({"company_owner_aliases": {" 小鹅 ": "腾讯", "": "x", "荣耀": "别家"}})
    owners = readers.owner_aliases(dict(s.owners))
    assert owners["小鹅"] == "腾讯" and owners["荣耀"] == "别家" and "" not in owners
    titles = spark.createDataFrame([(1, "小鹅 面经"), (2, "荣耀 面经")], "seq long, title string")
    found = entity.candidates(titles, entity.dictionary(spark, [], owners))
    assert {r["seq"]: r["company"] for r in entity.best_company(titles, found).collect()} == {1: "腾讯", 2: "别家"}

import json

import pytest

from quillmill import __main__ as cli
from quillmill.operators import stats
from quillmill.sources import reports


def test_posts_and_library(spark, tmp_path):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 事务 并发 {i}" + " 以及项目里的实际用法和遇到的困难" * 3 for i in range(1, 10))
    rows = [(i, str(i), "", "content-data", f"字节 后端面经{i}" if i % 2 else "后端面经", "k", body) for i in range(12)]
    spark.createDataFrame(rows, "seq long, id string, uuid string, detail_api_type string, title string, keyword string, search_content string").write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.json").write_text(json.dumps(["字节"], ensure_ascii=False))
    out = cli.run_posts(spark, cli.arguments(["posts", "--posts", str(tmp_path / "p"), "--companies", str(tmp_path / "c.json"), "--items", "3", "--mode", "pool", "--formats", "md", "--output", str(tmp_path / "o")]))
    report = reports.read_report(out["md"])
    assert report.count("## 字节") == 3 and "https://www.nowcoder.com/discuss/" in report
    (tmp_path / "l.md").write_text("1. a\n简单\n2024-01-01\n3\n2. b\nhard\n")
    cli.run_library(spark, cli.arguments(["library", "--list", str(tmp_path / "l.md"), "--output", str(tmp_path / "lib")]))
    lib = json.loads(spark.read.text(str(tmp_path / "lib")).first()[0])
    assert lib["problem_ids"] == [1, 2] and lib["problem_titles"] == ["a", "b"]


def test_posts_with_library_comments_and_annotations(spark, tmp_path):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 事务 并发 {i}" + " 以及项目里的实际用法" * 3 for i in range(1, 10)) + "\n手撕 三数之和"
    rows = [(1, "1", "", "content-data", "字节 后端面经", "k", body), (2, "2", "", "content-data", "字节 后端面经二", "k", body.replace("三数之和", "别的"))]
    spark.createDataFrame(rows, "seq long, id string, uuid string, detail_api_type string, title string, keyword string, search_content string").write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.json").write_text(json.dumps(["字节"], ensure_ascii=False))
    (tmp_path / "lib.json").write_text(json.dumps({"categories": ["图论"], "problem_titles": ["三数之和"], "problem_ids": [15], "interview_hot_problems": [{"id": "15", "title": "三数之和", "frequency": "9", "difficulty": "2", "link": "u"}]}, ensure_ascii=False))
    say = lambda *words: {"records": [{"content": w, "replyList": []} for w in words]}
    pages = [{"post_id": "1", "page": 2, "data": say("later")}, {"post_id": "1", "page": 1, "data": say("first", "second")}]
    (tmp_path / "m.json").write_text("\n".join(json.dumps(p) for p in pages))
    args = ["posts", "--posts", tmp_path / "p", "--companies", tmp_path / "c.json", "--library", tmp_path / "lib.json", "--comments", tmp_path / "m.json", "--with", "id", "comments", "outline", "annotations", "--mode", "pool", "--formats", "csv", "--output", tmp_path / "o"]
    out = cli.run_posts(spark, cli.arguments([str(x) for x in args]))
    got = {r["ID"]: r for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out["csv"]).collect()}
    assert got["1"]["算法标注"] == "15. 三数之和 | 频度:9 | 难度:中等 | 链接:u"
    assert got["1"]["评论及回复"] == "first\nsecond\nlater" and not got["2"]["评论及回复"] and not got["2"]["算法标注"]
    assert got["1"]["面试题清单"].startswith("1. 介绍一下")


def test_switches_and_weights_of_a_configuration():
    from quillmill.plans import config

    s = config.settings({"filter_rules": {"score_filter": {"alg_enabled": False, "promo_block_enabled": False, "alg_topic_weight": 9, "alg_topic_keywords": ["dp"], "numbered_ad_block_ratio": 1, "heap_elastic_step_ratio": 0.5, "heap_elastic_replace_threshold": 2, "parallel_batch_size": 3}}})
    q, p = s.quality, s.selection
    assert (q.alg_enabled, q.promo_enabled, q.ad_enabled, q.alg_topic, q.alg_topics, q.ad_ratio) == (False, False, True, (9, 24), ("dp",), 1.0)
    assert (p.step_ratio, p.replace_threshold, p.batch, p.idle_rounds) == (0.5, 2, 3, 3)
    assert config.settings({}).quality == config.Quality()


def test_a_streamed_run_goes_on_with_new_files(spark, tmp_path):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 事务 并发 {i}" + " 以及项目里的实际用法和遇到的困难" * 3 for i in range(1, 10))
    schema = "seq long, id string, uuid string, detail_api_type string, title string, keyword string, search_content string"
    (tmp_path / "c.json").write_text(json.dumps(["字节"], ensure_ascii=False))

    def run(folder, *more):
        out = cli.run_posts(spark, cli.arguments([str(x) for x in ("posts", "--posts", folder, "--companies", tmp_path / "c.json", "--items", 3, "--mode", "pool", "--formats", "csv", "--with", "id", "--output", tmp_path / f"o{len(list(tmp_path.iterdir()))}", *more)]))
        return sorted((r["ID"], r["公司"]) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out["csv"]).collect())

    for part in range(2):
        rows = [(i, str(i), f"u{i}", "content-data", f"字节 后端面经{i}", f"k{i % 2}", body + "。" * (i * 7 % 11)) for i in range(10 * part, 10 * part + 10)]
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(str(tmp_path / "p"))
        assert run(tmp_path / "p", "--stream", tmp_path / "s") == run(tmp_path / "p")


def test_posts_from_saved_responses(spark, tmp_path):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 事务 并发 {i}" + " 以及项目里的实际用法和遇到的困难" * 3 for i in range(1, 10))
    part = lambda i, t: {"id": i, "uuid": f"u{i}", "title": t, "content": body}
    page = lambda k, p, *posts: json.dumps({"keyword": k, "page": p, "data": {"records": [{"data": {"momentData": x}} for x in posts]}}, ensure_ascii=False)
    (tmp_path / "r.json").write_text("\n".join([page("a", 1, part("1", "字节 面经")), page("a", 2), page("a", 3, part("2", "字节 面经二")), page("b", 1, part("3", "美团 面经"))]))
    (tmp_path / "c.json").write_text(json.dumps(["字节", "美团"], ensure_ascii=False))
    out = cli.run_posts(spark, cli.arguments([str(x) for x in ("posts", "--responses", tmp_path / "r.json", "--companies", tmp_path / "c.json", "--mode", "pool", "--formats", "csv", "--with", "id", "--output", tmp_path / "o")]))
    got = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out["csv"]).collect()
    assert sorted((r["ID"], r["公司"], r["搜索关键词"]) for r in got) == [("1", "字节", "a"), ("3", "美团", "b")]


def test_lookups_grow_from_run_to_run(spark, tmp_path):
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 事务 并发 {i}" + " 以及项目里的实际用法和遇到的困难" * 3 for i in range(1, 10))
    schema = "seq long, id string, uuid string, detail_api_type string, title string, keyword string, search_content string"
    titles = ["星云科技 后端 面经", "小鹅直播 面经", "甲乙丙 面经", "字节 面经"]
    spark.createDataFrame([(i, str(i), f"u{i}", "content-data", t, "k", body) for i, t in enumerate(titles)], schema).write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.json").write_text(json.dumps(["字节", "腾讯"], ensure_ascii=False))
    said = [{"token": "星云科技", "arr": ["星云科技有限公司"]}, {"token": "小鹅直播", "arr": ["小鹅直播是腾讯旗下的", "小鹅直播 属于腾讯"]}]
    (tmp_path / "s.json").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in said))
    got = []
    for n, more in enumerate((["--suggestions", tmp_path / "s.json"], [], ["--suggestions", tmp_path / "s.json"])):
        out = cli.run_posts(spark, cli.arguments([str(x) for x in ("posts", "--posts", tmp_path / "p", "--companies", tmp_path / "c.json", "--mode", "pool", "--formats", "csv", "--with", "id", "--lookups", tmp_path / "l", "--output", tmp_path / f"o{n}", *more)]))
        got.append(sorted((r["ID"], r["公司"]) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out["csv"]).collect()))
    assert got[0] == [("0", "星云科技"), ("1", "腾讯"), ("3", "字节")] and got[0] == got[1] == got[2]


@pytest.mark.parametrize("mode", ["pool", "early"])
def test_a_run_counts_in_passing(spark, tmp_path, mode):
    """Observed counts equal those of run_counts over all posts; samples hold what was left out."""
    body = "\n".join(f"{i}. 介绍一下 mysql 索引 和 redis 缓存 事务 并发 {i}" + " 以及项目里的实际用法和遇到的困难" * 3 for i in range(1, 10))
    schema = "seq long, id string, uuid string, detail_api_type string, title string, keyword string, search_content string"
    rows = [(i, str(i), f"u{i}", "content-data", f"{'字节' if i % 3 else ''} 后端面经{i}", "k", "短" if i % 4 == 0 else "" if i % 7 == 0 else body) for i in range(30)]
    spark.createDataFrame([*rows, rows[1]], schema).write.parquet(str(tmp_path / "p"))
    (tmp_path / "c.json").write_text(json.dumps(["字节"], ensure_ascii=False))
    counts = stats.RunCounts()
    cli.run_posts(spark, cli.arguments([str(x) for x in ("posts", "--posts", tmp_path / "p", "--companies", tmp_path / "c.json", "--items", 30, "--mode", mode, "--formats", "csv,txt", "--samples", 4, "--output", tmp_path / "o")]), counts)
    with_content = [r for r in rows if r[6]]
    passed = [r for r in with_content if r[6] == body]
    named = [r for r in passed if r[0] % 3]
    assert counts.get() == {"candidates": 30, "with_content": len(with_content), "passed": len(passed), "rejected": len(with_content) - len(passed), "kept": len(named), "dropped_unknown": len(passed) - len(named)}
    assert spark.read.json(str(tmp_path / "o/samples/rejected")).count() == 4 and spark.read.json(str(tmp_path / "o/samples/dropped")).count() == min(4, len(passed) - len(named))

"""Hand-made cases of single functions."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import match, text
from quillmill.operators import entity, knowledge, quality
from quillmill.plans.config import Quality, Rules, Selection, page_limit


@pytest.fixture(scope="module")
def one(spark):
    def value(column, **cols):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()] or [F.lit(0).alias("z")])
        return row.select(column.alias("out")).first()["out"]

    return value


@pytest.mark.parametrize(("raw", "want"), [("【字节】一面　面经", "[字节]1面 面经"), ("ＭySQL​索引", "mysql索引"), ("两数之和", "2数之和"), (None, ""), ("  A\t\nB ", "a b")])
def test_normal_form(one, raw, want):
    assert one(text.normalize(F.col("x")), x=raw) == want
    assert text.normalize_local(raw or "") == want
    assert text.normalize_local(want) == want


def test_collapsed_repeats():
    from quillmill.plans.config import Normalization

    assert text.normalize_local("aaaab!!!", Normalization(collapse_repeats=True)) == "ab!"


def test_markup(one):
    assert one(text.scoring_content(F.lit("x<b>y</b>"))) == "x y "
    assert one(text.scoring_content(F.lit("a&amp;b http://t.co/x z"))) == "a&b   z"
    assert one(text.archive_content(F.lit("<p>a</p><p>b</p>"))) == "a\nb"
    assert one(text.archive_content(F.lit("x<b>y</b>"))) == "xy"
    assert one(text.markdown_content(F.lit("# T\n---\n> q\n- b\n3. c\n```x\n\n\n\nz\t"))) == "T\nq\nb\nc\n'''x\n\nz"


def test_counts(one):
    assert one(match.overlapping_count(F.lit("aaaa"), "aa")) == 3
    assert one(match.keyword_count(F.lit("aaaa"), "aa")) == 0
    assert one(match.keyword_count(F.lit("go mongo go"), "go")) == 2


OUTLINE = "1. 介绍一下项目的架构\n2、ok\n3) Redis 为什么这么快\n3. 重复的编号内容测试\n2. 编号倒退的内容测试"


def test_outline(one):
    assert one(quality.numbered_items(F.lit(OUTLINE))) == ["1. 介绍一下项目的架构", "3. Redis 为什么这么快"]
    assert one(F.size(quality.numbered_lines(F.lit(OUTLINE)))) == 5


@pytest.mark.parametrize(("points", "chars", "want"), [*zip([0, 1, 2, 3, 4, 5, 6, 7, 8, 12], [100] * 10, [0, 0, 0, 19, 25, 31, 38, 44, 50, 50], strict=True), (2, 1300, 0)])
def test_structure(one, points, chars, want):
    assert one(quality.structure_score(F.col("p"), F.col("c")), p=points, c=chars) == want


@pytest.mark.parametrize(("f", "want"), [(0, 0), (1, 1), (9, 4), (99, 7), (999, 11), (10000, 12)])
def test_frequency(one, f, want):
    assert one(text.frequency_score(F.col("f")), f=f) == want


@pytest.mark.parametrize(("chars", "want"), [(0, 0), (200, 2), (300, 7), (2200, 70)])
def test_length(one, chars, want):
    assert one(text.length_score(F.col("c")), c=chars) == want


def test_positions_and_scores(one):
    at = lambda t, k: one(entity.position(F.lit(t), F.lit(k)))
    assert (at("Go语言 go", "go"), at("mongo", "go"), at("abc", "x")) == (0, -1, -1)
    score = lambda t, k, source: one(entity.candidate_score(F.lit(t), F.lit(k), F.lit(entity.SOURCE_WEIGHT[source])))
    assert score("字节跳动后端一面", "字节跳动", "alias_map") == 162
    assert score("【美团】后端一面", "美团", "known_company") == 156
    assert score("面经 tx 二面", "tx", "nickname_alias") == 166
    assert score("无关", "tx", "nickname_alias") == -1


def test_keywords(one):
    words = "mysql 索引 缓存 事务 并发 redis mq"
    assert one(quality.keyword_score(F.lit(""), F.lit(words))) == 44
    assert one(quality.keyword_score(F.lit(""), F.lit("mysql 索引"))) == 22


def test_tags(one):
    assert one(text.tags(F.array(F.lit("#内推"), F.lit("面试"), F.lit("面试")))) == ["内推", "面试"]
    assert one(quality.tail_penalty(F.array(F.lit("内推"), F.lit("面试")))) == 6 + 18
    assert one(text.tail_hashtags(F.lit("x #a, #b#c #a"))) == ["a", "b"]


def test_promotion(one):
    assert one(quality.promotion_hits(F.lit("训练营"), F.lit("简历优化"))) == ["简历优化", "训练营"]


def test_problem_ids(one):
    known = F.array(F.lit(1), F.lit(146))
    assert one(match.problem_ids(F.lit("第1题 lc 146 10086题"), known)) == [1, 146]


def test_context_and_suppression(one):
    words = match.patterns(Quality().alg_context)
    assert one(match.in_context(F.lit("手撕 2数之和"), "2数之和", words)) is True
    assert one(match.in_context(F.lit("2数之和 手撕"), "2数之和", words)) is False
    assert one(match.longest_only(F.array(F.lit("two sum"), F.lit("sum")))) == ["two sum"]


def test_skip_and_combine(one):
    assert one(match.skip_hits(F.lit("a-b..c"), ["abc", "ab"], "-.", 2)) == ["abc", "ab"]
    assert one(match.combine_hits(F.lit("后 端-面/经"), ["后端面经"], Rules().strip_chars)) == ["后端面经"]


def test_entries(one):
    assert [one(text.difficulty_of_level(F.lit(k))) for k in (1, 3, 9)] == ["容易", "困难", ""]
    assert one(text.difficulty_of_name(F.lit(" Hard "))) == "困难"
    assert one(text.search_url(F.lit("two sum"))) == "https://leetcode.cn/problemset/all/?search=two%20sum"
    assert one(text.search_url(F.lit("a/b~c*"))).endswith("a/b~c%2A")
    hit = F.array(F.struct(F.lit(1).alias("id"), F.lit("1").alias("frontend_id"), F.lit("两数之和").alias("title"), F.lit(9).alias("frequency"), F.lit("容易").alias("difficulty"), F.lit("u").alias("url")))
    assert one(knowledge.annotations(hit)) == "1. 两数之和 | 频度:9 | 难度:容易 | 链接:u"


@pytest.mark.parametrize(("name", "want"), [("字节", True), ("面经", False), ("123", False), ("A", False), ("为什么?", False), ("没有任何公司", False)])
def test_plausible(one, name, want):
    assert one(entity.plausible_name(F.col("x")), x=name) is want


def test_verdict(one):
    v = lambda w, *s: one(entity.verdict(F.lit(w), F.array(*[F.lit(x) for x in s])))
    assert v("星云", "星云有限公司") is True
    assert v("acme", "acme login", "acme 官网") is True
    assert v("acme", "other") is False
    assert v("某某某某", "某某某某 教程", "怎么学习") is False


def test_planning():
    assert page_limit(5, 10, True) == 30 and page_limit(5, 10, False) == 5
    s = Selection(items=10)
    assert (s.pool, s.pool_max, s.pool_step) == (15, 22, 3)


def test_numbers_end_where_the_pattern_says(one):
    assert one(match.problem_ids(F.lit("算法题12"))) == [12] and one(match.problem_ids(F.lit("算法题12 [a"))) == [12]
    assert one(match.problem_ids(F.lit("算法题12|"))) == [] and one(match.problem_ids(F.lit("算法题12["))) == []
    assert one(match.in_context(F.lit("2数之和"), "2数之和", [])) is True

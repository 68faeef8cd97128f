"""The automaton, components, dictionary signatures and the streamed pool against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.functions import automaton, match
from quillmill.operators import components, entity, knowledge, quality, rank
from quillmill.plans import config
from quillmill.streaming import pool
from quillmill.streaming import posts as streams


@pytest.mark.parametrize("seed", range(12))
def test_automaton_counts(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(automaton, "BATCH_CHARS", r.choice([1, 100, 1 << 21]))
    monkeypatch.setattr(automaton, "CELLS", r.choice([10, 100, 1 << 23]))
    letters = r.choice(["ab", "abcdé中😀"])
    words = list(dict.fromkeys("".join(r.choice(letters) for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 30))))
    texts = ["".join(r.choice(letters + "xyz\0") for _ in range(r.choice([0, 1, 5, 300, 3000]))) for _ in range(r.randrange(0, 12))]
    got = sorted(zip(*(x.tolist() for x in automaton.Patterns(words).count(texts)), strict=True))
    assert got == sorted((i, k, n) for i, t in enumerate(texts) for k, w in enumerate(words) if (n := len(re.findall(f"(?={re.escape(w)})", t))))


def test_hits_by_automaton_and_by_column_agree(spark):
    words = ["ab", "b", "", "ba", "zz", "abab", "中"]
    df = spark.createDataFrame([("ababab",), (None,), ("",), ("x中",), ("zzz b",)], "t string")
    got = df.select(match.automaton_hits(F.coalesce("t", F.lit("")), words).alias("a"), match.hits(F.coalesce("t", F.lit("")), words).alias("b")).collect()
    assert [sorted(r["a"]) for r in got] == [sorted(r["b"]) for r in got] and got[0]["a"] == ["", "ab", "b", "ba", "abab"]
    with pytest.raises(ValueError, match="parts texts"):
        automaton.occurrences(F.lit(""), ["a\0"])


def test_weighted_keywords_in_one_pass(spark, monkeypatch):
    r = random.Random(4)
    words = list(dict.fromkeys("".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(60)))
    keys = tuple(config.Keyword(w, r.randrange(5), r.choice(["title", "content", "both"]), r.random() < 0.5) for w in words)
    df = spark.createDataFrame([("".join(r.choice("abcd ") for _ in range(n)), "".join(r.choice("abcd ") for _ in range(3 * n))) for n in (0, 1, 5, 20)], "t string, c string")
    for cap in (7, 10_000):
        q = config.Quality(keywords=keys, keyword_max=cap)
        gain = lambda: [x[0] for x in df.select(quality.keyword_score(F.col("t"), F.col("c"), q)).collect()]  # noqa: E731, B023
        one = gain()
        with monkeypatch.context() as m:
            m.setattr(match, "COUNTED", 1000)
            assert one == gain()


def test_a_text_is_read_once_for_500_features(spark):
    words = [a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"][:500]
    q = config.Quality(keywords=tuple(config.Keyword(w, 1, "content", True) for w in words), keyword_max=10**6)
    df = spark.range(2).select(F.lit("abc abc").alias("t"), F.lit("abcabc").alias("c"))
    plan = df.select(quality.keyword_score(F.col("t"), F.col("c"), q))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("found(") <= 4 and "regexp_count" not in plan


def plain_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(45)]
    got, _ = components.components(spark.createDataFrame(edges, "u string, v string"))
    assert {x["node"]: x["component"] for x in got.collect()} == plain_components(edges)


def test_components_of_nothing(spark):
    got, rounds = components.components(spark.createDataFrame([(None, 1)], "u long, v long"))
    assert got.count() == 0 and rounds == 0


def test_a_long_chain_takes_few_rounds(spark):
    n = 1000
    places = list(range(n))
    random.Random(7).shuffle(places)
    for order in (list(range(n)), places):
        edges = [(order[i], order[i + 1]) for i in range(n - 1)]
        got, rounds = components.components(spark.createDataFrame(edges, "u long, v long"))
        assert rounds <= 12 and got.where("component <> 0").count() == 0 and got.count() == n


def test_entries_of_a_long_chain_merge(spark):
    rows = [(i, (i + 1) // 2 + 1, f"t{i // 2:04}", i % 7 + 1, "s") for i in range(600)]
    out = knowledge.merge(knowledge.entries(spark.createDataFrame(rows, "seq long, id int, title string, frequency int, source string"))).collect()
    assert len(out) == 1 and out[0]["frequency"] == 7
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()


def first_two(titles, entries):
    """How many pairs meet by the entries' first two characters."""
    pairs = titles.select("seq", F.explode(entity.grams(F.col("title"), True)).alias("k"))
    return pairs.join(entries.withColumn("k", F.substring(F.lower("alias"), 1, 2)), "k").count()


def test_rare_signatures_find_all_and_meet_less(spark):
    r = random.Random(5)
    names = list(dict.fromkeys("中国" + "".join(r.choice("银行科技东方网络云海") for _ in range(r.randrange(1, 4))) for _ in range(60))) + ["Q", "go", "中"]
    rows = [(i, "".join(r.choice(["面经", " ", "后端", "Go", "q", r.choice(names)]) for _ in range(4))) for i in range(300)] + [(300, None), (301, ""), (302, "中国")]
    titles = spark.createDataFrame(rows, "seq long, title string")
    entries = spark.createDataFrame([(n, n, "known_company", 100, k) for k, n in enumerate(names)], "alias string, company string, source string, weight int, rule int")
    met = entity.meetings(titles, entries)
    got = {(x["seq"], x["alias"]) for x in met.where("contains(lower(title), lower(alias))").select("seq", "alias").collect()}
    assert got == {(i, n) for i, t in rows if t for n in names if n.lower() in t.lower()}
    assert met.count() * 3 < first_two(titles, entries)


POSTS = "seq long, id string, uuid string, keyword string, passed boolean, quality_score int, content_chars int"


def stream_rows(seed, n):
    r = random.Random(seed)
    return [(i, str(r.randrange(n)) if r.random() < 0.9 else None, "u", r.choice(["hot", "hot", "hot", "a", "b", None]), r.random() < 0.7, r.randrange(30), r.randrange(5)) for i in range(n)]


def plain_stream_pool(rows, k, best):
    seen, by = set(), {}
    for seq, i, u, key, passed, score, chars in sorted(rows):
        if (key, i, u) not in seen:
            seen.add((key, i, u))
            if passed:
                by.setdefault(key, []).append(((-score, -chars), i or "", seq))
    out = set()
    for key, found in by.items():
        # ids in descending order: sort twice
        order = sorted(sorted(found, key=lambda x: x[1], reverse=True), key=lambda x: x[0]) if best else sorted(found, key=lambda x: x[2])
        out |= {(key, x[2]) for x in order[:k]}
    return out


@pytest.mark.parametrize("best, parts, forget", [(True, 3, None), (False, 1, 3_600_000)])
def test_streamed_pool_equals_the_batch_pool(spark, tmp_path, best, parts, forget):
    """Over several micro-batches, and after a restart with more files."""
    rows = stream_rows(6, 400)
    entered = pool.entrants(streams.read_posts(spark, str(tmp_path / "in" / "*"), POSTS), 5, best=best, parts=parts, forget=forget, idle=forget)
    for start in (0, 200):  # the second run goes on from the first one's checkpoint
        for at in range(start, start + 200, 100):
            spark.createDataFrame(rows[at : at + 100], POSTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{at}"))
        pool.to_table(entered, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        found = spark.read.schema(entered.schema).parquet(str(tmp_path / "out"))
        got = {(r["keyword"], r["seq"]) for r in pool.pool(found, 5, best=best).collect()}
        assert got == plain_stream_pool(rows[: start + 200], 5, best)
    assert found.count() < 200


def test_idle_keys_give_up_their_pool(spark, tmp_path):
    """A timer that has run out clears the pool: what is worse than before goes on again."""
    import time

    entered = pool.entrants(streams.read_posts(spark, str(tmp_path / "in" / "*"), POSTS), 1, idle=1)
    for at, score in enumerate((9, 5)):
        spark.createDataFrame([(at, str(at), "u", "a", True, score, 0)], POSTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"d{at}"))
        pool.to_table(entered, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        time.sleep(0.1)
    found = spark.read.schema(entered.schema).parquet(str(tmp_path / "out"))
    assert [r["seq"] for r in pool.pool(found, 1).collect()] == [0]




def test_a_library_of_20000_titles_by_joins(spark):
    """The same signals as the columns give, with no list of titles on the driver."""
    r = random.Random(9)
    # 20,000 titles of which the posts name some; one is the compact form of another's text
    made = spark.range(20_000).select(F.col("id").alias("seq"), F.concat(F.lit("题目"), F.conv(F.col("id").cast("string"), 10, 36), F.lit(" 号")).alias("title"))
    few = [made.where(f"seq = {k}").first()["title"] for k in (5, 50, 500, 19_999)]
    say = lambda: " ".join(r.choice(["手撕", "第 7 题", "leetcode 11", "动态规划", "中文", few[r.randrange(4)], few[r.randrange(4)].replace(" ", "")]) for _ in range(8))
    posts_ = spark.createDataFrame([(i, say(), say()) for i in range(40)] + [(40, "", ""), (41, None, None)], "seq long, title string, content string")
    hot = spark.createDataFrame([(7, few[0], 99), (11, few[1], 3), (None, "动态规划", 8)], "id int, title string, frequency int")
    rules = config.Rules(normalization=config.Normalization(nfkc=False, map_digits=False))
    q = config.Quality(alg_topics=("中文",))
    column = quality.Library([x.asDict() for x in hot.collect()], [x["title"] for x in made.where("seq in (5, 50, 500, 19999)").collect()], [7, 11, 12], rules, q, ["手撕"], ["动态"])
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    tables = quality.library_tables(made, hot, spark.createDataFrame([(7,), (11,), (12,), (99_999,)], "id int"), word("手撕"), word("动态"), rules, q)
    pick = lambda df: {x["seq"]: (x["f"]["titles"], x["f"]["ids"], x["f"]["hot_titles"], x["f"]["score"]) for x in df.collect()}
    a = pick(quality.evaluate(posts_, q, rules, tables).select("seq", F.col("breakdown.algorithm").alias("f")))
    b = pick(quality.evaluate(posts_, q, rules, column).select("seq", F.col("breakdown.algorithm").alias("f")))
    assert a == b and len(a) == 42 and sum(len(v[0]) for v in b.values()) > 20

"""Quality of a post: structure, relevance, promotion; one projection per post."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import match, text
from ..plans.config import Quality, Rules
from ..sources.tables import cut
from . import entity

#: Fixed value: a numbered line.
NUMBERED = r"(?d)^\s*(\d{1,2})\s*[\.．、\)\]）]\s*(.{2,280})\s*$"
ITEM = "array<struct<no:int,body:string>>"


def lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(text.or_empty(content), r"[\r\n]+"), text.strip), lambda x: F.length(x) > 0)


def numbered_lines(content: Column) -> Column:
    return F.filter(lines(content), lambda x: x.rlike(NUMBERED))


def numbered_items(content: Column, least: int = 6) -> Column:
    """Items of an outline ("n. body"): numbered lines with enough text and a number above
    all before it. Numbers have two digits, so the list that is kept grows 99 times at most."""
    found = F.transform(numbered_lines(content), lambda x: F.struct(F.regexp_extract(x, NUMBERED, 1).cast("int").alias("no"), text.strip(F.regexp_replace(F.regexp_extract(x, NUMBERED, 2), r"(?U)\s+", " ")).alias("body")))
    good = F.filter(found, lambda x: (text.dense_length(x["body"]) >= least) & (x["no"] > 0))
    none = F.struct(F.lit(0).alias("last"), F.expr(f"cast(array() as {ITEM})").alias("out"))
    kept = F.aggregate(good, none, lambda s, x: F.when(x["no"] > s["last"], F.struct(x["no"].alias("last"), F.concat(s["out"], F.array(F.struct(x["no"].alias("no"), x["body"].alias("body")))).alias("out"))).otherwise(s), lambda s: s["out"])
    return F.transform(kept, lambda x: F.concat(x["no"].cast("string"), F.lit(". "), x["body"]))


def structure_score(points: Column, chars: Column, q: Quality = Quality()) -> Column:
    """Score of an outline's number of points; long texts without structure lose more."""
    raw = F.bround(F.least(points / F.lit(float(q.target_points)), F.lit(1.0)) * q.structure_max).cast("int")
    few = points < q.min_points
    steps = F.ceil((chars - q.noise_chars) / F.lit(float(q.noise_step_chars))).cast("int")
    noise = F.when(few & (chars > q.noise_chars), F.least(steps * q.noise_step_penalty, F.lit(q.noise_cap))).otherwise(0)
    return F.greatest(raw - F.when(few, q.missing_penalty).otherwise(0) - noise, F.lit(0))


def title_score(hits: Column, q: Quality = Quality()) -> Column:
    return F.least(hits * q.title_hit_weight, F.lit(q.title_hit_cap))


def content_score(hits: Column, q: Quality = Quality()) -> Column:
    return F.least(hits * q.content_hit_weight, F.lit(q.content_hit_cap))


def keyword_score(title: Column, content: Column, q: Quality = Quality(), rules: Rules = Rules()) -> Column:
    """Sum of the weighted keywords' gains in their order, up to the cap."""
    best: dict[tuple, int] = {}
    for k in q.keywords:
        word = match.patterns([k.keyword], rules)
        if word:
            key = (word[0], k.scope, k.repeated)
            best[key] = max(best.get(key, k.weight), k.weight)
    if len(best) >= match.COUNTED and all(weight >= 0 for weight in best.values()):  # then a cap at the end is one at each step
        return F.least(match.weighted_counts(title, content, [(*key, weight) for key, weight in best.items()]), F.lit(q.keyword_max))
    total = F.lit(0)
    for (word, scope, repeated), weight in best.items():
        seen = {"title": [title], "content": [content]}.get(scope, [title, content])
        if repeated:
            n = reduce(lambda a, b: a + b, [match.overlapping_count(c, word) for c in seen])
        else:
            n = reduce(lambda a, b: a | b, [F.contains(c, F.lit(word)) for c in seen]).cast("int")
        total = F.least(total + n * weight, F.lit(q.keyword_max))
    return total


def tail_penalty(tags: Column, q: Quality = Quality()) -> Column:
    """For tags at a text's end: by their number, and by the first drain word in each."""
    drain: dict[str, int] = {}
    for word, cost in q.tail_drain:
        drain[word] = max(drain.get(word, cost), cost)

    def cost(tag: Column) -> Column:
        out = F.when(F.lit(False), 0)
        for word, n in drain.items():
            out = out.when(F.contains(tag, F.lit(word)), n)
        return out.otherwise(0)

    sum_ = F.aggregate(F.transform(tags, cost), F.lit(0), lambda a, x: a + x)
    return F.least(F.size(tags) * q.tail_tag_penalty, F.lit(q.tail_tag_cap)) + F.least(sum_, F.lit(q.tail_drain_cap))


def tail_ratio(penalty: Column, q: Quality = Quality()) -> Column:
    return F.least(penalty / F.lit(float(q.tail_tag_cap + q.tail_drain_cap)), F.lit(1.0))


def match_score(signal: Column, chars: Column, tail: Column, q: Quality = Quality()) -> Column:
    """Relevance: the signals' share of what they can reach, less what tail and shortness take."""
    whole = float(q.title_hit_cap + q.content_hit_cap + q.keyword_max + (q.alg_total_cap if q.alg_enabled else 0))
    raw = F.least(signal / F.lit(whole), F.lit(1.0))
    short = F.when((chars > 0) & (chars < q.short_chars), F.least((q.short_chars - chars) / F.lit(float(q.short_chars)), F.lit(1.0)) * 0.35).otherwise(0.0)
    share = F.least(F.greatest(raw * (1 - tail) - short, F.lit(0.0)), F.lit(1.0))
    return F.bround(share * q.match_max).cast("int")


def promotion_hits(title: Column, content: Column, q: Quality = Quality(), rules: Rules = Rules()) -> Column:
    """Distinct promotional words in title and content, sorted."""
    return F.array_sort(match.hits(F.concat_ws("\n", title, content), match.patterns(q.promo_words, rules)))


def numbered_ads(content: Column, q: Quality = Quality(), rules: Rules = Rules(), normalized: bool = False) -> Column:
    """Struct of what follows numbered lines: segments, suspicious ones, distinct markers, and
    whether that is an advertisement. normalized: the lines are in normal form already."""
    markers = match.patterns(q.ad_markers, rules)
    # Each segment: the lines between a numbered line and the next one, cut out by its bounds.
    # Lines and bounds are bound to a lambda's argument, so they are made once and not once a line.
    found = text.bound(lines(content), lambda rows: F.struct(rows.alias("rows"), F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(NUMBERED), i + 1)), lambda i: i.isNotNull()).alias("starts")))
    ends = lambda x: F.concat(F.slice(x["starts"], F.lit(2), F.size(x["starts"])), F.array(F.size(x["rows"]) + 1))
    segments = text.bound(found, lambda x: F.when(F.size(x["starts"]) > 0, F.zip_with(x["starts"], ends(x), lambda a, b: F.slice(x["rows"], a + 1, b - a - 1))).otherwise(F.array().cast("array<array<string>>")))
    low = (lambda c: c) if normalized else (lambda c: F.lower(c))

    def facts(seg: Column) -> Column:
        body = F.array_join(seg, "\n")
        found = match.hits(low(body), markers)
        chars = text.dense_length(body)
        suspect = (F.size(seg) > 0) & (((chars >= q.ad_follow_chars) & (F.size(seg) >= q.ad_follow_lines)) | ((F.size(found) > 0) & (chars >= max(20, 30))))
        return F.struct(suspect.alias("suspect"), F.when(F.size(seg) > 0, found).otherwise(F.array().cast("array<string>")).alias("found"))

    def verdict(seen: Column) -> Column:
        n = F.size(seen)
        bad = F.size(F.filter(seen, lambda x: x["suspect"]))
        kinds = F.size(F.array_distinct(F.flatten(F.transform(seen, lambda x: x["found"]))))
        enough = n >= q.ad_min_items
        blocked = (enough & (bad >= 2) & (bad >= n * q.ad_ratio)) | (enough & (bad >= 1) & (kinds >= q.ad_marker_hits))
        return F.struct(n.alias("segments"), bad.alias("suspicious"), kinds.alias("markers"), blocked.alias("blocked"))

    return text.bound(F.transform(segments, facts), verdict)


def algorithm_score(markers: Column, topics: Column, problems: Column, ids: Column, hot_titles: Column, hot_ids: Column, q: Quality = Quality()) -> Column:
    """Signal of algorithm problems in a post, from counts of hits and sums of hot scores."""
    part = lambda n, rule: F.least(n * rule[0], F.lit(rule[1]))
    hot = F.least(F.least(hot_titles, F.lit(q.hot_title_cap)) + F.least(hot_ids, F.lit(q.hot_id_cap)), F.lit(q.hot_total_cap))
    return F.least(part(markers, q.alg_marker) + part(topics, q.alg_topic) + part(problems, q.alg_problem) + part(ids, q.alg_id) + hot, F.lit(q.alg_total_cap))


def hot_sum(found: Column, scores: dict) -> Column:
    """Sum of the scores of found keys."""
    if not scores:
        return F.lit(0)
    table = F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(F.transform(found, lambda x: F.coalesce(F.element_at(table, x), F.lit(0))), F.lit(0), lambda a, x: a + x)


class Library:
    """What is known of algorithm problems: titles, ids, how often each is asked, and further
    markers and topics."""

    def __init__(self, hot: list[dict], titles: list[str] = (), ids: list[int] = (), rules: Rules = Rules(), q: Quality = Quality(), markers: list[str] = (), topics: list[str] = ()):
        import math

        score = lambda f: 0 if f <= 0 else min(max(round(math.log(f + 1, q.hot_base) * q.hot_scale), 1), q.hot_max)
        self.hot_titles: dict[str, int] = {}
        self.hot_ids: dict[int, int] = {}
        for h in hot:
            f = int(h.get("frequency") or 1)
            for word in match.patterns([h.get("title") or ""], rules, 2):
                self.hot_titles[word] = max(self.hot_titles.get(word, 0), score(f))
            if h.get("id"):
                self.hot_ids[int(h["id"])] = max(self.hot_ids.get(int(h["id"]), 0), score(f))
        self.markers, self.topics = tuple(markers), tuple(topics)
        self.titles = match.patterns([*titles, *q.alg_titles], rules, 2)
        #: Titles by their form without punctuation and spaces, the first of each.
        table = {ord(c): None for c in rules.strip_chars}
        self.compacted: dict[str, str] = {}
        for t in self.titles:
            if len(short := t.translate(table)) >= 2:
                self.compacted.setdefault(short, t)
        self.ids = sorted({int(i) for i in ids if 1 <= int(i) <= 9999})


@dataclass(frozen=True)
class LibraryTables:
    """The same as tables, for libraries of any size: words(kind, word, name, score), kind being
    title, compact, hot, marker or topic and name what a found word stands for; ids(id, score)."""

    words: DataFrame
    ids: DataFrame


def library_tables(titles: DataFrame, hot: DataFrame, ids: DataFrame, markers: DataFrame, topics: DataFrame, rules: Rules = Rules(), q: Quality = Quality()) -> LibraryTables:
    """Tables of a library from titles(seq, title), hot(id, title, frequency), ids(id),
    markers(word) and topics(word), with what the settings add. Words are in normal form; of
    titles with one compact form the first stands for it; of a title's scores the greatest counts."""
    spark = titles.sparkSession
    own = lambda words, at: spark.createDataFrame([(at + k, w) for k, w in enumerate(words)], "seq long, word string")
    form = text.normalize(F.col("word"), rules.normalization)
    every = titles.select(F.col("seq").cast("long").alias("seq"), F.col("title").alias("word")).union(own(q.alg_titles, 1 << 40)).withColumn("word", form).where("length(word) >= 2")
    short = every.withColumn("c", match.compact(F.col("word"), rules.strip_chars)).where("length(c) >= 2").groupBy("c").agg(F.min_by("word", "seq").alias("name"))
    score = text.frequency_score(F.col("frequency"), q.hot_scale, q.hot_base, q.hot_max)
    rated = hot.select("id", F.col("title").alias("word"), score.alias("score")).withColumn("word", form)
    no = F.lit(0)
    row = lambda df, kind, word, name, value: df.select(F.lit(kind).alias("kind"), word.alias("word"), name.alias("name"), value.alias("score"))
    w = F.col("word")
    listed = lambda df, words: df.select("word").union(own(words, 0).select("word")).withColumn("word", form).where("word <> ''").distinct()
    parts = [row(every.select("word").distinct(), "title", w, w, no), row(short, "compact", F.col("c"), F.col("name"), no), row(listed(markers, q.alg_markers), "marker", w, w, no), row(listed(topics, q.alg_topics), "topic", w, w, no)]
    if q.hot_enabled:
        parts.append(row(rated.where("length(word) >= 2").groupBy("word").agg(F.max("score").alias("score")), "hot", w, w, F.col("score")))
    known = ids.select(F.col("id").cast("int").alias("id")).where("id between 1 and 9999").distinct()
    scores = rated.where("id is not null").groupBy(F.col("id").cast("int").alias("id")).agg(F.max("score").alias("score"))
    scored = known.join(scores, "id", "left").select("id", F.coalesce("score", no).alias("score")) if q.hot_enabled else known.withColumn("score", no)
    return LibraryTables(reduce(lambda a, b: a.union(b), parts), scored)


def with_signal(posts: DataFrame, title: Column, content: Column, raw: Column, library: LibraryTables, q: Quality = Quality(), rules: Rules = Rules()) -> DataFrame:
    """posts(seq, ...) with `_found`: algorithm_signal by joins with the library's tables. Texts
    meet words under the words' rarest grams; what a post names is exploded once, joined with the
    scores and summed by post. `seq` must tell posts apart."""
    words = cut(library.words)
    both = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(content, F.lit("")))
    texts = cut(posts.select("seq", both.alias("both"), raw.alias("raw")))
    plain = entity.contained(texts.select("seq", F.col("both").alias("text")), words.where("kind <> 'compact'"))
    dense = entity.contained(texts.select("seq", match.compact(F.col("both"), rules.strip_chars).alias("text")), words.where("kind = 'compact'"))
    held = plain.select("seq", F.explode("found").alias("word"), F.lit(False).alias("dense")).union(dense.select("seq", F.explode("found").alias("word"), F.lit(True).alias("dense")))
    kinds = words.withColumn("dense", F.col("kind") == "compact")
    of = lambda *kind: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kind), F.col("name"))))
    lists = held.join(kinds, ["word", "dense"]).groupBy("seq").agg(of("title", "compact").alias("p"), of("hot").alias("h"), F.size(of("marker")).alias("m"), F.size(of("topic")).alias("t"))
    context = match.patterns(q.alg_context, rules) if q.alg_context_required else []
    none = F.array().cast("array<string>")
    gate = lambda c: named(F.col("both"), F.coalesce(F.col(c), none), context, q.alg_reach)
    seen = texts.join(lists, "seq", "left").select("seq", gate("p").alias("titles"), gate("h").alias("hot_titles"), F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("t", F.lit(0)).alias("t"), match.problem_ids(F.col("raw")).alias("ids"))
    seen = cut(seen)
    keys = seen.select("seq", F.explode(F.concat(F.transform("hot_titles", lambda w: F.struct(w.alias("word"), F.lit(None).cast("int").alias("id"))), F.transform("ids", lambda i: F.struct(F.lit(None).cast("string").alias("word"), i.alias("id"))))).alias("x")).select("seq", "x.*")
    hot = keys.where("word is not null").join(words.where("kind = 'hot'").select("word", "score"), "word").select("seq", F.lit(None).cast("int").alias("id"), "score")
    numbers = keys.where("id is not null").join(library.ids, "id").select("seq", "id", "score")
    sums = hot.union(numbers).groupBy("seq").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.sum(F.when(F.col("id").isNull(), F.col("score"))).alias("hot"), F.sum(F.when(F.col("id").isNotNull(), F.col("score"))).alias("rated"))
    done = seen.drop("ids").join(sums, "seq", "left").withColumns({"ids": F.coalesce("ids", F.array().cast("array<int>")), "hot": F.coalesce("hot", F.lit(0)), "rated": F.coalesce("rated", F.lit(0))})
    score = algorithm_score(F.col("m"), F.col("t"), F.size("titles"), F.size("ids"), F.col("hot"), F.col("rated"), q)
    return posts.join(done.select("seq", F.struct("titles", "ids", "hot_titles", score.cast("int").alias("score")).alias("_found")), "seq", "left")


def named(text: Column, found: Column, context: list[str], reach: int = 24) -> Column:
    """Found titles that stand in their context, without those that lie in another such one."""
    return F.array_sort(match.longest_only(F.filter(found, lambda w: match.in_context(text, w, context, reach))))


def algorithm_signal(title: Column, content: Column, raw: Column, q: Quality = Quality(), rules: Rules = Rules(), library: Library | None = None) -> Column:
    """Struct of the problem titles, numbers and hot titles that a post names and of the score.
    title and content are in normal form; numbers are read from raw, as written."""
    library = library or Library([], rules=rules, q=q)
    if not q.alg_enabled:
        none = F.array().cast("array<string>")
        return F.struct(none.alias("titles"), F.array().cast("array<int>").alias("ids"), none.alias("hot_titles"), F.lit(0).alias("score"))
    both = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(content, F.lit("")))
    context = match.patterns(q.alg_context, rules) if q.alg_context_required else []
    problems, hot = match.hits(both, library.titles), match.hits(both, list(library.hot_titles) if q.hot_enabled else [])
    if library.compacted:
        table = F.create_map(*[F.lit(x) for pair in library.compacted.items() for x in pair])
        short = match.hits(match.compact(both, rules.strip_chars), list(library.compacted))
        problems = F.array_union(problems, F.transform(short, lambda x: F.element_at(table, x)))
    problems, hot = named(both, problems, context, q.alg_reach), named(both, hot, context, q.alg_reach)
    ids = match.problem_ids(raw, F.array(*[F.lit(i) for i in library.ids])) if library.ids else F.array().cast("array<int>")
    size = lambda *words: F.size(match.hits(both, match.patterns(words, rules)))
    hot_ids = library.hot_ids if q.hot_enabled else {}

    def whole(x: Column) -> Column:
        score = algorithm_score(x["markers"], x["topics"], F.size(x["titles"]), F.size(x["ids"]), hot_sum(x["hot_titles"], library.hot_titles), hot_sum(x["ids"], hot_ids), q)
        return F.struct(x["titles"].alias("titles"), x["ids"].alias("ids"), x["hot_titles"].alias("hot_titles"), score.cast("int").alias("score"))

    # What was found is bound, so the score does not search the text again.
    found = F.struct(problems.alias("titles"), ids.alias("ids"), hot.alias("hot_titles"), size(*q.alg_markers, *library.markers).alias("markers"), size(*library.topics, *q.alg_topics).alias("topics"))
    return text.bound(found, whole)


def evaluate(posts: DataFrame, q: Quality = Quality(), rules: Rules = Rules(), library: Library | LibraryTables | None = None) -> DataFrame:
    """posts(title, content, tags, ...) with quality_score, passed, question_outline,
    question_outline_count and the struct `breakdown`. A library of tables needs posts with a
    `seq` that tells them apart."""
    tags = F.col("tags") if "tags" in posts.columns else F.array().cast("array<string>")
    base = posts.withColumn("_raw", text.scoring_content(F.col("content")))
    # Normal forms are computed once and kept as columns.
    base = base.withColumns({"_t": text.normalize(F.col("title"), rules.normalization), "_c": text.normalize(F.col("_raw"), rules.normalization), "_tail": text.normalize(F.right(text.strip(text.or_empty(F.col("content"))), F.lit(q.tail_chars)), rules.normalization), "_chars": text.dense_length(F.col("_raw")), "_items": numbered_items(F.col("_raw"), q.line_min_chars)})
    t, c, chars = F.col("_t"), F.col("_c"), F.col("_chars")
    must, combine = match.patterns(rules.must, rules), match.patterns(rules.combine, rules)
    direct = F.size(match.word_hits(c, must, rules))
    content_hits = F.when(direct > 0, direct).otherwise(F.size(match.combine_hits(c, combine, rules.strip_chars)))
    raw_text = F.concat_ws("\n", F.col("title"), F.col("_raw"))
    if isinstance(library, LibraryTables) and q.alg_enabled:
        base = with_signal(base, t, c, raw_text, library, q, rules)
    else:
        base = base.withColumn("_found", algorithm_signal(t, c, raw_text, q, rules, library if isinstance(library, Library) else None))
    all_tags = F.array_distinct(F.concat(text.tags(F.coalesce(tags, F.array().cast("array<string>"))), text.tail_hashtags(F.col("_tail"))))
    ads = numbered_ads(F.col("_raw"), q, rules)
    points = F.size("_items")
    parts = base.withColumns({
        "_title": title_score(F.size(match.word_hits(t, must, rules)), q), "_content": content_score(content_hits, q), "_key": keyword_score(t, c, q, rules),
        "_alg": F.col("_found.score"), "_tags": all_tags, "_promo": promotion_hits(t, c, q, rules), "_ads": ads,
        "_structure": structure_score(points, chars, q) if q.structure_enabled else text.length_score(chars, q.length_weight),
    })
    parts = parts.withColumn("_drain", tail_penalty(F.col("_tags"), q)).withColumn("_signal", F.col("_title") + F.col("_content") + F.col("_key") + F.col("_alg"))
    promo = (F.size("_promo") >= q.promo_min_hits) & F.lit(q.promo_enabled)
    ad = F.col("_ads.blocked") & F.lit(q.ad_enabled)
    parts = parts.withColumn("_match", match_score(F.col("_signal"), chars, tail_ratio(F.col("_drain"), q), q))
    raw = F.col("_structure") + F.col("_match") - F.when(promo, q.promo_penalty).otherwise(0) - F.when(ad, q.ad_penalty).otherwise(0)
    score = F.least(F.greatest(raw, F.lit(0)), F.lit(100))
    breakdown = F.struct(*[F.col(f"_{k}").alias(f"{k}_score") for k in ("title", "content", "key", "alg", "signal", "structure", "match")], F.col("_drain").alias("tail_penalty"), F.col("_promo").alias("promo_hits"), F.col("_ads").alias("numbered_ads"), promo.alias("promo_blocked"), chars.alias("content_chars"), F.col("_tags").alias("tail_tags"), F.col("_found").alias("algorithm"))
    return parts.select(*[F.col(f"`{x}`") for x in posts.columns], score.alias("quality_score"), ((score >= q.threshold) & ~promo & ~ad).alias("passed"), F.col("_items").alias("question_outline"), points.alias("question_outline_count"), breakdown.alias("breakdown"))

"""Which organisation a title is about: dictionary candidates, their scores, the best one.

Titles meet dictionaries by containment. Each entry is filed under its gram (two neighbouring
characters) that the fewest titles hold, and titles ask for the grams that they hold, so the
meeting is an equi-join that common beginnings do not heat up; the exact test follows. A
dictionary of a few entries is sent to the titles and tested entry by entry, without grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import or_empty, quoted, strip
from ..sources.tables import cut, sized

UNKNOWN = "其他"

#: Entries that are tested one by one; from there on grams are cheaper.
FEW = 200

# Dictionaries of organisations and words.
NOISE_WORDS = (
    "java", "python", "golang", "go", "c++", "cpp", "javascript", "js", "sql", "前端", "后端", "算法", "测试", "开发", "研发", "产品", "运营",
    "设计", "运维", "工程师", "面试", "面经", "实习", "校招", "秋招", "春招", "offer", "八股", "笔试", "高级", "中级", "初级", "资深", "专家",
    "总监", "主管", "leader", "岗位", "职位", "方向", "总结", "分享", "记录", "经验", "题目", "题解", "教程", "攻略", "agent", "大厂", "小厂",
    "信息", "慎投", "双非",
)
NON_COMPANY_FRAGMENTS = (
    "面经", "慎投", "保姆级", "教学", "双非", "纯八股", "八股", "不感兴趣", "三月", "四月", "事业部", "合集", "攻略", "经验贴", "问答", "大厂",
    "小厂", "怒砍", "这些公司", "总结....", "没有公司", "无公司", "公司名", "公司名称", "转码", "非科班", "科班",
)
GENERIC_PATTERNS = ("(没有|无|不含|缺少).{0,4}(公司|厂|企业)", "(公司|企业).{0,4}(没有|无|不含|缺少)", "(公司名|公司名称|公司简称)")
ORGANISATION_MARKERS = ("科技", "集团", "有限公司", "控股", "金融", "网络", "信息", "软件", "云计算", "研究院", "研究所", "中心", "银行", "证券", "电信", "移动", "联通")
ALIAS_MAP = {
    "字节跳动": "字节", "字节跳动tiktok": "字节", "tiktok": "字节", "飞书": "字节", "豆包": "字节", "抖音": "字节", "今日头条": "字节",
    "番茄小说": "字节", "番茄畅听": "字节", "西瓜视频": "字节", "火山引擎": "字节", "巨量引擎": "字节", "剪映": "字节", "抖音电商": "字节",
    "懂车帝": "字节", "荣耀": "字节", "阿里巴巴": "阿里", "淘天": "阿里", "蚂蚁": "阿里", "蚂蚁集团": "阿里", "蚂蚁金服": "阿里",
    "支付宝": "阿里", "菜鸟网络": "阿里", "饿了么": "阿里", "高德地图": "阿里", "qq": "腾讯", "微信": "腾讯", "wechat": "腾讯",
    "qq音乐": "腾讯", "腾讯视频": "腾讯", "微信视频号": "腾讯", "美团点评": "美团", "京东数科": "京东", "pdd": "拼多多", "shopee": "虾皮",
    "哔哩哔哩": "b站", "bilibili": "b站", "腾讯teg": "腾讯", "腾讯云": "腾讯",
}
PRODUCT_ALIASES = {
    "飞书": "字节", "豆包": "字节", "番茄小说": "字节", "番茄畅听": "字节", "西瓜视频": "字节", "火山引擎": "字节", "巨量引擎": "字节",
    "剪映": "字节", "今日头条": "字节", "懂车帝": "字节", "支付宝": "阿里", "高德地图": "阿里", "饿了么": "阿里", "微信": "腾讯",
    "QQ": "腾讯", "QQ音乐": "腾讯",
}
NICKNAMES = {"鹅厂": "腾讯", "tx": "腾讯", "ali": "阿里", "猪厂": "网易", "拼夕夕": "拼多多", "bili": "b站", "菊厂": "华为"}
OWNER_ALIASES = {
    "懂车帝": "字节", "荣耀": "字节", "番茄小说": "字节", "番茄畅听": "字节", "西瓜视频": "字节", "火山引擎": "字节", "巨量引擎": "字节",
    "剪映": "字节", "今日头条": "字节", "抖音电商": "字节", "高德地图": "阿里", "饿了么": "阿里", "菜鸟网络": "阿里", "QQ音乐": "腾讯",
    "腾讯视频": "腾讯", "微信视频号": "腾讯",
}
RELATION_HINTS = ("是哪个公司的", "属于", "旗下", "母公司", "控股", "集团")
STRONG_MARKERS = ("有限公司", "股份有限公司", "集团", "控股", "公司")
WEAK_MARKERS = ("企业", "科技", "信息", "网络", "软件", "电子", "银行", "证券", "保险", "资本", "物流", "医药", "药业", "投资")
NEGATIVE_MARKERS = ("教程", "题", "是什么意思", "怎么", "区别", "学习", "岗位", "工资", "简历")
MAJOR_BRANDS = ("阿里巴巴", "腾讯", "百度", "字节跳动", "美团", "京东", "网易", "快手", "拼多多", "华为", "小米", "滴滴")
BRAND_CONTEXT = ("官网", "登录", "收款", "企业")
#: Weight of a dictionary, separators around a name, and words that segments lose.
SOURCE_WEIGHT = {"product_alias": 130, "owner_alias": 126, "nickname_alias": 120, "alias_map": 110, "known_company": 100, "dynamic_verified": 95, "owner_inferred": 92, "title_pattern": 70}
SEPARATORS = r"-\[\]【】|/，：_\s"
SEGMENT_NOISE = (
    r"^(\d{3,4}|\d+\.\d+|\d+届)",
    r"(?i)(前端|后端|测试|运维|算法|数据|产品|运营|设计|产品经理|运营专员|开发|研发|全栈|客户端|服务端|架构|大模型|ai应用|ai|java|c\+\+|cpp|python|golang|go|工程师|规划师|实习生|全职|端|岗)",
    r"(?i)(一二三面|初面|终面|一面|二面|三面|四面|hr面|主管面|总监面|交叉面|面试|面经|面|笔试|机试|测评)",
    r"(?i)(求职|招聘|内推|实习|校招|社招|日常|暑期|秋招|春招|提前批|分享|记录|攒人品|已挂|意向|offer|挂了|挂|上岸|白菜|sp|ssp|依然)",
)


def any_of(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def plausible_name(c: Column) -> Column:
    """Whether a string can be an organisation's name."""
    w = strip(or_empty(c))
    low = F.lower(w)
    generic = reduce(lambda a, b: a | b, [low.rlike(p) for p in GENERIC_PATTERNS])
    long_han = w.rlike(r"^[一-鿿]{9,}$") & ~any_of(w, ORGANISATION_MARKERS)
    bad = w.rlike(r"(?U)^\d+$") | low.isin(*NOISE_WORDS) | generic | any_of(w, NON_COMPANY_FRAGMENTS) | w.rlike("[?？!！]") | w.rlike("[.。…]{2,}") | long_han
    return (F.length(w) >= 2) & (F.length(w) <= 25) & ~bad


def looks_like_token(c: Column) -> Column:
    """Whether a title's token can be an organisation: a Latin name, or a plausible Han one."""
    w = strip(or_empty(c))
    latin = w.rlike(r"^[a-zA-Z][a-zA-Z0-9&._-]{2,20}$") & ~F.lower(w).isin(*NOISE_WORDS)
    han = w.rlike("[一-鿿]") & w.rlike("^[一-鿿A-Za-z0-9&._-]+$") & plausible_name(w)
    return (F.length(w) >= 2) & (F.length(w) <= 20) & (latin | han)


def canonical(c: Column, aliases: dict[str, str] = ALIAS_MAP) -> Column:
    """The organisation behind an alias, else the name itself."""
    w = strip(or_empty(c))
    if not aliases:
        return w
    table = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k.lower()), F.lit(v))])
    return F.coalesce(F.element_at(table, F.lower(w)), w)


def is_latin(token: Column) -> Column:
    return token.rlike("[A-Za-z0-9]")


def position(title: Column, token: Column) -> Column:
    """Where token stands in title from 0, whole words only for tokens with ASCII letters or digits; -1 if nowhere."""
    pattern = F.concat(F.lit("(?i)(?<![a-zA-Z0-9])\\Q"), token, F.lit("\\E(?![a-zA-Z0-9])"))
    # A plain test first: the pattern differs by row and is not compiled for nothing.
    plain = F.instr(F.lower(title), F.lower(token))
    return F.when((F.length(token) == 0) | (plain == 0), -1).when(is_latin(token), F.regexp_instr(title, pattern) - 1).otherwise(plain - 1)


def candidate_score(title: Column, token: Column, weight: Column) -> Column:
    """Score of a candidate: its dictionary, its place, its length, and separators around it."""
    p = position(title, token)
    place = F.when(p == 0, 40).when(p <= 2, 30).when(p <= 6, 20).otherwise(F.greatest(F.lit(5), 15 - F.least(p, F.lit(15))))
    bounded = F.rlike(title, F.concat(F.lit(f"(?iU)(^|[{SEPARATORS}])\\Q"), token, F.lit(f"\\E($|[{SEPARATORS}])")))
    score = weight + place + F.least(F.length(token), F.lit(12)) * 3 + F.when(bounded, 20).otherwise(0)
    return F.when(p < 0, -1).otherwise(score)


def dictionary(spark: SparkSession, companies: list[str], owner: dict[str, str] | None = None) -> DataFrame:
    """(alias, company, source, weight, rule) of all dictionaries, in the order of their passes."""
    owners = OWNER_ALIASES | (owner or {})
    rows = []
    for source, pairs in (("product_alias", PRODUCT_ALIASES), ("nickname_alias", NICKNAMES), ("owner_alias", owners), ("alias_map", ALIAS_MAP), ("known_company", {c: c for c in companies})):
        rows += [(a.strip(), b.strip(), source, SOURCE_WEIGHT[source], len(rows) + i) for i, (a, b) in enumerate(pairs.items()) if a.strip() and b.strip()]
    return spark.createDataFrame(rows, "alias string, company string, source string, weight int, rule int")


def grams(c: Column, alone: bool) -> Column:
    """Distinct pairs of neighbouring characters in lower case; with alone, single ones too."""
    chars = F.split(F.lower(c), "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, F.lit(2), F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_union(pairs, chars) if alone else F.array_distinct(F.when(F.size(pairs) > 0, pairs).otherwise(chars))


def signatures(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """(alias, k, n): the gram under which an entry is filed, of those it holds the one that the
    fewest titles hold, and by how many."""
    held = entries.select("alias").distinct().withColumn("k", F.explode(grams(F.col("alias"), False)))
    # Counted before the meeting: a row a gram and task is shuffled, whatever the dictionary's size.
    count = titles.select(F.explode(grams(F.col("title"), True)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    known = held.join(count.hint("merge"), "k", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return known.groupBy("alias").agg(F.min(F.struct("n", "k")).alias("x")).select("alias", "x.k", "x.n")


def few(entries: DataFrame) -> bool:
    return entries.limit(FEW + 1).count() <= FEW


def meetings(titles: DataFrame, entries: DataFrame) -> DataFrame:
    """Titles with the entries whose gram they hold: all that contain an entry, and few more. The
    dictionary is written and sent to the titles; only a large one is met by a merge."""
    entries = cut(entries)
    if few(entries):
        low = titles.select("seq", "title", F.lower("title").alias("_low"))
        return low.join(F.broadcast(entries), F.contains(F.col("_low"), F.lower("alias"))).drop("_low")
    filed = cut(entries.join(signatures(titles, entries).where("n > 0").select("alias", "k"), "alias"))
    asked = titles.select("seq", "title", F.explode(grams(F.col("title"), True)).alias("k"))
    return asked.join(sized(filed), "k").drop("k")


def contained(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts(seq, text) with `found`: those of words(word) that the text holds, sorted. Long texts
    do not travel with their grams: the few words that may be there are gathered by `seq`, joined
    to the texts, and tested there. Both sides must be in the same case."""
    titles, entries = texts.select("seq", F.col("text").alias("title")), cut(words.select(F.col("word").alias("alias")).where("alias <> ''").distinct())
    if few(entries):
        met = texts.crossJoin(F.broadcast(entries.agg(F.collect_list("alias").alias("_maybe"))))  # one row
    else:
        filed = cut(signatures(titles, entries).where("n > 0").select("alias", "k"))
        asked = titles.select("seq", F.explode(grams(F.col("title"), True)).alias("k"))
        maybe = asked.join(sized(filed), "k").groupBy("seq").agg(F.collect_set("alias").alias("_maybe"))
        met = texts.join(maybe.hint("merge"), "seq", "left")
    found = F.filter(F.coalesce("_maybe", F.array().cast("array<string>")), lambda w: F.contains(F.col("text"), w))
    return met.withColumn("found", F.array_sort(found)).drop("_maybe")


def candidates(titles: DataFrame, entries: DataFrame, aliases: dict[str, str] = ALIAS_MAP, only: DataFrame | None = None) -> DataFrame:
    """(seq, company, alias, source, score, pos, len, rule) of the entries that titles(seq,
    title) contain; only(company): the organisations allowed."""
    named = entries.withColumn("company", canonical(F.col("company"), aliases))
    if only is not None:
        named = named.join(only.select("company").distinct(), "company", "left_semi")
    met = meetings(titles, named)
    scored = met.withColumn("pos", position(F.col("title"), F.col("alias"))).where("pos >= 0")
    scored = scored.withColumn("score", candidate_score(F.col("title"), F.col("alias"), F.col("weight")))
    return scored.select("seq", "company", "alias", "source", "score", "pos", F.length("alias").alias("len"), "rule").distinct()


def best_company(titles: DataFrame, found: DataFrame) -> DataFrame:
    """titles with `company`: that of the best candidate, or UNKNOWN."""
    w = Window.partitionBy("seq").orderBy(F.desc("score"), F.desc("len"), "pos", "rule", "company")
    top = found.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("seq", "company")
    return titles.join(top.hint("merge"), "seq", "left").withColumn("company", F.coalesce("company", F.lit(UNKNOWN)))


def title_tokens(title: Column) -> Column:
    """Candidate tokens of a title for lookups: its segments without job and interview words."""
    segments = F.transform(F.split(or_empty(title), r"(?U)[-\[\]【】|/，：_+\s]+"), strip)
    first, *rest = SEGMENT_NOISE
    made = F.transform(segments, lambda s: F.regexp_replace(s, first, ""))
    for p in rest:
        made = _blanked(made, p)
    words = F.flatten(F.transform(made, lambda s: F.split(strip(s), r"(?U)\s+")))
    words = F.transform(words, lambda x: F.regexp_replace(x, "^[+“”，。、？！：；]+|[+“”，。、？！：；]+$", ""))
    return F.array_distinct(F.filter(words, looks_like_token))


def _blanked(c: Column, pattern: str) -> Column:
    return F.transform(c, lambda s: F.regexp_replace(s, pattern, " "))


def skip_tokens(companies_owner: dict[str, str] | None = None) -> list[str]:
    """Tokens that need no lookup: every alias, in lower case."""
    every = {**ALIAS_MAP, **PRODUCT_ALIASES, **NICKNAMES, **OWNER_ALIASES, **(companies_owner or {})}
    return sorted({k.lower() for k in every})


def pending_tokens(titles: DataFrame, known: DataFrame, limit: int = 80) -> DataFrame:
    """Tokens of titles that no lookup knows yet: token, n, the most frequent limit of them."""
    tokens = titles.select(F.explode(title_tokens(F.col("title"))).alias("token")).where(~F.lower("token").isin(*skip_tokens()))
    new = tokens.join(known.select("token").distinct(), "token", "left_anti")
    return new.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(limit)


def dynamic_candidates(titles: DataFrame, verified: DataFrame, owners: DataFrame, aliases: dict[str, str] = ALIAS_MAP) -> DataFrame:
    """Candidates from a title's own tokens, where the whitelist is off: those that the lookup
    verified(token, is_company) affirms, and those whose owner owners(token, company) gives."""
    tokens = titles.select("seq", "title", F.explode(title_tokens(F.col("title"))).alias("token")).where(~F.lower("token").isin(*skip_tokens()))
    sure = tokens.join(verified.where("is_company").select("token").distinct(), "token").select("*", canonical(F.col("token"), aliases).alias("company"), F.lit("dynamic_verified").alias("source"))
    owned = tokens.join(owners.select("token", "company").distinct(), "token").select("seq", "title", "token", canonical(F.col("company"), aliases).alias("company"), F.lit("owner_inferred").alias("source"))
    both = sure.select("seq", "title", "token", "company", "source").union(owned)
    weight = F.when(F.col("source") == "dynamic_verified", SOURCE_WEIGHT["dynamic_verified"]).otherwise(SOURCE_WEIGHT["owner_inferred"])
    scored = both.withColumn("pos", position(F.col("title"), F.col("token"))).where("pos >= 0").withColumn("score", candidate_score(F.col("title"), F.col("token"), weight))
    return scored.select("seq", "company", F.col("token").alias("alias"), "source", "score", "pos", F.length("token").alias("len"), F.lit(1 << 20).alias("rule"))


def refresh_lookups(pending: DataFrame, suggestions: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows of both lookups for pending(token), from suggestions(token, arr): what is an
    organisation, and whose a product is."""
    found = pending.select("token").distinct().join(suggestions, "token", "left").withColumn("arr", F.coalesce("arr", F.array().cast("array<string>")))
    verified = found.select("token", F.coalesce(verdict(F.col("token"), F.col("arr")), F.lit(False)).alias("is_company"))
    return verified, infer_owner(found, entries)


def learnt(titles: DataFrame, suggestions: DataFrame, entries: DataFrame, verified: DataFrame, owners: DataFrame, at: int, limit: int = 80) -> tuple[DataFrame, DataFrame]:
    """What a run adds to the saved lookups (token, value, at), from titles of no known
    organisation: for the tokens that verified does not know yet, the most frequent first."""
    pending = pending_tokens(titles, verified, limit)
    sure, owned = refresh_lookups(pending, suggestions, entries)
    return sure.select("token", F.col("is_company").alias("value"), F.lit(at).alias("at")), owned.select("token", F.col("company").alias("value"), F.lit(at).alias("at"))


def verdict(word: Column, suggestions: Column) -> Column:
    """Whether search suggestions speak for an organisation called word."""
    s = F.filter(F.transform(F.slice(suggestions, 1, 10), lambda x: strip(or_empty(x))), lambda x: F.length(x) > 0)
    low = F.lower(word)
    says = lambda x: F.contains(F.lower(x), low)
    count = lambda test: F.size(F.filter(s, test))
    strong = lambda x: any_of(x, STRONG_MARKERS)
    mentions, prefix = count(says), count(lambda x: F.startswith(F.lower(x), low))
    n_strong, n_weak, n_bad = count(strong), count(lambda x: any_of(x, WEAK_MARKERS)), count(lambda x: any_of(x, NEGATIVE_MARKERS))
    brand = count(lambda x: says(x) & any_of(x, BRAND_CONTEXT))
    major = F.exists(s, lambda x: F.contains(x, word) & any_of(x, MAJOR_BRANDS))
    out = F.when(F.size(s) == 0, False).when(F.exists(s, lambda x: says(x) & strong(x)), True)
    out = out.when(word.rlike("^[a-zA-Z][a-zA-Z0-9&._-]{1,20}$"), (mentions >= 2) & ((prefix >= 1) | (brand >= 1)))
    out = out.when(word.rlike("^[一-鿿]{2,3}$"), (n_strong >= 1) | major)
    return out.otherwise((mentions >= 2) & (mentions + prefix + 2 * n_weak + 3 * n_strong - n_bad >= 6))


def infer_owner(lookups: DataFrame, entries: DataFrame, aliases: dict[str, str] = ALIAS_MAP, most: int = 12, hints: tuple[str, ...] = RELATION_HINTS, least: int = 4, key: str = "token") -> DataFrame:
    """(key, company, score): the organisation that the suggestions of lookups(token, arr) point
    to, where the evidence reaches least. key names a lookup; it is the token itself as a rule."""
    own = lookups.select(F.col(key).alias("_key"), "token", F.slice("arr", 1, most).alias("arr"))
    rows = own.select("_key", "token", F.posexplode("arr").alias("i", "text")).where("trim(coalesce(text, '')) <> ''")
    gain = F.lit(2) + F.when(any_of(F.col("text"), hints), 2).otherwise(0) + F.when(position(F.col("text"), F.col("token")) >= 0, 1).otherwise(0)
    # Texts are written once and stay where they are: what meets by their hash are numbers.
    rows = cut(rows.select("_key", F.xxhash64("text").alias("seq"), gain.alias("gain"), "text"))
    met = candidates(rows.select("seq", F.col("text").alias("title")), entries, aliases).select("seq", "alias", "company").distinct()
    scored = rows.select("_key", "seq", "gain").join(met.hint("merge"), "seq").groupBy("_key", "company").agg(F.sum("gain").cast("int").alias("score"))
    w = Window.partitionBy("_key").orderBy(F.desc("score"), "company")
    best = scored.withColumn("_rn", F.row_number().over(w)).where(f"_rn = 1 and score >= {least}")
    return best.select(F.col("_key").alias(key), "company", "score")

"""Configuration: layered JSON files merged in order, and the defaults of the rules."""

from __future__ import annotations

import json
from copy import deepcopy
from dataclasses import dataclass, field
from pathlib import Path

#: Layers in the order in which they apply; a later one wins, lists are replaced.
LAYERS = ("advanced.template.json", "advanced.json", "debug.template.json", "debug.json", "app.template.json", "app.json", "local.override.json")


def merge(base: dict, over: dict) -> dict:
    """base with over laid on top, nested dictionaries key by key."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def read_layer(path: Path) -> dict:
    """A JSON object; a missing or broken file is an empty layer."""
    try:
        found = json.loads(path.read_text(encoding="utf-8-sig"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def load(folder: str | Path, layers: tuple[str, ...] = LAYERS) -> dict:
    out: dict = {}
    for name in layers:
        out = merge(out, read_layer(Path(folder) / name))
    root = Path(folder).parent
    for key in ("companies_path", "company_runtime_cache_path"):
        if isinstance(out.get(key), str) and out[key] and not Path(out[key]).is_absolute():
            out[key] = str(root / out[key])
    return out


@dataclass(frozen=True)
class Keyword:
    """A weighted keyword: scope title, content or both; repeated: each occurrence counts."""

    keyword: str
    weight: int
    scope: str = "content"
    repeated: bool = False


@dataclass(frozen=True)
class Normalization:
    nfkc: bool = True
    map_digits: bool = True
    strip_zero_width: bool = True
    collapse_repeats: bool = False
    repeat_threshold: int = 3
    aliases: tuple[tuple[str, str], ...] = ()
    unify_punctuation: bool = True
    fold_spaces: bool = True


@dataclass(frozen=True)
class Rules:
    """Pattern filters on title and content."""

    must: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    title_force: tuple[str, ...] = ()
    combine: tuple[str, ...] = ()
    #: Fixed value: characters that combine and skip matching pass over.
    strip_chars: str = " \t\r\n-_/|,，.。·!！?？:：;；~`'\"()[]{}<>*+&^%$#@"
    skip_enabled: bool = False
    max_skips: int = 2
    normalization: Normalization = Normalization()


@dataclass(frozen=True)
class Quality:
    """Weights and caps of the quality score. Fixed values, as the shipped template has them."""

    threshold: int = 62
    title_hit_weight: int = 12
    title_hit_cap: int = 36
    content_hit_weight: int = 8
    content_hit_cap: int = 34
    ideal_chars: int = 2200
    min_chars: int = 240
    short_chars: int = 420
    length_weight: int = 70
    structure_enabled: bool = True
    target_points: int = 8
    min_points: int = 3
    line_min_chars: int = 6
    structure_max: int = 50
    match_max: int = 50
    missing_penalty: int = 20
    noise_chars: int = 1000
    noise_step_chars: int = 240
    noise_step_penalty: int = 4
    noise_cap: int = 30
    promo_min_hits: int = 2
    promo_penalty: int = 45
    promo_words: tuple[str, ...] = ("卖课", "课程咨询", "付费咨询", "训练营", "一对一辅导", "简历优化", "内推陪跑", "求职辅导", "小班课", "社群答疑")
    ad_follow_chars: int = 80
    ad_follow_lines: int = 1
    ad_min_items: int = 2
    ad_ratio: float = 0.5
    ad_penalty: int = 40
    ad_marker_hits: int = 3
    ad_markers: tuple[str, ...] = ("答：", "回答思路", "例如", "举例", "面试官", "这个问题", "比较好的回答方式", "重点放在", "你可以这样回答")
    keyword_max: int = 44
    keywords: tuple[Keyword, ...] = (
        Keyword("mysql", 12),
        Keyword("索引", 10),
        Keyword("缓存", 10),
        Keyword("事务", 8),
        Keyword("并发", 8),
        Keyword("redis", 8),
        Keyword("mq", 7),
    )
    tail_chars: int = 260
    tail_tag_penalty: int = 3
    tail_tag_cap: int = 24
    tail_drain_cap: int = 30
    tail_drain: tuple[tuple[str, int], ...] = (
        ("内推", 15), ("简历", 12), ("互助", 8), ("咨询", 8), ("联系", 8), ("关注", 8), ("微信", 20), ("vx", 18),
        ("面试", 3), ("校招", 3), ("秋招", 3), ("春招", 3), ("实习", 2),
    )
    promo_enabled: bool = True
    ad_enabled: bool = True
    alg_enabled: bool = True
    hot_enabled: bool = True
    alg_context_required: bool = True
    alg_reach: int = 24
    alg_total_cap: int = 60
    alg_marker: tuple[int, int] = (10, 20)
    alg_topic: tuple[int, int] = (4, 24)
    alg_problem: tuple[int, int] = (7, 42)
    alg_id: tuple[int, int] = (6, 24)
    hot_total_cap: int = 48
    hot_title_cap: int = 30
    hot_id_cap: int = 26
    hot_scale: float = 3.6
    hot_base: float = 10.0
    hot_max: int = 12
    alg_markers: tuple[str, ...] = ("leetcode", "力扣", "hot100", "hot 100", "lc", "算法题", "刷题", "题解", "coding interview")
    alg_context: tuple[str, ...] = ("算法", "算法题", "手撕", "手写", "力扣", "leetcode", "lc", "刷题", "题解", "编程题", "hot100", "hot 100", "coding interview")
    alg_topics: tuple[str, ...] = ()
    alg_titles: tuple[str, ...] = ()


@dataclass(frozen=True)
class Selection:
    """How many posts a keyword keeps, and the elastic pool."""

    items: int = 10
    fill_quota: bool = False
    multiplier: float = 1.5
    max_multiplier: float = 2.2
    max_pool: int = 0
    step_ratio: float = 0.25
    elastic: bool = True
    replace_threshold: int = 6
    idle_rounds: int = 3
    batch: int = 8

    def _up(self, factor: float) -> int:
        import math

        return max(math.ceil(self.items * factor), self.items)

    @property
    def pool(self) -> int:
        return self._up(self.multiplier)

    @property
    def pool_max(self) -> int:
        most = max(self._up(self.max_multiplier), self.pool)
        return max(min(most, self.max_pool), self.pool) if self.max_pool > 0 else most

    @property
    def pool_step(self) -> int:
        import math

        return max(1, math.ceil(self.items * self.step_ratio))


def page_limit(pages: int, items: int, fill_quota: bool, hard_limit: int = 50) -> int:
    """Pages to visit: as asked, or enough to fill a quota within a hard limit."""
    return min(max(pages, 3 * items, 4 * pages), hard_limit) if fill_quota else pages


@dataclass(frozen=True)
class Settings:
    rules: Rules = field(default_factory=Rules)
    quality: Quality = field(default_factory=Quality)
    selection: Selection = field(default_factory=Selection)
    pages: int = 5
    owners: tuple[tuple[str, str], ...] = ()


def stable_hash(raw: dict) -> str:
    """SHA-256 of a configuration, whatever the order of its keys."""
    import hashlib

    return hashlib.sha256(json.dumps(raw, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def tokens(pattern: str) -> list[str]:
    """The words of a pattern text: parted by white space, commas and the like, brackets and
    quotes at their ends left out."""
    import re

    parts = (x.strip().strip("[](){}<>\"'`") for x in re.split(r"[\s,，;；、|/]+", pattern.strip()))
    return [x for x in parts if x]


def _listed(words: object) -> list:
    """A setting that is one text, a list, or nothing, as a list; anything else is nothing."""
    return [words] if isinstance(words, str) else list(words) if isinstance(words, (list, tuple)) else []


def _every(words: object) -> tuple[str, ...]:
    return tuple(t for w in _listed(words) for t in tokens(str(w or "")))


def _whole(words: object) -> tuple[str, ...]:
    return tuple(str(w) for w in _listed(words) if w is not None)


def _number(value: object, default: int) -> int:
    """A weight, 0 at least; what is no number is the default."""
    try:
        return max(int(value), 0)
    except (TypeError, ValueError):
        return default


def _weighted(entries: object, weight: int) -> tuple[Keyword, ...]:
    """Weighted keywords from {keyword: weight}, a text, or a list of texts and of entries."""
    rows = [{"keyword": k, "weight": v} for k, v in entries.items()] if isinstance(entries, dict) else _listed(entries)
    out = []
    for k in rows:
        k = {"keyword": k} if isinstance(k, str) else k
        if not isinstance(k, dict):
            continue
        scope = str(k.get("scope") or "both").strip().lower()
        for word in tokens(str(k.get("keyword") or "")):
            out.append(Keyword(word, _number(k.get("weight", weight), weight), scope if scope in ("title", "content") else "both", _count(k.get("count", k.get("count_mode", "once")))))
    return tuple(out)


def _drains(entries: object, penalty: int, rules: Normalization) -> tuple[tuple[str, int], ...]:
    """Words with penalties: those of {word: penalty} and of entries are whole, texts are parted
    and have the default; of a word's penalties the greatest counts."""
    from ..functions.text import normalize_local

    if isinstance(entries, dict):
        pairs = list(entries.items())
    else:
        pairs = []
        for x in _listed(entries):
            if isinstance(x, dict):
                pairs.append((x.get("keyword", ""), x.get("penalty", x.get("weight", penalty))))
            elif isinstance(x, str):
                pairs += [(t, penalty) for t in tokens(x)]
    out: dict[str, int] = {}
    for word, cost in pairs:
        key, n = normalize_local(str(word or "").strip(), rules), _number(cost, penalty)
        if key and n > 0:
            out[key] = max(out.get(key, n), n)
    return tuple(out.items())


def _aliases(entries: object) -> tuple[tuple[str, str], ...]:
    """(from, to) of {from: to} or of a list of {"from": ..., "to": ...}."""
    pairs = list(entries.items()) if isinstance(entries, dict) else [(x.get("from"), x.get("to")) for x in _listed(entries) if isinstance(x, dict)]
    made = [(str(a or "").strip(), str(b or "").strip()) for a, b in pairs]
    return tuple((a, b) for a, b in made if a)


def _section(raw: dict, name: str) -> dict:
    return raw[name] if isinstance(raw.get(name), dict) else {}


def _count(v: object) -> bool:
    return str(v).strip().lower() == "repeat"


def settings(raw: dict) -> Settings:
    """Typed settings of a merged configuration; an explicit 0 is kept."""
    f = _section(raw, "filter_rules")
    n, s, fc, sc = (_section(f, x) for x in ("normalization", "score_filter", "force_combine", "skip_char_match"))
    form = Normalization(n.get("enable_nfkc", True), n.get("map_digit_variants", True), n.get("strip_zero_width", True), n.get("collapse_repeats", False), int(n.get("repeat_threshold") or 3), _aliases(n.get("semantic_aliases")), bool(n.get("unify_punctuation", True)), bool(n.get("fold_spaces", True)))
    rules = Rules(
        must=_every(f.get("must_contain")), must_not=_whole(f.get("must_not_contain")), allow=_whole(f.get("allow_overrides")),
        title_force=_whole(fc.get("title_force_contains")), combine=_whole(fc.get("content_combine_contains")),
        strip_chars=fc.get("combine_strip_chars") or Rules.strip_chars, skip_enabled=bool(sc.get("enabled", False)), max_skips=int(sc.get("max_skips", 2)), normalization=form,
    )
    plain = {
        "threshold": "threshold", "title_hit_weight": "title_hit_weight", "title_hit_cap": "title_hit_cap", "content_hit_weight": "content_hit_weight",
        "content_hit_cap": "content_hit_cap", "ideal_chars": "length_ideal_chars", "min_chars": "length_min_chars", "short_chars": "short_content_chars",
        "target_points": "structure_target_points", "min_points": "structure_min_points", "structure_max": "structure_max_score", "match_max": "match_max_score",
        "missing_penalty": "structure_missing_penalty", "noise_chars": "structure_noise_chars_threshold", "noise_cap": "structure_noise_penalty_cap",
        "promo_min_hits": "promo_block_min_hits", "promo_penalty": "promo_block_penalty", "ad_penalty": "numbered_ad_penalty", "keyword_max": "weighted_keyword_max_score",
        "tail_chars": "tail_scan_chars", "tail_tag_penalty": "tail_tag_penalty", "tail_tag_cap": "tail_tag_penalty_cap", "tail_drain_cap": "tail_drain_penalty_cap",
    }
    plain |= {
        "structure_enabled": "structure_scoring_enabled", "line_min_chars": "structure_line_min_chars", "noise_step_chars": "structure_noise_penalty_step_chars",
        "noise_step_penalty": "structure_noise_penalty_per_step", "promo_enabled": "promo_block_enabled", "ad_enabled": "numbered_ad_block_enabled",
        "ad_follow_chars": "numbered_ad_follow_chars_threshold", "ad_follow_lines": "numbered_ad_follow_lines_threshold", "ad_min_items": "numbered_ad_block_min_items",
        "ad_ratio": "numbered_ad_block_ratio", "ad_marker_hits": "numbered_ad_marker_block_hits", "length_weight": "length_weight",
        "alg_enabled": "alg_enabled", "hot_enabled": "alg_hot_enabled", "alg_context_required": "alg_context_required", "alg_reach": "alg_context_prefix_chars",
        "alg_total_cap": "alg_total_cap", "hot_total_cap": "alg_hot_total_cap", "hot_title_cap": "alg_hot_title_cap", "hot_id_cap": "alg_hot_id_cap",
        "hot_scale": "alg_hot_freq_scale", "hot_base": "alg_hot_log_base", "hot_max": "alg_hot_max_per_problem",
    }
    # A value takes the type of its default.
    given = {ours: type(getattr(Quality, ours))(s[theirs]) for ours, theirs in plain.items() if s.get(theirs) is not None}
    for ours, theirs in (("alg_marker", "alg_marker"), ("alg_topic", "alg_topic"), ("alg_problem", "alg_problem"), ("alg_id", "alg_problem_id")):
        weight, cap = getattr(Quality, ours)
        given[ours] = (int(s.get(f"{theirs}_weight", weight)), int(s.get(f"{theirs}_cap", cap)))
    for ours, theirs in (("alg_markers", "alg_markers"), ("alg_context", "alg_context_prefix_keywords"), ("alg_topics", "alg_topic_keywords"), ("alg_titles", "alg_problem_titles")):
        if theirs in s:
            given[ours] = _whole(s[theirs])
    if "promo_block_words" in s:
        given["promo_words"] = _whole(s["promo_block_words"])
    if "numbered_ad_markers" in s:
        given["ad_markers"] = _whole(s["numbered_ad_markers"])
    if "weighted_keywords" in s:
        given["keywords"] = _weighted(s["weighted_keywords"], max(int(s.get("default_keyword_weight") or 6), 1))
    if "tail_drain_words" in s:
        given["tail_drain"] = _drains(s["tail_drain_words"], max(int(s.get("default_tail_drain_penalty") or 6), 1), form)
    selection = Selection(
        items=int(raw.get("max_items_per_keyword", 10)), fill_quota=bool(raw.get("fill_valid_quota", False)), multiplier=float(s.get("heap_pool_multiplier", 1.5)), max_multiplier=float(s.get("heap_elastic_max_multiplier", 2.2)), max_pool=int(s.get("heap_max_pool", 0)),
        step_ratio=float(s.get("heap_elastic_step_ratio", 0.25)), elastic=bool(s.get("heap_elastic_enabled", True)), replace_threshold=int(s.get("heap_elastic_replace_threshold", 6)),
        idle_rounds=int(s.get("heap_elastic_shrink_idle_rounds", 3)), batch=max(int(s.get("parallel_batch_size", 8)), 1),
    )
    owners = tuple((str(k or "").strip(), str(v or "").strip()) for k, v in _section(raw, "company_owner_aliases").items())
    return Settings(rules, Quality(**given), selection, int(raw.get("max_pages") or 5), owners)

"""Pattern matching as Column expressions: filters of titles and contents, hit sets, counts.

A small dictionary is a literal array and stays in the JVM; from AUTOMATON patterns on, or COUNTED
counted ones, one pass of an automaton over the text takes its place, with the same results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.config import Rules
from .automaton import occurrences
from .text import bound, normalize_local, or_empty, quoted

AUTOMATON, COUNTED = 400, 32


def patterns(words: list[str] | tuple[str, ...], rules: Rules = Rules(), least: int = 1) -> list[str]:
    """Words normalised as texts are, each once, in their order."""
    made = (normalize_local(w, rules.normalization) for w in words)
    return list(dict.fromkeys(w for w in made if len(w) >= least))


def array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def any_hit(text: Column, words: list[str]) -> Column:
    """Whether one of the words is in the text."""
    if len(words) >= AUTOMATON:
        return F.size(automaton_hits(text, words)) > 0
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def hits(text: Column, words: list[str]) -> Column:
    """Those of the words that are in the text, in the words' order."""
    if len(words) >= AUTOMATON:
        return automaton_hits(text, words)
    return F.filter(array(words), lambda w: F.contains(text, w))


def count_hits(text: Column, words: list[str]) -> Column:
    """How many of the words are in the text."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words], F.lit(0))


def automaton_hits(text: Column, words: list[str]) -> Column:
    """hits by one automaton over all words."""
    names, empty = [w for w in dict.fromkeys(words) if w], [w for w in words if not w][:1]
    found = F.transform(occurrences(text, names)["at"], lambda i: F.element_at(array(names), i + 1))
    return F.concat(array(empty), found) if empty else found


def overlapping_count(text: Column, word: str) -> Column:
    """Occurrences of word, overlapping ones too."""
    return F.regexp_count(text, F.lit(f"(?=\\Q{word}\\E)"))


def weighted(found: Column, weights: list[int], repeated: bool) -> Column:
    """Sum of the weights of what occurrences found, times how often if repeated."""
    table = F.array(*[F.lit(w) for w in weights])
    pairs = F.arrays_zip(found["at"].alias("at"), found["n"].alias("n"))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + F.element_at(table, x["at"] + 1) * (x["n"] if repeated else F.lit(1)))


def weighted_counts(title: Column, content: Column, entries: list[tuple[str, str, bool, int]]) -> Column:
    """Sum over entries (word, scope, repeated, weight) of the weight of those that are in their
    scope, times their occurrences if repeated; each text is read once, whatever the entries."""
    words = list(dict.fromkeys(w for w, *_ in entries if w))
    place = {w: i for i, w in enumerate(words)}

    def weights(wanted: tuple[str, ...], repeated: bool) -> list[int]:
        out = [0] * len(words)
        for w, scope, often, weight in entries:
            if w and scope in wanted and often == repeated:
                out[place[w]] += weight
        return out

    def total(t: Column, c: Column) -> Column:
        either = F.struct(F.array_union(t["at"], c["at"]).alias("at"), F.array().cast("array<int>").alias("n"))
        parts = [(t, ("title",), False), (c, ("content",), False), (either, ("both",), False), (t, ("title", "both"), True), (c, ("content", "both"), True)]
        used = [(found, weights(scopes, often), often) for found, scopes, often in parts]
        return reduce(lambda a, b: a + b, [weighted(found, w, often) for found, w, often in used if any(w)], F.lit(0))

    return bound(F.struct(occurrences(title, words).alias("t"), occurrences(content, words).alias("c")), lambda x: total(x["t"], x["c"]))


def keyword_count(text: Column, word: str) -> Column:
    """Occurrences of a keyword: whole words if it is of ASCII letters and digits, else
    anywhere, not overlapping."""
    q = quoted(word)
    if word.isascii() and word.isalnum():
        q = f"(?<![a-z0-9]){q}(?![a-z0-9])"
    return F.regexp_count(text, F.lit(q))


def compact(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def combine_hits(text: Column, words: list[str], chars: str) -> Column:
    """Words found when punctuation and spaces are left out of text and words."""
    table = {ord(c): None for c in chars}
    short = [w for w in dict.fromkeys(x.translate(table) for x in words) if len(w) >= 2]
    return hits(compact(text, chars), short)


def skip_pattern(word: str, chars: str, most: int) -> str:
    """A pattern for word with up to most of chars between its characters."""
    gap = "[" + "".join("\\" + c if c in r"\]^-[&" else c for c in chars) + f"]{{0,{most}}}"
    return gap.join(quoted(c) for c in word)


def skip_hits(text: Column, words: list[str], chars: str, most: int) -> Column:
    """Words of more than one character that are in the text with skips."""
    found = [F.when(text.rlike(skip_pattern(w, chars, most)), F.lit(w)) for w in words if len(w) > 1]
    return F.array_compact(F.array(*found)) if found else array([])


def word_hits(text: Column, words: list[str], rules: Rules) -> Column:
    """Direct hits, and those with skips where they are on."""
    plain = hits(text, words)
    return F.array_union(plain, skip_hits(text, words, rules.strip_chars, rules.max_skips)) if rules.skip_enabled else plain


def allowed(title: Column, content: Column, rules: Rules) -> Column:
    """An allow pattern in the title or the content."""
    words = patterns(rules.allow, rules)
    return any_hit(title, words) | any_hit(content, words)


def title_passes(title: Column, rules: Rules) -> Column:
    """No forbidden word in the title, or an allow pattern there."""
    return any_hit(title, patterns(rules.allow, rules)) | ~any_hit(title, patterns(rules.must_not, rules))


def relevant(title: Column, content: Column, rules: Rules) -> Column:
    """Whether a post matches, by its normalised title and content."""
    must = patterns(rules.must, rules)
    if not must:
        return F.lit(True)
    forced = patterns(rules.title_force, rules)
    force = any_hit(title, forced) if forced else F.lit(True)
    in_title = F.size(word_hits(title, must, rules)) > 0 if rules.skip_enabled else any_hit(title, must)
    in_content = F.size(word_hits(content, must, rules)) > 0 if rules.skip_enabled else any_hit(content, must)
    combined = F.size(combine_hits(content, patterns(rules.combine, rules), rules.strip_chars)) > 0
    return allowed(title, content, rules) | (force & in_title & (in_content | combined))


def longest_only(found: Column) -> Column:
    """Hits that lie in no other hit."""
    return bound(found, lambda every: F.filter(every, lambda x: ~F.exists(every, lambda y: (x != y) & F.contains(y, x))))


def in_context(text: Column, title: str | Column, context: list[str], reach: int = 24) -> Column:
    """Whether a context word ends within reach characters before an occurrence of title;
    without context words or reach every occurrence counts."""
    if not context or reach <= 0:
        return F.lit(True)
    before = "|".join(f"\\Q{k}\\E.{{0,{reach - len(k)}}}" for k in context if len(k) <= reach)
    if not before:
        return F.lit(False)
    title = F.lit(title) if isinstance(title, str) else title
    return F.regexp_like(text, F.concat(F.lit(f"(?s)(?:{before})\\Q"), title, F.lit("\\E")))


#: Ways in which a problem's number is written.
ID_PATTERNS = (
    r"(?:第\s*|题号\s*[:：]?\s*)(\d{1,4})\s*题?",
    r"(?<!\d)(\d{1,4})\s*题(?!\d)",
    r"(?:算法题|leetcode题|力扣题)\s*[:：]?\s*(\d{1,4})(?=\s|$|[\.．、\)]|[，。；;,:：!！?？#])",
    r"(?:lc|leetcode|力扣)\s*[-#：: ]\s*(\d{1,4})",
)


def problem_ids(text: Column, known: Column | None = None) -> Column:
    """Numbers of problems that a text names, ascending; only known ones if given."""
    t = F.translate(or_empty(text), "０１２３４５６７８９", "0123456789")
    every = F.concat(*[F.regexp_extract_all(t, F.lit("(?iU)" + p), F.lit(1)) for p in ID_PATTERNS])
    ids = F.filter(F.array_distinct(F.transform(every, lambda x: x.cast("int"))), lambda x: x > 0)
    return F.array_sort(F.array_intersect(ids, known) if known is not None else ids)

"""Text functions as Column expressions. Patterns use Java's Unicode classes where white
space or digits of other scripts count too."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.config import Normalization

#: Digits and punctuation in other writings.
DIGITS = ("零〇一二三四五六七八九壹贰叁肆伍陆柒捌玖两兩俩", "00123456789123456789222")
PUNCTUATION = ("，。；：！？（）【】《》“”‘’、·　", ",.;:!?()[]<>\"\"'',. ")
ZERO_WIDTH = "​﻿"


def quoted(text: str) -> str:
    """text as a literal in a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no expression for it."""
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML character references as characters."""
    import html

    return s.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def unescape_closed(s: pd.Series) -> pd.Series:
    """unescape for references that end in a semicolon; others, cut off or never meant, stay."""
    import html
    from html.entities import html5

    def read(m: re.Match) -> str:
        return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]

    known = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    return s.map(lambda t: known.sub(read, t), na_action="ignore")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: an expression that a lambda's body names is
    computed for each element, an argument is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize(c: Column, rules: Normalization = Normalization()) -> Column:
    """The form in which patterns and texts are compared: NFKC, lower case, one writing of
    punctuation and digits, no zero-width characters, white space folded."""
    out = or_empty(c)
    if rules.nfkc:
        out = nfkc(out)
    out = F.lower(out)
    if rules.unify_punctuation:
        out = F.translate(out, *PUNCTUATION)
    if rules.map_digits:
        out = F.translate(out, *DIGITS)
    if rules.strip_zero_width:
        out = F.translate(out, ZERO_WIDTH, "")
    if rules.fold_spaces:
        out = strip(F.regexp_replace(out, r"(?U)\s+", " "))
    for old, new in rules.aliases:
        out = F.replace(out, F.lit(old.lower()), F.lit(new.lower()))
    if rules.collapse_repeats:
        n = max(2, rules.repeat_threshold)
        out = F.regexp_replace(out, rf"(?s)(.)\1{{{n - 1},}}", "$1")
    return out


def normalize_local(text: str, rules: Normalization = Normalization()) -> str:
    """normalize for patterns on the driver."""
    import unicodedata

    out = unicodedata.normalize("NFKC", text) if rules.nfkc else text
    out = out.lower()
    out = out.translate(str.maketrans(*PUNCTUATION)) if rules.unify_punctuation else out
    out = out.translate(str.maketrans(*DIGITS)) if rules.map_digits else out
    out = out.translate({ord(z): None for z in ZERO_WIDTH}) if rules.strip_zero_width else out
    out = " ".join(out.split()) if rules.fold_spaces else out
    for old, new in rules.aliases:
        out = out.replace(old.lower(), new.lower())
    if rules.collapse_repeats:
        out = re.sub(rf"(?s)(.)\1{{{max(2, rules.repeat_threshold) - 1},}}", r"\1", out)
    return out


def dense_length(c: Column) -> Column:
    """Characters other than white space."""
    return F.length(F.regexp_replace(or_empty(c), r"(?U)\s+", ""))


# ---------------------------------------------------------------- HTML


def scoring_content(c: Column, closed: bool = False) -> Column:
    """Markup as text for scoring: breaks become lines, other tags and URLs spaces. closed: a
    character reference counts only with its semicolon; else as browsers take it."""
    out = F.regexp_replace(or_empty(c), r"(?i)<\s*(?:br|/p|/div|/li|/tr|/h[1-6]|/blockquote)\b[^>]*>", "\n")
    out = (unescape_closed if closed else unescape)(F.regexp_replace(out, "<[^>]+>", " "))
    return F.regexp_replace(out, r"(?U)(?i)(?:https?://|www\.)\S+", " ")


def archive_content(c: Column) -> Column:
    """Markup as text for the archive: br and ends of p and div become lines, tags go."""
    out = F.regexp_replace(or_empty(c), r"(?i)<br\s*/?>|</p>|</div>", "\n")
    out = strip(F.regexp_replace(out, "<[^>]+>", ""))
    return F.regexp_replace(out, "\n{3,}", "\n\n")


def _lines(c: Column) -> Column:
    return F.split(or_empty(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def _joined(lines: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def markdown_content(c: Column) -> Column:
    """Plain lines for a Markdown report: no heading, quote, bullet or number before them."""
    rows = F.transform(_lines(c), lambda x: F.regexp_replace(F.replace(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit("\t"), F.lit("    ")), r"(?U)^\s{0,3}#{1,6}\s*", ""))
    rows = F.filter(rows, lambda x: ~x.rlike(r"(?U)^\s*[-*_]{3,}\s*$"))
    for mark in (r"(?U)^\s*>\s*", r"(?U)^\s*[-*+]\s+", r"(?U)^\s*\d+\.\s+"):
        rows = _each(rows, mark)
    return _joined(F.transform(rows, lambda x: F.replace(x, F.lit("```"), F.lit("'''"))))


def _each(rows: Column, pattern: str) -> Column:
    return F.transform(rows, lambda x: F.regexp_replace(x, pattern, ""))


def outline_content(c: Column) -> Column:
    """Lines of an outline: headings and fences plain, empty lines gone."""
    rows = F.transform(_lines(c), lambda x: F.regexp_replace(F.replace(F.regexp_replace(x, r"(?U)\s+$", ""), F.lit("\t"), F.lit("    ")), r"(?U)^\s{0,3}#{1,6}\s*", ""))
    rows = F.transform(rows, lambda x: F.replace(x, F.lit("```"), F.lit("'''")))
    return _joined(F.filter(rows, lambda x: F.length(strip(x)) > 0))


def body_with_outline(body: Column, outline: Column) -> Column:
    """The outline, then the body; only the body if it holds the outline's first line."""
    b, o = strip(or_empty(body)), strip(or_empty(outline))
    first = strip(F.split_part(F.regexp_replace(o, "\r\n?", "\n"), F.lit("\n"), F.lit(1)))
    return F.when(F.length(o) == 0, b).when(F.length(b) == 0, o).when(F.contains(b, first), b).otherwise(F.concat_ws("\n\n", o, b))


# ---------------------------------------------------------------- keys, numbers, URLs

#: Difficulty by level and by name.
DIFFICULTY_LEVELS = {"1": "容易", "2": "中等", "3": "困难"}
DIFFICULTY_NAMES = {"简单": "容易", "容易": "容易", "easy": "容易", "中等": "中等", "medium": "中等", "困难": "困难", "hard": "困难"}


def _mapped(key: Column, names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in names.items():
        out = out.when(key == k, v)
    return out.otherwise("")


def difficulty_of_level(c: Column) -> Column:
    return _mapped(c.cast("string"), DIFFICULTY_LEVELS)


def difficulty_of_name(c: Column) -> Column:
    return _mapped(strip(F.lower(or_empty(c))), DIFFICULTY_NAMES)


def title_key(c: Column) -> Column:
    """Key of a title: lower case, no white space at all."""
    return F.regexp_replace(F.lower(or_empty(c)), r"(?U)\s+", "")


def positive(c: Column) -> Column:
    """The integer, null unless it is above zero."""
    n = strip(c.cast("string")).try_cast("int")
    return F.when(n > 0, n)


def non_negative(c: Column, default: int = 0) -> Column:
    n = c.try_cast("int")
    return F.coalesce(F.when(n >= 0, n), F.lit(default))


def search_url(title: Column) -> Column:
    """A search link for a title, percent-encoded with / and ~ left as they are."""
    t = strip(or_empty(title))
    q = F.url_encode(t)
    for old, new in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        q = F.replace(q, F.lit(old), F.lit(new))
    return F.when(F.length(t) == 0, "").otherwise(F.concat(F.lit("https://leetcode.cn/problemset/all/?search="), q))


def day_of(c: Column) -> Column:
    """The leading YYYY-MM-DD, empty if there is none."""
    d = F.substring(or_empty(c), 1, 10)
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), d).otherwise("")


def frequency_score(f: Column, scale: float = 3.6, base: float = 10.0, most: int = 12) -> Column:
    """Score of a frequency: logarithmic, 1 to most, 0 without one."""
    raw = F.bround(F.log(base, f.cast("double") + 1) * scale).cast("int")
    return F.when(f > 0, F.least(F.greatest(raw, F.lit(1)), F.lit(most))).otherwise(0)


def length_ratio(chars: Column, ideal: int = 2200, least: int = 240, short: int = 420) -> Column:
    r = F.least(chars / F.lit(float(ideal)), F.lit(1.0))
    return F.when(chars < least, r * 0.35).when(chars < short, r * 0.75).otherwise(r)


def length_score(chars: Column, weight: int = 70, **limits: int) -> Column:
    return F.bround(length_ratio(chars, **limits) * weight).cast("int")


# ---------------------------------------------------------------- tags, lists


#: Fixed value: signs around a tag that are not part of it.
TAG_EDGES = ".,，。!！?？:：;；|/\\"


def trim_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def tags(c: Column, rules: Normalization = Normalization(nfkc=False)) -> Column:
    """Tags without # and punctuation around them, normalised, each once."""
    made = F.transform(c, lambda x: normalize(trim_chars(F.regexp_replace(strip(x), "^#", ""), TAG_EDGES), rules))
    return F.array_distinct(F.filter(made, lambda x: F.length(x) > 0))


def tail_hashtags(normalized: Column) -> Column:
    """Hashtags of a normalised tail of a text, each once."""
    found = F.regexp_extract_all(normalized, F.lit(r"(?U)(?:^|[\s　])#([^\s#]{1,24})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: trim_chars(x, TAG_EDGES)), lambda x: F.length(x) > 0))


def unique_strings(c: Column, min_len: int = 1) -> Column:
    """Trimmed lower-case strings of at least min_len characters, first of each."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(strip(x))), lambda x: F.length(x) >= min_len))


def page_text(c: Column, mark: str) -> Column:
    """Text of the first element that mark (a pattern up to its tag's end) opens."""
    return F.regexp_extract(or_empty(c), rf"(?is){mark}[^>]*>(.*?)</", 1)

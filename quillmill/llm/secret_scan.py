"""Secret scan with a trigram index, in DataFrame expressions only.

Each rule's regular expression is turned into a Boolean query over the trigrams that every
match must hold. The index keeps, for the trigrams that the rules ask for, which documents
hold them; postings stay in the partition of their documents, one bit a trigram and row, so
intersecting them needs no shuffle. Only candidate rows meet the regular expression itself;
a rule without mandatory trigrams scans every row.

Positions come from the text between matches: `split` gives the gaps and
`regexp_extract_all` the matches, and running sums of their lengths give the spans in code
points. Sums and redacted texts are made in blocks, so many secrets in one long text cost little
more than as many short texts.

Defined cases: a null text is empty and has no span; repeated rows are scanned each; extra
columns are kept by `scan` (it adds `secret_spans`, replacing a column of that name); an
empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, table, unpacked


@dataclass(frozen=True)
class Rule:
    """A kind of secret. measured: the group whose length must reach least; base: in the base set."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1
    base: bool = False


#: Fixed by contract, in the order in which kinds are listed.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A private key through its END line, or without one to the end of its base64 lines: a last
#: short line counts as one if it is padded.
PEM = (
    "-----BEGIN [A-Z ]*PRIVATE KEY-----"
    "(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
    "|(?:(?:[\\x09-\\x0D ]|\\\\[nr])++[A-Za-z0-9+/]{16,}+={0,2})*+(?:(?:[\\x09-\\x0D ]|\\\\[nr])++[A-Za-z0-9+/]++={1,2})?)"
)
RULES = (
    Rule("assign", ASSIGN, 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", "[0-9a-f]+", 0, 24, True),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", "AIza[A-Za-z0-9_-]{35}"),
    Rule("pem", PEM),
    Rule("signed", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)

# ---------------------------------------------------------------- trigram queries

#: A query is True (any text), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def both(kind: str, parts: list[Query]) -> Query:
    """Join queries, with True as the neutral element of "and" and the absorbing one of "or"."""
    if kind == "or" and any(p is True for p in parts):
        return True
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else (kind, tuple(kept))


def trigrams(words: set[str]) -> Query:
    """What every text that holds one of the words must hold."""
    return both("or", [both("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


#: Limits of the exact strings followed through a pattern.
MOST_STRINGS, MOST_CLASS = 64, 8


def derive(pattern: str) -> Query:
    """Boolean trigram query (lower case) that holds for every text with a match of pattern."""
    import re._parser as parser

    found: list[Query] = []

    def exact(items: list) -> set[str] | None:
        """The strings that a piece matches, if they are few."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                nxt = {chr(arg).lower()}
            elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
                nxt = {chr(c).lower() for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
                if len(nxt) > MOST_CLASS:
                    return None
            elif name == "SUBPATTERN":
                nxt = exact(list(arg[3]))
            elif name == "BRANCH":
                each = [exact(list(b)) for b in arg[1]]
                nxt = None if None in each else set().union(*each)
            elif name == "MAX_REPEAT" and arg[1] <= 2:
                one = exact(list(arg[2]))
                nxt = None if one is None else set().union(*(reduce(lambda s, _: {a + b for a in s for b in one}, range(k), {""}) for k in range(arg[0], int(arg[1]) + 1)))
            else:
                return None
            if nxt is None or len(out) * len(nxt) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in nxt}
        return out

    def walk(items: list) -> None:
        run: list = []

        def close() -> None:
            words = exact(run) if run else None
            if words and all(len(w) >= 3 for w in words):
                found.append(trigrams(words))
            run.clear()

        for item in items:
            if exact([*run, item]) is not None:
                run.append(item)
                continue
            close()
            op, arg = str(item[0]), item[1]
            if exact([item]) is not None:
                run.append(item)
            elif op == "SUBPATTERN":
                walk(list(arg[3]))
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                walk(list(arg[2]))
        close()

    walk(list(parser.parse(pattern)))
    return both("and", found)


def asked(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*(asked(q) for q in query[1]))


def holds(query: Query, bit: dict[str, int], bits: Column) -> Column | None:
    """The query over a row's posting bits; None if every row is a candidate."""
    if query is True:
        return None
    if isinstance(query, str):
        return bits.bitwiseAND(F.lit(1 << bit[query])) != 0
    parts = [holds(q, bit, bits) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, int]]:
    """docs with `_low` (lower-case text) replaced by postings `_bits0`, ... of 62 trigrams each."""
    wanted = sorted(set().union(*(asked(derive(r.pattern)) for r in rules)))
    low = docs.withColumn("_low", F.lower(F.coalesce(F.col("text"), F.lit(""))))
    columns = {}
    for k in range(0, max(1, len(wanted)), 62):
        bits = F.lit(0).cast("long")
        for i, t in enumerate(wanted[k : k + 62]):
            bits = bits.bitwiseOR(F.when(F.contains("_low", F.lit(t)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        columns[f"_bits{k // 62}"] = bits
    return low.withColumns(columns).drop("_low"), {t: i for i, t in enumerate(wanted)}


def candidate(rule: Rule, bit: dict[str, int]) -> Column:
    def over(query: Query) -> Column | None:
        if query is True:
            return None
        if isinstance(query, str):
            return F.col(f"_bits{bit[query] // 62}").bitwiseAND(F.lit(1 << bit[query] % 62)) != 0
        return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), [over(q) for q in query[1]])

    text = F.coalesce(F.col("text"), F.lit(""))
    sure = rule.pattern
    if rule.measured == 0 and sure.endswith("]+") and rule.least > 1:  # a run of the class, long enough
        head = sure[: sure.rindex("[")]
        sure = f"{sure[:-1]}{{{rule.least - len(head)},}}"
    found = over(derive(rule.pattern))
    return text.rlike(sure) if found is None else found & text.rlike(sure)


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: an expression that a lambda's body names is
    computed for each element, an argument is not."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value, op over zero and the values before it. A fold that grows a list copies it
    with every element, so folds run over blocks of about the square root of their number."""

    def folded(xs: Column, first: Column) -> Column:
        none = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, none, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def over(xs: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(xs) / block).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(xs, k * block + 1, block))
        totals = lambda bs: folded(F.transform(bs, lambda b: F.aggregate(b, zero, op)), zero)
        return bound(blocks, lambda bs: F.flatten(F.zip_with(bs, totals(bs), folded)))

    return bound(values, over)


def spans(rule: Rule, rank: int) -> Column:
    """Leftmost non-overlapping matches of a rule that are long enough."""
    text, pattern = F.coalesce(F.col("text"), F.lit("")), F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.measured)), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("measure"))  # the last gap has no match

    def placed(xs: Column) -> Column:
        ends = before(F.transform(xs, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))), F.lit(0), lambda a, x: a + x)
        every = F.zip_with(xs, ends, lambda x, at: F.struct(x["measure"].alias("measure"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end")))
        long = F.filter(every, lambda x: F.coalesce(x["measure"] >= rule.least, F.lit(False)))
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

    return bound(rows, placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs(text, ...) with `secret_spans`: (start, rank, end, kind) by start, then rank."""
    with_index, bit = index(docs, rules)
    none = F.expr(f"cast(array() as {SPAN})")
    marks = [F.when(candidate(r, bit), spans(r, k)).otherwise(none) for k, r in enumerate(rules)]
    made = with_index.withColumn("secret_spans", F.array_sort(F.concat(*marks)))
    return made.drop(*[c for c in made.columns if c.startswith("_bits") and c not in docs.columns])


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of the chunks from which redacted texts are put together.
CHUNK = 512


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret replaced by <kind>; overlapping spans are replaced as one, under
    the kind that starts first. Other columns stay; n_chars, where present, follows the text."""
    found = scan(packed(docs, F.col("text")), rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def replaced(x: Column) -> Column:
        def part(a: Column, b: Column) -> Column:  # characters a to b, from the chunks that hold them
            first = F.floor(a / CHUNK).cast("int")
            held = F.array_join(F.slice(x["chunks"], first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "")
            return F.substring(held, a - first * CHUNK + 1, b - a)

        ends = before(F.transform(x["spans"], lambda s: s["end"]), F.lit(0), lambda a, e: F.greatest(a, e))
        parts = F.zip_with(x["spans"], ends, lambda s, at: F.when(s["start"] >= at, F.concat(part(at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        return F.concat(F.array_join(parts, ""), part(last, x["n"]))

    new = bound(F.struct(F.col("secret_spans").alias("spans"), chunks.alias("chunks"), F.length(text).alias("n")), replaced)
    any_ = F.size("secret_spans") > 0
    out = found.withColumn("text", F.when(any_, new).otherwise(F.col("text")))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(any_, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(out, docs, **changed)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = {r.kind: F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{r.kind}')) as long)").alias(f"n_{r.kind}") for r in RULES}
    base = [r.kind for r in RULES if r.base]
    return found.select(
        "doc_id",
        *[count[k] for k in base],
        F.sha2(joined(F.filter("secret_spans", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
        *[count[r.kind] for r in RULES if not r.base],
    )

"""Similarity join of texts on word shingles (Jaccard), size-aware.

Words are hashed, five in a row make a shingle, and a document is its set of shingles.
The join runs in four steps.

1. Counting. Each task sorts the shingle hashes of a block of documents into ranges of the
   hash space and ships each range as one compact row; a range's task finds the hashes that
   more than one document has and returns, per document, how many of its shingles they are.
   A document with fewer than the needed overlap of such shingles has no partner.
2. Classes. Among the rest, documents with equal sets are one class with one representative.
3. Candidates, heavy and light. A pair that links shares at least l of the first
   n - ceil(t n) + l shingles of both in one order, here from rare to frequent as counted among
   the representatives; places in it bound a pair's overlap. Small sets (light) enumerate the
   subsets of l = 2 of these and meet by equal subset; large sets (heavy) are scanned through
   the inverted lists of l = 1. The boundary is the size at which a set has more subsets than
   list entries to read, with the mean list length as measured. Sets up to boundary / t also
   enumerate, so a pair across the boundary is met.
4. Verification. The representatives' sets meet and the overlap is counted in full. This
   goes in rounds: at first a list offers each member only its leader, and a representative is
   held against the leader that it shares most lists with; the last round takes every pair of
   the lists that is not yet connected and whose bitmaps allow the overlap. A group of near copies so costs a few pairs a member,
   and no link is lost: pairs left out are in one component already, or too far apart.

Defined cases: a null text, or one without words, has no shingles, links with nothing and is
its own component; a text of fewer than five words is one shingle; rows with equal sets are
linked; doc_id is taken as a key, and of repeated rows each gets the same result; extra
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, blocks, bloom_joins, bucket_of, components, cut, expand, expand_sorted, known_id, mix, null_id, packed, partitions, squeeze, squeeze_sorted, table, trimmed, trimmed_group, unpacked, utf8, word_hashes

WORDS = 5
#: The threshold as a fraction, so that comparisons stay in integers.
ABOVE, OF = 75, 100
#: Shingles of the documents that one task ships together.
BLOCK_SHINGLES = 800_000
#: Columns of a set's bitmap, 64 bits each: the parity of the number of shingles by hash.
BITMAP = [f"s{k}" for k in range(8)]
#: Bits of a hash that counting leaves out: a chance match only spares a document the filter.
SPARED = np.uint64(16)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(size, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + words[i : n - k + 1 + i]
    return np.unique(mix(out))


def sets(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    for i, j in blocks(texts):
        hashes, counts = word_hashes(texts[i:j])
        for words in np.split(hashes, np.cumsum(counts)[:-1]):
            yield shingles(words, size)


def needed(n: int, above: int = ABOVE, of: int = OF) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-n * above // of)


def fingerprint(a: np.ndarray) -> int:
    """One 64-bit hash of a sorted set."""
    if not len(a):
        return 0
    both = np.array([np.bitwise_xor.reduce(mix(a + np.uint64(1)))]) + np.array([mix(a).sum(dtype=np.uint64)]) * np.uint64(3)
    return int(mix(both).view(np.int64)[0])


def bitmap(a: np.ndarray) -> np.ndarray:
    """Parity of the number of hashes by their low bits. Two bitmaps differ in at most as many
    bits as the sets have elements apart."""
    size = 64 * len(BITMAP)
    odd = np.bincount((a & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def counted(docs: DataFrame, size: int, parts: int) -> DataFrame:
    """(kind, ...) rows: per document n, its set's fingerprint and the number of its shingles
    that other documents have."""
    ranges = 4 * parts

    def ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        ids: list[list[int]] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pd.DataFrame:
            block = uuid4().hex
            which = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            every = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            order = np.argsort(every, kind="stable")
            every, which = every[order], which[order]
            bounds = np.searchsorted(bucket_of(every, ranges), np.arange(ranges + 1))
            rows = [(r, block, squeeze_sorted(every[a:b] >> SPARED), squeeze(which[a:b]), None) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            marks = np.array([fingerprint(x) for x in held], dtype=np.int64)
            sizes = np.array([len(x) for x in held], dtype=np.uint32)
            rows.append((-1, block, np.array(ids, dtype=np.int64).tobytes(), sizes.tobytes(), marks.tobytes()))
            return pd.DataFrame(rows, columns=["range", "block", "a", "b", "c"])

        for pdf in batches:
            for *own, s in zip(pdf["doc_id"].tolist(), pdf["row_key"].tolist(), sets(utf8(pdf["text"]), size), strict=True):
                ids.append(own)
                held.append(s)
                total += len(s)
                if total >= BLOCK_SHINGLES:
                    yield flush()
                    ids, held, total = [], [], 0
        if ids:
            yield flush()

    def shared(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pdf[["block", "a", "b", "c"]]
        hashes = [expand_sorted(x) for x in pdf["a"]]
        every = np.concatenate(hashes)
        ordered = np.sort(every)
        many = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        del every, ordered
        out = []
        for block, own, which in zip(pdf["block"], hashes, pdf["b"], strict=True):
            if len(many):
                at = np.minimum(np.searchsorted(many, own), len(many) - 1)
                docs_of = expand(which, np.uint32)[many[at] == own]
                number, count = np.unique(docs_of, return_counts=True)
                if len(number):
                    out.append((block, squeeze(number.astype(np.uint32)), squeeze(count.astype(np.uint32)), None))
        return pd.DataFrame(out, columns=["block", "a", "b", "c"])

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf[pdf["c"].notna()].iloc[0]
        ids, n, mark = np.frombuffer(whole["a"], dtype=np.int64).reshape(-1, 2), np.frombuffer(whole["b"], dtype=np.uint32), np.frombuffer(whole["c"], dtype=np.int64)
        common = np.zeros(len(ids), dtype=np.int64)
        for number, count in pdf.loc[pdf["c"].isna(), ["a", "b"]].itertuples(index=False):
            common[expand(number, np.uint32)] += expand(count, np.uint32)
        return pd.DataFrame({"doc_id": ids[:, 0], "row_key": ids[:, 1], "n": n.astype(np.int64), "mark": mark, "common": common})

    shipped = docs.select("doc_id", "row_key", "text").mapInPandas(trimmed(ship), "range int, block string, a binary, b binary, c binary")
    # The documents' own rows are spread by block; a range's rows meet by range.
    replies = shipped.groupBy("range", F.when(F.col("range") < 0, F.col("block")).alias("own")).applyInPandas(trimmed_group(shared), "block string, a binary, b binary, c binary")
    return replies.groupBy("block").applyInPandas(trimmed_group(summed), "doc_id long, row_key long, n long, mark long, common long")




def pairs_of(p: np.ndarray) -> np.ndarray:
    x, y = np.triu_indices(len(p), 1)
    return mix(p[x] * np.uint64(BASE) + mix(p[y]))


def boundary(mean_list: float, above: int, of: int, most: int = 1000) -> int:
    """Largest size whose pairs of shingles are no more than the list entries it would read."""
    best = 1
    for n in range(2, most):
        k = n - needed(n, above, of) + 1
        if (k + 1) * k / 2 > k * mean_list:
            return best
        best = n
    return best


def lists(reps: DataFrame, above: int, of: int, parts: int) -> DataFrame:
    """(key, id, n, pos): whom reps(id, n, items) may link with, by equal key; pos is the place
    of the key, or of the later shingle of a pair, in the order from rare to frequent."""
    ranges = 4 * parts

    def ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from uuid import uuid4

        ids: list[tuple[int, int]] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pd.DataFrame:
            block = uuid4().hex
            which = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            every = np.concatenate(held)
            order = np.argsort(every, kind="stable")
            every, which = every[order], which[order]
            bounds = np.searchsorted(bucket_of(every, ranges), np.arange(ranges + 1))
            rows = [(r, block, squeeze_sorted(every[a:b]), squeeze(which[a:b])) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            rows.append((-1, block, np.array(ids, dtype="<i8").tobytes(), None))
            return pd.DataFrame(rows, columns=["range", "block", "a", "b"])

        for pdf in batches:
            for i, items in zip(pdf["id"].tolist(), pdf["items"], strict=True):
                held.append(expand_sorted(items))
                ids.append((i, len(held[-1])))
                total += len(held[-1])
                if total >= BLOCK_SHINGLES:
                    yield flush()
                    ids, held, total = [], [], 0
        if ids:
            yield flush()

    def frequent(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Entries whose shingle more than one set has, with the number of sets that have it."""
        if key[0] < 0:
            return pdf.assign(c=None, entries=0, keys=0)[["block", "a", "b", "c", "entries", "keys"]]
        own = [expand_sorted(x) for x in pdf["a"]]
        names, count = np.unique(np.concatenate(own), return_counts=True)
        names, count = names[count > 1], count[count > 1]
        rows = []
        for block, entry, which in zip(pdf["block"], own, pdf["b"], strict=True):
            if len(names):
                at = np.minimum(np.searchsorted(names, entry), len(names) - 1)
                hit = names[at] == entry
                if hit.any():
                    rows.append((block, squeeze_sorted(entry[hit]), squeeze(expand(which, np.uint32)[hit]), squeeze(count[at[hit]].astype(np.uint32)), int(hit.sum()), 0))
        if rows:
            rows[0] = (*rows[0][:5], len(names))
        return pd.DataFrame(rows, columns=["block", "a", "b", "c", "entries", "keys"])

    shipped = reps.mapInPandas(trimmed(ship), "range int, block string, a binary, b binary")
    replies = cut(shipped.groupBy("range", F.when(F.col("range") < 0, F.col("block")).alias("own")).applyInPandas(trimmed_group(frequent), "block string, a binary, b binary, c binary, entries long, keys long"))
    read = replies.agg(F.sum("entries").alias("k"), F.sum("keys").alias("d")).first()
    light = boundary(max(2.0, (read["k"] or 0) / max(1, read["d"] or 0)), above, of)
    reach = light * of // above

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, n = np.frombuffer(pdf.loc[pdf["c"].isna(), "a"].iloc[0], dtype="<i8").reshape(-1, 2).T
        met = pdf[pdf["c"].notna()]
        columns = {"key": np.zeros(0, dtype=np.int64), "id": np.zeros(0, dtype=np.int64), "n": np.zeros(0, dtype=np.int64), "pos": np.zeros(0, dtype=np.int64)}
        if not len(met):
            return pd.DataFrame(columns)
        key = np.concatenate([expand_sorted(x) for x in met["a"]])
        doc = np.concatenate([expand(x, np.uint32) for x in met["b"]]).astype(np.int64)
        count = np.concatenate([expand(x, np.uint32) for x in met["c"]])
        order = np.lexsort((key, count, doc))
        key, doc = key[order], doc[order]
        shared = np.bincount(doc, minlength=len(n))
        first = np.cumsum(shared) - shared
        pos = n[doc] - shared[doc] + np.arange(len(doc)) - first[doc]  # shingles of one set alone come first
        last = n - (n * above + of - 1) // of  # the first n - ceil(t n) + 1 shingles
        keep = (pos <= last[doc]) & ((n[doc] > light) | (n[doc] == 1))
        made = [(key[keep], ids[doc[keep]], n[doc[keep]], pos[keep])]
        small = (n > 1) & (n <= reach)
        take = small[doc] & (pos <= last[doc] + 1)
        bounds = np.searchsorted(doc[take], np.arange(len(n) + 1))
        few, where = key[take], pos[take]
        for d in np.flatnonzero(np.diff(bounds) > 1).tolist():
            a, b = bounds[d], bounds[d + 1]
            own = pairs_of(few[a:b])
            made.append((own, np.full(len(own), ids[d]), np.full(len(own), n[d]), where[a:b][np.triu_indices(b - a, 1)[1]]))
        key, i, size, pos = (np.concatenate(x) for x in zip(*made, strict=True))
        return pd.DataFrame({"key": key.view(np.int64), "id": i, "n": size, "pos": pos})

    found = replies.select("block", "a", "b", "c").groupBy("block").applyInPandas(trimmed_group(lambda key, pdf: chosen(pdf)), "key long, id long, n long, pos long")
    return found


def verified(pairs: DataFrame, reps: DataFrame, above: int, of: int) -> DataFrame:
    """Links (u, v) among pairs(a, b)."""
    left = pairs.join(reps.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    whole = left.join(reps.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")

    def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                a, b = expand_sorted(x), expand_sorted(y)
                both = np.concatenate([a, b])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(of * same >= above * (len(a) + len(b) - same))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]].rename(columns={"a": "u", "b": "v"})

    return whole.select("a", "b", "x", "y").mapInPandas(trimmed(enough), "u long, v long")


def may_fit(above: int, of: int) -> str:
    """Whether sizes allow a link, and the shingles from the shared one on: a linked pair meets
    this at the first key that both sets have. A pair key's earlier shingle adds one."""
    most = "2 + least(na - pa - 1, nb - pb - 1)"
    return f"{of} * least(na, nb) >= {above} * greatest(na, nb) and {of} * ({most}) >= {above} * (na + nb - ({most}))"


def with_component(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return rows.withColumn("c", F.col("id"))
    return rows.join(found, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")


def open_lists(rows: DataFrame) -> DataFrame:
    """Lists with members of more than one component."""
    mixed = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return rows.join(mixed, "key")


def links(reps: DataFrame, above: int, of: int, parts: int, rounds: int = 2) -> DataFrame:
    """Components (id, component_id) of the linked ones among reps(id, n, items)."""
    rows = cut(lists(reps, above, of, parts))
    edges, found = None, None
    for k in range(rounds + 1):
        now = open_lists(with_component(rows, found))
        if k:  # closed lists stay closed
            rows = cut(now.select("key", "id", "n", "pos"))
            now = with_component(rows, found)
        if k < rounds:  # each member against one leader of its list, another in each round
            # The member in the most long lists is nearest to the others; later rounds try any.
            central = -F.col("w") if k % 2 == 0 else F.lit(0.0)
            order = F.struct(central.alias("w"), F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "c", "pos")
            if k % 2 == 0:
                now = now.join(now.groupBy("key").agg(F.count("*").alias("m")), "key").withColumn("w", F.sum(F.log("m") / F.col("n")).over(Window.partitionBy("id")))
            lead = now.groupBy("key").agg(F.min(order).alias("l")).select("key", F.col("l.id").alias("a"), F.col("l.n").alias("na"), F.col("l.c").alias("ca"), F.col("l.pos").alias("pa"))
            met = now.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("pos").alias("pb")).join(lead, "key").where(f"ca <> cb and {may_fit(above, of)}")
            votes = met.groupBy("a", "b").count()
            pairs = votes.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        else:  # every pair left, with the members of a list's largest component met as a whole
            by = now.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
            # Parity bitmaps bound the difference of two sets from below: pairs beyond it never
            # leave the join, however many meet in a list.
            signed = now.join(reps.select("id", *BITMAP), "id").join(by, "key")
            rest = signed.where("c <> main").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("pos").alias("pa"), *[F.col(x).alias(f"{x}a") for x in BITMAP])
            other = signed.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("pos").alias("pb"), "main", *[F.col(x).alias(f"{x}b") for x in BITMAP])
            apart = " + ".join(f"bit_count({x}a ^ {x}b)" for x in BITMAP)
            met = rest.join(other, "key").where(f"ca <> cb and (cb = main or a < b) and {may_fit(above, of)} and {above + of} * (na + nb - ({apart})) >= {2 * above} * (na + nb)")
            pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = cut(verified(pairs, reps, above, of))
        edges = new if edges is None else edges.union(new)
        found = components(edges)
    return found


def row_key() -> Column:
    """Names a row by its id and its text: rows without an id, or of one id, may differ."""
    return F.xxhash64(known_id("doc_id"), F.col("text"))


def components_of(docs: DataFrame, above: int = ABOVE, of: int = OF, size: int = WORDS) -> DataFrame:
    """doc_id, row_key, n and component (doc_id, row_key: its least) of every row of
    docs(doc_id, text); NO_ID stands for null."""
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = docs.select(known_id("doc_id").alias("doc_id"), row_key().alias("row_key"), "text")
    rows = cut(counted(docs, size, parts))
    own = F.struct("doc_id", "row_key")
    equal = rows.where("n > 0").groupBy("mark", "n").agg(F.min(own).alias("least"), F.max("common").alias("common"))
    equal = cut(equal.withColumn("id", F.col("least.row_key")))
    alive = equal.where(f"{of} * common >= {above} * n").select("id", "mark")

    def own_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = list(sets(utf8(pdf["text"]), size))
            keep = [fingerprint(s) == m for s, m in zip(made, pdf["mark"].tolist(), strict=True)]
            short = [squeeze_sorted(s) for s, k in zip(made, keep, strict=True) if k]
            kept = [s for s, k in zip(made, keep, strict=True) if k]
            bits = np.array([bitmap(s) for s in kept], dtype=np.int64).reshape(-1, len(BITMAP))
            yield pd.DataFrame({"id": pdf["id"][keep], "n": [len(s) for s in kept], "items": short, **{x: bits[:, i] for i, x in enumerate(BITMAP)}})

    with bloom_joins(spark):
        texts = docs.select(F.col("row_key").alias("id"), "text").join(alive, "id")
        reps = cut(texts.mapInPandas(trimmed(own_sets), "id long, n long, items binary, " + ", ".join(f"{x} long" for x in BITMAP)).dropDuplicates(["id"]))
    found = links(reps, above, of, parts)
    together = equal.join(found, "id", "left").select("mark", "n", "least", F.coalesce("component_id", "id").alias("c"))
    together = cut(together)
    first = together.groupBy("c").agg(F.min("least").alias("component"))
    named = rows.join(together.join(first, "c").select("mark", "n", "component"), ["mark", "n"], "left")
    return named.select("doc_id", "row_key", "n", F.coalesce("component", own).alias("component"))


def classes(docs: DataFrame, above: int = ABOVE, of: int = OF, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    named = components_of(docs, above, of, size)
    return named.select(null_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), null_id(F.col("component.doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of each component, its columns unchanged. Rows are
    told apart by id and text; those without words all stay."""
    kept = components_of(docs.select("doc_id", "text")).where("row_key = component.row_key").select(F.col("row_key").alias("i"), (F.col("n") > 0).alias("worded")).distinct()
    found = packed(docs, row_key().alias("i")).withColumn("at", F.monotonically_increasing_id()).join(kept, "i")
    return unpacked(found.withColumn("at", F.when(~F.col("worded"), F.col("at"))).dropDuplicates(["i", "at"]), docs)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))

"""Exact removal of byte strings that repeat, by a distributed sparse suffix array.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Sorting
every suffix of a corpus is not needed for that: of each LENGTH-byte string, the least hash
among its GRAM-byte strings marks an anchor, and equal strings mark equal anchors.

1. Strings that start again within four bytes (a run of one byte, say) are found on the spot,
   and only the first ones of a run need anchors, so a long run costs as much as a short one.
   Each task finds the anchors of its documents (about one in 50 bytes) and ships hash,
   context hash and place, compactly, by hash range. A range's task drops anchors that occur
   once. An anchor whose whole context (all LENGTH-byte strings around it) occurs again needs
   no more; the others are edges.
2. Documents with repeated anchors are read again. Fully repeated contexts are marked there;
   for edges, and one example of each repeated context beside them, the bytes on either side
   of the anchor go to the range's task.
3. There the suffixes to the right of an anchor, and the reversed prefixes to its left, are
   sorted by merge sort. Two are compared through prefix polynomial hashes: binary search
   finds the length of their common extension, so a comparison takes logarithmic time. The
   extension of neighbours in the order is verified on the bytes; after a collision the order
   is made on bytes instead. Neighbours' extensions give, for each length, classes of equal
   strings, and a LENGTH-byte string repeats if a second one shares both of its classes.

Defined cases: a null or empty text has no bytes and nothing is removed; a repeated row is a
second occurrence of all its strings; rows with one doc_id and different texts are told apart
by their text; extra columns are ignored by `spans` and kept by `strip`; an empty table gives
no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BYTE_VALUE, PrefixHash, bloom_joins, blocks, bucket_of, cut, expand, expand_sorted, known_id, mix, packed, partitions, powers, squeeze, squeeze_sorted, table, trimmed, trimmed_group, unpacked, utf8

LENGTH = 200
GRAM = 100
#: Bytes on each side of an anchor that a LENGTH-byte string around it can reach.
SIDE = LENGTH - GRAM
#: Strings that start again up to PERIOD bytes on are found where they are.
PERIOD = 4
#: Anchors that a task ships together; text hashed at once; edge rows sorted at once.
SHIP, HASHED, SORTED = 200_000, 1 << 18, 15_000


def sliding(a: np.ndarray, w: int, ufunc: np.ufunc, fill: np.uint64) -> np.ndarray:
    """ufunc over a[i : i + w] for each i <= len(a) - w."""
    n = len(a)
    size = -(-n // w) * w
    grid = np.full(size, fill, dtype=a.dtype)
    grid[:n] = a
    grid = grid.reshape(-1, w)
    ahead = ufunc.accumulate(grid, axis=1).reshape(-1)
    back = np.ascontiguousarray(ufunc.accumulate(grid[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    return ufunc(back[: n - w + 1], ahead[w - 1 : n])


def nearby(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(p, starts) of the strings that start again p <= PERIOD bytes on, as in a run of one byte,
    by comparing the bytes."""
    n = len(data)
    for p in range(1, min(PERIOD, n - LENGTH) + 1):
        few = np.append(0, np.cumsum(data[: n - p : 25] == data[p:n:25]))
        if (few[7:] - few[:-7] < 7).all():  # no LENGTH bytes in a row can be the same
            continue
        same = np.append(0, np.cumsum(data[:-p] == data[p:]))
        yield p, np.flatnonzero(same[LENGTH:] - same[:-LENGTH] == LENGTH)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, anchor hash, context hash) of all anchors of some texts."""
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(data) < LENGTH:
        return none
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    end = np.cumsum(size)
    hashes = PrefixHash(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes.span(at, at + GRAM)
    least = sliding(gram, SIDE + 1, np.minimum, np.uint64(2**64 - 1))  # of each LENGTH-byte string
    valid = np.zeros(len(least) + 1, dtype=np.int32)  # strings within one document
    fits = size >= LENGTH
    np.add.at(valid, (end - size)[fits], 1)
    np.add.at(valid, np.minimum(end - LENGTH + 1, len(least))[fits], -1)
    valid = np.cumsum(valid)[:-1] > 0
    least[~valid] = 0
    for p, start in nearby(data):  # strings that recur at once need no anchor but for the first ones of a run
        start = start[valid[start] & valid[start + p]]
        run = start - np.arange(len(start))
        least[start[np.arange(len(start)) - np.searchsorted(run, run) > PERIOD]] = 0
    wide = np.concatenate([np.zeros(SIDE, dtype=np.uint64), least, np.zeros(SIDE, dtype=np.uint64)])
    place = np.flatnonzero(sliding(wide, SIDE + 1, np.maximum, np.uint64(0)) == gram)
    doc = np.searchsorted(end, place, side="right")
    low = np.maximum(end[doc] - size[doc], place - SIDE)
    high = np.minimum(end[doc], place + LENGTH)
    context = mix(hashes.span(low, high) + (place - low).astype(np.uint64) * np.uint64(BASE))
    return doc, place - (end - size)[doc], gram[place], context


def repeated(docs: DataFrame, parts: int) -> DataFrame:
    """Anchors that occur again: (doc_id, pos, anchor, context, kind), kind 1 where the whole
    context occurs again, 0 at an edge, 2 for a repeated context kept as an edge's example."""
    ranges = 4 * parts

    def ship(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        total = 0

        def flush() -> pd.DataFrame:
            doc, pos, anchor, context = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(anchor, kind="stable")
            doc, pos, anchor, context = doc[order], pos[order], anchor[order], context[order]
            bounds = np.searchsorted(bucket_of(anchor, ranges), np.arange(ranges + 1))
            rows = [(r, squeeze_sorted(anchor[a:b]), squeeze(context[a:b]), squeeze(doc[a:b]), squeeze(pos[a:b])) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
            return pd.DataFrame(rows, columns=["range", "anchor", "context", "doc_id", "pos"])

        for pdf in batches:
            texts, ids = utf8(pdf["text"]), pdf["id"].to_numpy()
            for i, j in blocks(texts, HASHED):
                doc, pos, anchor, context = anchors(texts[i:j])
                held.append((ids[i:j][doc], pos.astype(np.uint32), anchor, context))
                total += len(doc)
                if total >= SHIP:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        anchor = np.concatenate([expand_sorted(x) for x in pdf["anchor"]])
        order = np.argsort(anchor, kind="stable")
        anchor = anchor[order]
        same = anchor[1:] == anchor[:-1]
        many = np.zeros(len(anchor), dtype=bool)
        many[1:] |= same
        many[:-1] |= same
        order, anchor = order[many], anchor[many]
        pick = lambda name, kind: np.concatenate([expand(x, kind) for x in pdf[name]])[order]
        context, doc, pos = pick("context", np.uint64), pick("doc_id", np.int64), pick("pos", np.uint32)
        by = np.lexsort((pos, doc, context, anchor))
        anchor, context, doc, pos = anchor[by], context[by], doc[by], pos[by]
        n = len(anchor)
        if not n:
            return pd.DataFrame({"doc_id": doc, "pos": pos.astype(np.int32), "anchor": anchor.view(np.int64), "context": context.view(np.int64), "kind": np.zeros(0, dtype=np.int32)})
        first = np.ones(n, dtype=bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        alone = first & np.append(first[1:], True)
        group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
        has_edge = np.zeros(group[-1] + 1, dtype=bool)
        has_edge[group[alone]] = True
        kind = np.where(alone, 0, np.where(first & has_edge[group], 2, 1))
        return pd.DataFrame({"doc_id": doc, "pos": pos.astype(np.int32), "anchor": anchor.view(np.int64), "context": context.view(np.int64), "kind": kind.astype(np.int32)})

    shipped = docs.select(known_id("doc_id").alias("id"), "text").mapInPandas(trimmed(ship), "range int, anchor binary, context binary, doc_id binary, pos binary")
    return shipped.groupBy("range").applyInPandas(trimmed_group(again), "doc_id long, pos int, anchor long, context long, kind int")


# ---------------------------------------------------------------- sorting by hashes


class HashedRows:
    """Rows of SIDE bytes (zero-padded) with their prefix hashes."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), dtype=np.uint64)
        weight = powers(BASE, rows.shape[1])
        for a in range(0, len(rows), 4096):  # a group of any size, with little beside its hashes
            np.cumsum(BYTE_VALUE[rows[a : a + 4096]] * weight, axis=1, out=self.prefix[a : a + 4096, 1:])

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by binary search on the hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.rows.shape[1])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a comes before row b; equal rows keep their order."""
        k = self.extension(a, b)
        end = k == self.rows.shape[1]
        k = np.minimum(k, self.rows.shape[1] - 1)
        return np.where(end, a < b, self.rows[a, k] < self.rows[b, k])


def merge_sort(rows: HashedRows, group: np.ndarray) -> np.ndarray:
    """Order of the rows within each run of equal group (group is sorted).

    Bottom-up: at each level an element's new place is its place in its own run plus its rank
    in the sibling run, found by binary search; all elements search at once."""
    n = len(group)
    order = np.arange(n)
    start = np.searchsorted(group, group, side="left")
    length = np.searchsorted(group, group, side="right") - start
    width = 1
    while width < length.max(initial=0):
        at = np.arange(n) - start
        run = at // width
        left = start + np.minimum((run ^ 1) * width, length)
        right = start + np.minimum(((run ^ 1) + 1) * width, length)
        low, high = left.copy(), right.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            before = rows.less(order[mid], order[open_])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = start + (run // 2) * 2 * width + at % width + (low - left)
        new = np.empty_like(order)
        new[place] = order
        order = new
        width *= 2
    return order


def sorted_extensions(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows in their groups, and each one's common prefix with the one before
    it (-1 at the start of a group), verified on the bytes."""
    order = merge_sort(HashedRows(rows), group)
    a, b = rows[order[:-1]], rows[order[1:]]
    differ = a != b
    k = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    c = np.minimum(k, rows.shape[1] - 1)
    i = np.arange(len(k))
    together = group[1:] == group[:-1]
    if (together & (k < rows.shape[1]) & (a[i, c] > b[i, c])).any():  # a collision misled the sort
        order = np.lexsort((*rows.T[::-1], group))
        return sorted_by_bytes(rows, group, order)
    return order, np.append(-1, np.where(together, k, -1))


def sorted_by_bytes(rows: np.ndarray, group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    differ = rows[order[:-1]] != rows[order[1:]]
    k = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.append(-1, np.where(group[1:] == group[:-1], k, -1))


def strings_again(group: np.ndarray, left: np.ndarray, right: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows around equal anchors (left bytes nearest first), the least and the greatest
    number of left bytes of a LENGTH-byte string that another row has too; -1 if there is none."""
    n = len(group)
    lorder, lext = sorted_extensions(left, group)
    rorder, rext = sorted_extensions(right, group)
    most, least = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    lclass, rclass = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for j in range(SIDE + 1):
        lclass[lorder] = np.cumsum(lext < j)
        rclass[rorder] = np.cumsum(rext < SIDE - j)
        own = np.flatnonzero((l >= j) & (r >= SIDE - j))
        key = lclass[own] * (n + 1) + rclass[own]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        hit = np.zeros(len(own), dtype=bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        hit = own[hit]
        most[hit] = j
        least[hit] = np.where(least[hit] < 0, j, least[hit])
    return least, most


def resolve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated strings at the edges of one hash range: (doc_id, mark, start, end)."""
    pdf = pdf.sort_values(["anchor", "doc_id", "mark", "pos"], kind="stable")
    anchor = pdf["anchor"].to_numpy()
    out = []
    bounds = [0]
    while bounds[-1] < len(pdf):  # whole groups, about SORTED rows at once
        at = min(bounds[-1] + SORTED, len(pdf))
        end = int(np.searchsorted(anchor, anchor[at - 1], side="right"))
        begin = int(np.searchsorted(anchor, anchor[at - 1], side="left"))
        bounds.append(begin if begin > bounds[-1] and end > bounds[-1] + SORTED else end)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = pdf.iloc[a:b]
        l, r = part["left"].map(len).to_numpy(), part["right"].map(len).to_numpy()
        pad = lambda col: np.frombuffer(b"".join(x.ljust(SIDE, b"\0") for x in part[col]), dtype=np.uint8).reshape(-1, SIDE)
        least, most = strings_again(anchor[a:b], pad("left"), pad("right"), l, r)
        own = (part["kind"].to_numpy() == 0) & (most >= 0)
        pos = part["pos"].to_numpy(dtype=np.int64)[own]
        out.append(pd.DataFrame({"doc_id": part["doc_id"][own], "mark": part["mark"][own], "start": pos - most[own], "end": pos - least[own] + LENGTH}))
    return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "mark": [], "start": [], "end": []}, dtype="int64")


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [start, end)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(new[1:], True)]


def pack(start: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([start, end]).astype("<i8").tobytes()


def unpack(b: bytes | None) -> np.ndarray:
    return np.frombuffer(b or b"", dtype="<i8").reshape(2, -1)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text, runs, start, end) of the documents that may lose bytes: mark is the
    hash of the text, text its bytes, runs their starts, then their ends, as 64-bit integers;
    start and end: further runs, of repeated strings at edges."""
    spark = docs.sparkSession
    parts = partitions(spark)
    found = cut(repeated(docs, parts))
    lists = found.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "anchor", "context", "kind")).alias("a"))
    lists = lists.select(F.col("doc_id").alias("id"), F.col("a.pos").alias("pos"), F.col("a.anchor").alias("anchor"), F.col("a.context").alias("context"), F.col("a.kind").alias("kind"))
    source = docs.select(known_id("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    schema = "doc_id long, mark long, text binary, runs binary, open boolean, anchor long, pos int, kind int, left binary, right binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            size = 0
            for i, text, mark, pos, anchor, context, kind in zip(pdf["id"].tolist(), utf8(pdf["text"]), pdf["mark"].tolist(), pdf["pos"], pdf["anchor"], pdf["context"], pdf["kind"], strict=True):
                pos = np.asarray(pos, dtype=np.int64)
                fits = np.flatnonzero(pos + GRAM <= len(text))
                pos, anchor, context, kind = pos[fits], np.asarray(anchor)[fits], np.asarray(context)[fits], np.asarray(kind)[fits]
                low, high = np.maximum(pos - SIDE, 0), np.minimum(pos + LENGTH, len(text))
                hashes = PrefixHash(np.frombuffer(text, dtype=np.uint8))
                mine = mix(hashes.span(low, high) + (pos - low).astype(np.uint64) * np.uint64(BASE)).view(np.int64) == context
                mine &= high - low >= LENGTH
                whole = mine & (kind > 0)
                near = [(start, start + LENGTH + p) for p, start in nearby(np.frombuffer(text, dtype=np.uint8))]
                edge = np.flatnonzero(mine & (kind != 1))
                for k in edge.tolist():
                    p = int(pos[k])
                    rows.append((i, mark, None, None, None, int(anchor[k]), p, int(kind[k]), text[low[k] : p][::-1], text[p + GRAM : high[k]]))
                size += len(edge) * LENGTH
                waits = bool((kind[edge] == 0).any())
                if waits or whole.any() or near:
                    runs = union(*(np.concatenate(x) for x in zip((low[whole], high[whole]), *near, strict=True)))
                    rows.append((i, mark, text, pack(*runs), waits, None, None, None, None, None))
                    size += len(text)
                if size > 4 << 20:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)

    with bloom_joins(spark):
        both = cut(source.join(lists, "id").mapInPandas(trimmed(applied), schema))
    edges = both.where("anchor is not null").withColumn("range", F.pmod(F.shiftrightunsigned("anchor", 20), F.lit(4 * parts)))
    more = edges.select("range", "doc_id", "mark", "anchor", "pos", "kind", "left", "right").groupBy("range").applyInPandas(trimmed_group(resolve), "doc_id long, mark long, start long, end long")
    more = more.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("m"))
    waiting = both.where("anchor is null and open").select("doc_id", "mark", "text", "runs").join(more, ["doc_id", "mark"], "left")
    waiting = waiting.select("doc_id", "mark", "text", "runs", F.col("m.start").alias("start"), F.col("m.end").alias("end"))
    ready = both.where("anchor is null and not open").select("doc_id", "mark", "text", "runs", F.lit(None).cast("array<bigint>").alias("start"), F.lit(None).cast("array<bigint>").alias("end"))
    return ready.union(waiting)


def whole_runs(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The rows of spans that lose bytes, and the runs of each, those from edges among them. They
    are merged where they are used: another step in Python would keep two workers a task."""
    runs = []
    for b, s, e in zip(pdf["runs"], pdf["start"], pdf["end"], strict=True):
        a = unpack(b)
        more = [np.asarray(x, dtype=np.int64) if x is not None else np.zeros(0, dtype=np.int64) for x in (s, e)]
        runs.append(np.stack(union(np.concatenate([a[0], more[0]]), np.concatenate([a[1], more[1]]))))
    some = np.array([r.shape[1] > 0 for r in runs], dtype=bool)
    return pdf[some], [r for r in runs if r.shape[1]]


def without(text: bytes, runs: np.ndarray, whole_characters: bool = False) -> bytes:
    """text without its runs; with whole_characters, only characters that lie in a run go."""
    data = np.frombuffer(text, dtype=np.uint8)
    keep = np.ones(len(data) + 1, dtype=np.int8)
    edge = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(edge, runs[0], 1)
    np.add.at(edge, runs[1], -1)
    keep = np.cumsum(edge)[:-1] == 0
    if whole_characters and len(data):
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        kept = np.logical_or.reduceat(keep, lead)
        keep = np.repeat(kept, np.diff(np.append(lead, len(data))))
    return data[keep].tobytes()


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_removed, n_spans, kept) of the documents that lose bytes."""

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf, runs = whole_runs(pdf)
            kept = [without(t, r) for t, r in zip(pdf["text"], runs, strict=True)]
            yield pdf[["doc_id", "mark"]].assign(n_removed=[int((r[1] - r[0]).sum()) for r in runs], n_spans=[r.shape[1] for r in runs], kept=kept)

    return spans(docs.select("doc_id", "text")).mapInPandas(trimmed(cut_out), "doc_id long, mark long, n_removed long, n_spans long, kept binary")


def strip(docs: DataFrame) -> DataFrame:
    """docs without repeated passages, their columns unchanged: a character goes if all its
    bytes do, and n_chars, where present, follows. A text that loses all of itself is empty."""

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf, runs = whole_runs(pdf)
            kept = [without(t, r, True).decode("utf-8", "replace") for t, r in zip(pdf["text"], runs, strict=True)]
            yield pd.DataFrame({"_id": pdf["doc_id"], "_mark": pdf["mark"], "_kept": kept})

    new = spans(docs.select("doc_id", "text")).mapInPandas(trimmed(cut_out), "_id long, _mark long, _kept string").dropDuplicates(["_id", "_mark"])
    rows = packed(docs, known_id("doc_id").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("m"))
    both = rows.join(new, (F.col("i") == F.col("_id")) & (F.col("m") == F.col("_mark")), "left")
    changed = {"text": F.coalesce("_kept", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_kept").isNull(), F.col("row.n_chars")).otherwise(F.length("_kept").cast(docs.schema["n_chars"].dataType))
    return unpacked(both, docs, **changed)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lost = removed(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept").dropDuplicates(["doc_id", "mark"]).withColumnRenamed("doc_id", "id")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", known_id("doc_id").alias("id"), F.xxhash64(text).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"))
    joined = rows.join(lost, ["id", "mark"], "left")
    none = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))

"""Sampled SentencePiece segmentations without replacement, and decoding.

Every way to cut a text into pieces has a weight, the product of its pieces' probabilities.
Gumbel noise added to the log weights ranks all segmentations; the k greatest are a sample of
k distinct ones without replacement. They are found without enumeration: the greatest noisy
value of all segmentations that start in one way is drawn top down, so a priority queue of
open prefixes, best first (A-star with the perturbed value as its exact bound), meets complete
segmentations in the order of the sample. Backward sums over the lattice give the share of
each next piece. No piece crosses the start of a word, so lattices are made by word, many at
once, and kept for frequent words. The rows of a batch take each step of their searches
together, on arrays, so a step costs the same few operations for all of them.

The noise is a hash of the row's key, the place and the round: results do not depend on
partitions or batches.
Each sample carries its log probability, its perturbed value, and the probability that it
would be among the k, given the (k+1)-th value (the inclusion score, for weighting).

Pieces of a byte-pair model carry merge ranks, not probabilities; those follow Zipf's law
here: p(rank) ~ 1 / (rank + 10). A character without a piece takes its bytes' pieces.

Defined cases: a null or empty text has one segmentation without pieces; a text with fewer
than k segmentations gives them all, with inclusion 1; repeated rows give equal samples; extra
columns are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_INV, blocks, known_id, mix, null_id, powers, table, trimmed

MODEL = "piece_bpe_32k.model"
SAMPLES = 3
SPACE = "▁"
#: Characters whose samples are drawn together; words whose lattices a worker keeps.
BLOCK, WORDS = 1 << 20, 100_000
#: Behind a prefix of a log probability under -FLOOR a way is among the k with a chance under one
#: in ten millions: there it is not looked at, but in texts of under SHORT words.
FLOOR, SHORT = 26.0, 64
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_LATTICES: dict[str, Lattices] = {}


class Lattices:
    """Pieces of a model and the lattices of words, as flat arrays.

    A node is a position in a word; its edges are the pieces that start there, longest first,
    with their log share, the cumulated shares and the node they lead to (-1: the end).
    A character without a piece leads through a chain of nodes, one a byte. The first WORDS
    words met stay; a batch's other words take the room behind them until the next batch."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sp = sp
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(plain, key=lambda i: -sp.get_score(i))
        bytes_ = [i for i in range(n) if sp.is_byte(i)]
        self.weight = np.full(n, -np.inf)
        self.weight[ranked] = -np.log(np.arange(len(ranked)) + 10.0)
        self.weight[bytes_] = -math.log(len(ranked) + 10.0)
        self.weight -= math.log(np.exp(self.weight).sum())
        pieces = {sp.id_to_piece(i): i for i in plain}
        self.byte = np.zeros(256, dtype=np.int64)
        for i in bytes_:
            self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.longest = max(map(len, pieces))
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        # Pieces by the hash of their characters; a bit table turns most other strings away.
        chars = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        end = np.cumsum(sizes)
        keys = self.spans(self.prefix(chars), end - sizes, sizes)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.fromiter(pieces.values(), dtype=np.int64, count=len(pieces))[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[keys >> np.uint64(44)] = True
        # Where the keys of each entry of the table begin, and how many the fullest entry has.
        tops = self.keys >> np.uint64(44)
        self.slot = np.searchsorted(tops, np.arange(1 << 20, dtype=np.uint64)).astype(np.int32)
        self.fullest = int(np.bincount(tops.astype(np.int64)).max())
        self.known: dict[str, int] = {}
        self.kept = (0, 0)
        self.first = np.zeros(1, dtype=np.int64)
        self.cum, self.log = np.zeros(0), np.zeros(0)
        self.piece, self.to = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int32)

    @staticmethod
    def prefix(chars: np.ndarray) -> np.ndarray:
        out = np.zeros(len(chars) + 1, dtype=np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(chars)), out=out[1:])
        return out

    @staticmethod
    def spans(prefix: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((prefix[start + size] - prefix[start]) * powers(BASE_INV, len(prefix))[start] + np.asarray(size).astype(np.uint64))

    def words(self, text: str) -> list[str]:
        """The marked text, cut where no piece can cross."""
        if not text:
            return []
        if self.by_word and SPACE not in text and "" not in (words := text.split(" ")):
            return [SPACE + w for w in words]
        marked = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return [marked]
        return _WORD.findall(marked)

    def edges(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in words laid end to end, longest first; left
        counts the characters from a position to its word's end."""
        prefix, found = self.prefix(chars), []
        for size in range(min(self.longest, int(left.max(initial=0))), 0, -1):
            at = np.flatnonzero(left >= size)
            key = self.spans(prefix, at, size)
            top = key >> np.uint64(44)
            may = np.flatnonzero(self.some[top])
            at, key, place = at[may], key[may], self.slot[top[may]]
            hit = self.keys[place] == key
            for more in range(1, self.fullest):
                rest = np.flatnonzero(~hit)
                near = np.minimum(place[rest] + more, len(self.keys) - 1)
                same = self.keys[near] == key[rest]
                place[rest[same]], hit[rest[same]] = near[same], True
            found.append((at[hit], np.full(int(hit.sum()), size), self.ids[place[hit]]))
        start, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        return start, size, piece

    def build(self, words: list[str]) -> tuple:
        """Flat lattices of some words: node of each word, first edge of each node, and cum,
        log, piece and to of the edges, all counted from 0."""
        text = "".join(words)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        n = len(chars)
        left = np.repeat(ends, sizes) - np.arange(n)
        start, size, piece = self.edges(chars, left)
        weight = self.weight[piece]
        # Characters without a piece of their own: a chain of byte pieces.
        bare = np.ones(n, dtype=bool)
        bare[start[size == 1]] = False
        bare = np.flatnonzero(bare)
        tails: list[tuple[int, np.ndarray]] = []
        if len(bare):
            own = [self.byte[np.frombuffer(text[i].encode("utf-8", "surrogatepass"), dtype=np.uint8)] for i in bare.tolist()]
            start, size, piece = np.append(start, bare), np.append(size, np.ones(len(bare), dtype=np.int64)), np.append(piece, [x[0] for x in own])
            weight = np.append(weight, [self.weight[x].sum() for x in own])
            tails = [(i, x[1:]) for i, x in zip(bare.tolist(), own, strict=True) if len(x) > 1]
        chained = np.zeros(len(start), dtype=bool)
        if tails:
            chained[len(start) - len(bare) :] = [len(x) > 1 for x in own]
        order = np.argsort(start, kind="stable")
        start, size, piece, weight, chained = start[order], size[order], piece[order], weight[order], chained[order]
        # Backward sums, from the words' ends: positions with as many characters left go together.
        ahead = left[start]
        most = int(left.max(initial=0))
        order = np.argsort(ahead.astype(np.uint16) if most < 1 << 16 else ahead, kind="stable")
        at, goal, mass = start[order], (start + size)[order], weight[order]
        last = (size == ahead)[order]
        bounds = np.searchsorted(ahead[order], np.arange(1, most + 2)).tolist()
        head_of = np.append(True, at[1:] != at[:-1])
        back, value = np.zeros(n + 1), np.empty(len(start))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            v = mass[a:b] + np.where(last[a:b], 0.0, back[goal[a:b]])
            group = np.flatnonzero(head_of[a:b])
            top = np.maximum.reduceat(v, group)
            reps = np.diff(np.append(group, b - a))
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, reps)), group))
            back[at[a:b][group]] = total
            value[order[a:b]] = v - np.repeat(total, reps)
        to = np.where(size == ahead, -1, start + size)
        first = np.append(0, np.cumsum(np.bincount(start, minlength=n)))
        share = np.exp(value)
        run = np.cumsum(share)
        cum = run - np.repeat(np.append(0.0, run)[first[:-1]], np.diff(first))
        cum[first[1:] - 1] = 2.0  # the last edge takes what is left
        if tails:
            head = dict(zip(start[chained].tolist(), np.flatnonzero(chained).tolist(), strict=True))
            more_piece, more_to, node = [], [], n
            for i, rest in tails:
                e = head[i]
                goal, to[e] = to[e], node
                for k, x in enumerate(rest.tolist()):
                    more_piece.append(x)
                    more_to.append(node + 1 if k + 1 < len(rest) else int(goal))
                    node += 1
            m = len(more_piece)
            first = np.append(first, first[-1] + 1 + np.arange(m))
            cum, value = np.append(cum, np.full(m, 2.0)), np.append(value, np.zeros(m))
            piece, to = np.append(piece, more_piece), np.append(to, more_to)
        return ends - sizes, first, cum, value, piece, to

    def nodes(self, words: list[str]) -> np.ndarray:
        """First node of each word; valid until the next call."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        out = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            rare = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(rare))
            n, m = self.kept
            at, first, cum, log, piece, to = self.build(new)
            self.first = np.concatenate([self.first[: n + 1], first[1:] + m])
            self.cum, self.log = np.concatenate([self.cum[:m], cum]), np.concatenate([self.log[:m], log])
            self.piece = np.concatenate([self.piece[:m], piece.astype(np.uint32)])
            self.to = np.concatenate([self.to[:m], np.where(to < 0, -1, to + n).astype(np.int32)])
            local = dict(zip(new, (at + n).tolist(), strict=True))
            if len(self.known) + len(new) <= WORDS:
                self.known.update(local)
                self.kept = (len(self.first) - 1, len(self.cum))
            out[missing] = np.fromiter(map(local.__getitem__, rare), dtype=np.int64, count=len(rare))
        return out

    def lattice(self, word: str, node: int) -> list:
        """At each position the next pieces (end, ids, log share), longest first."""
        a, b = int(self.first[node]), int(self.first[node + len(word)])
        bounds = (self.first[node : node + len(word) + 1] - a).tolist()
        piece, to, log = self.piece[a:b].tolist(), self.to[a:b].tolist(), self.log[a:b].tolist()
        stop, edges = node + len(word), []
        for x, t, v in zip(piece, to, log, strict=True):
            ids = (x,)
            while t >= stop:  # a chain of bytes
                e = int(self.first[t])
                ids, t = (*ids, int(self.piece[e])), int(self.to[e])
            edges.append((len(word) if t < 0 else t - node, ids, v))
        return [edges[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def drawn(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Plain draws from some nodes to their words' ends: ids one after another, their number
        and log probability by draw, and step by step (which draw, node, edge, noise). A draw's
        noise comes from its key alone."""
        n = len(nodes)
        count, logp = np.zeros(n, dtype=np.int64), np.zeros(n)
        which, node, key = np.arange(n), nodes, keys
        steps = []
        while len(which):
            key = key + np.uint64(BASE)
            u = uniform(key)
            e = self.first[node]
            over = np.flatnonzero(u >= self.cum[e])
            while len(over):
                e[over] += 1
                over = over[u[over] >= self.cum[e[over]]]
            steps.append((which, node, e, key))
            count[which] += 1
            logp[which] += self.log[e]
            node = self.to[e]
            go = np.flatnonzero(node >= 0)
            which, node, key = which[go], node[go].astype(np.int64), key[go]
        ids = np.empty(int(count.sum()), dtype=np.uint32)
        place = np.cumsum(count) - count
        for s, (which, _, e, _) in enumerate(steps):
            ids[place[which] + s] = self.piece[e]
        return ids, count, logp, steps


def uniform(key: np.ndarray) -> np.ndarray:
    """Uniform numbers over 0 and under 1 from 64-bit keys."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def lattices(path: str) -> Lattices:
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(path)
    return _LATTICES[path]


def seed(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


#: Multipliers that part the noise of rounds, words and edges.
ROUND, WORD, EDGE = 0xA0761D6478BD642F, np.uint64(0xD1342543DE82EF95), np.uint64(0x2545F4914F6CDD1D)


def sampled(lat: Lattices, texts: list[str], k: int, keys: list[str]) -> Iterator[list[tuple[np.ndarray, float, float, float]]]:
    """Of each text up to k segmentations (ids, log probability, perturbed value, inclusion),
    best first; all texts take each step of the search together.

    Perturbed values are kept as times, exp(-value): the time of a prefix of probability p is
    the least of an exponential clock of rate p. A text's open prefix of least time is taken,
    completed by plain draws (which of the ways on is the earliest does not depend on when),
    and each way left aside opens a prefix whose clock starts anew at the time of the one taken."""
    words = [lat.words(x) for x in texts]
    nodes = lat.nodes([w for x in words for w in x])
    ends = np.cumsum(np.array([len(x) for x in words], dtype=np.int64))
    begins = ends - np.array([len(x) for x in words], dtype=np.int64)
    seeds = np.array([seed(x) for x in keys], dtype=np.uint64)
    out: list[list] = [[] for _ in texts]
    # Open prefixes by text and time: word, node there (-1: its end, -2: its start), log probability,
    # and the ids: those of the parent's path up to pos, then piece.
    names = ("text", "time", "word", "node", "logp", "parent", "pos", "piece")
    n = len(texts)
    pool = dict(zip(names, (np.arange(n), -np.log(uniform(seeds)), begins, np.full(n, -2), np.zeros(n), np.full(n, -1), np.full(n, -1), np.zeros(n, dtype=np.int64)), strict=True))
    for r in range(k):
        lead = np.append(True, pool["text"][1:] != pool["text"][:-1]) if len(pool["text"]) else np.zeros(0, dtype=bool)
        if not lead.any():
            break
        top, pool = {c: v[lead] for c, v in pool.items()}, {c: v[~lead] for c, v in pool.items()}
        start = top["word"] + (top["node"] == -1)
        size = ends[top["text"]] - start
        upto = np.append(0, np.cumsum(size))
        of = np.repeat(np.arange(len(size)), size)
        word = start[of] + np.arange(int(upto[-1])) - upto[:-1][of]
        node = nodes[word]
        inside = np.flatnonzero(top["node"] >= 0)
        node[upto[inside]] = top["node"][inside]
        key = mix(seeds[top["text"]] + np.uint64((r + 1) * ROUND % (1 << 64)))[of] + (word - begins[top["text"]][of]).astype(np.uint64) * WORD
        ids, count, logs, steps = lat.drawn(node, mix(key))
        total, place = np.append(0.0, np.cumsum(logs)), np.append(0, np.cumsum(count))
        before = top["logp"][of] + total[:-1] - total[upto[:-1]][of]
        near, run = (before > -FLOOR) | (ends - begins < SHORT)[top["text"]][of], np.zeros(len(of))
        opened = []
        for s, (which, at, edge, noise) in enumerate(steps):
            own = np.flatnonzero(near[which])
            if not len(own):
                break
            which, at, edge, noise = which[own], at[own], edge[own], noise[own]
            logp = before[which] + run[which]
            run[which] += lat.log[edge]
            first = lat.first[at]
            ways = lat.first[at + 1] - first
            row = np.repeat(np.arange(len(at)), ways)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(ways) - ways, ways)
            aside = first[row] + rank
            logp = logp[row] + lat.log[aside]
            keep = np.flatnonzero(aside != edge[row])
            row, rank, aside, logp = row[keep], rank[keep], aside[keep], logp[keep]
            text = of[which[row]]
            wait = -np.log(uniform(noise[row] + (rank + 1).astype(np.uint64) * EDGE)) * np.exp(np.minimum(-logp, 700.0))
            pos = top["pos"][text] + 1 + place[which[row]] - place[upto[text]] + s
            opened.append((top["text"][text], top["time"][text] + wait, word[which[row]], lat.to[aside].astype(np.int64), logp, np.full(len(row), r), pos, lat.piece[aside].astype(np.int64)))
        for i, t in enumerate(top["text"].tolist()):
            tail = ids[place[upto[i]] : place[upto[i + 1]]]
            if top["parent"][i] >= 0:
                tail = np.concatenate([out[t][top["parent"][i]][0][: top["pos"][i]], [np.uint32(top["piece"][i])], tail])
            out[t].append([tail, float(top["logp"][i] + total[upto[i + 1]] - total[upto[i]]), float(top["time"][i])])
        pool = {c: np.concatenate([pool[c], *(x[j] for x in opened)]) for j, c in enumerate(names)}
        order = np.lexsort((pool["time"], pool["text"]))
        text = pool["text"][order]
        order = order[np.arange(len(order)) - np.searchsorted(text, text) < k - r]  # those that can still be among the k, and one more
        pool = {c: v[order] for c, v in pool.items()}
    bar = np.full(n, np.inf)
    bar[pool["text"][::-1]] = pool["time"][::-1]
    for t, found in enumerate(out):
        yield [(ids, logp, -math.log(time), -math.expm1(-math.exp(logp) * bar[t]) if bar[t] < np.inf else 1.0) for ids, logp, time in found]


def sample(lat: Lattices, text: str, k: int, key: str) -> list[tuple[list[int], float, float, float]]:
    """Up to k segmentations (ids, log probability, perturbed value, inclusion), best first."""
    return [(ids.tolist(), *rest) for ids, *rest in next(iter(sampled(lat, [text], k, [key])))]


def best(lat: Lattices, text: str) -> list[int]:
    """The most likely segmentation."""
    out: list[int] = []
    words = lat.words(text)
    for word, node in zip(words, lat.nodes(words).tolist(), strict=True):
        steps = lat.lattice(word, node)
        n = len(steps)
        score, choice = [0.0] * (n + 1), [None] * n
        for i in range(n - 1, -1, -1):
            # Shares along a way differ from weights by the same sum for all ways.
            choice[i] = max(steps[i], key=lambda c: c[2] + score[c[0]])
            score[i] = choice[i][2] + score[choice[i][0]]
        at = 0
        while at < n:
            at, ids, _ = choice[at]
            out += ids
    return out


def decode(lat: Lattices, ids: list[int]) -> str:
    """The text of a segmentation."""
    out = b"".join(bytes([int(p[3:5], 16)]) if lat.sp.is_byte(i) else p.encode("utf-8") for i in ids for p in [lat.sp.id_to_piece(i)])
    return out.decode("utf-8", "surrogatepass").replace(SPACE, " ")[1:]


def segmentations(rows: DataFrame, key: Column, path: str, k: int = SAMPLES, digest: bool = False) -> DataFrame:
    """One row per sample of rows(text, ...): their other columns, sample (from 1), ids,
    log_prob, perturbed and inclusion. key names a row for its noise. A digest has n_pieces and
    ids_crc32, as the last columns, for the ids."""
    keep = [f for f in rows.schema.fields if f.name != "text"]
    made = "log_prob double, perturbed double, inclusion double, n_pieces long, ids_crc32 long" if digest else "ids array<int>, log_prob double, perturbed double, inclusion double"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "sample int", made])
    names = [f.name for f in keep]
    columns = ["sample", *(c.split()[0] for c in made.split(", "))]

    def made_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lat = lattices(path)
        for pdf in batches:
            names_of = [x or "" for x in pdf["_key"]]
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            for a, b in blocks(texts, BLOCK):
                at, out = [], []
                for i, found in enumerate(sampled(lat, texts[a:b], k, names_of[a:b])):
                    for r, (ids, *values) in enumerate(found):
                        at.append(a + i)
                        out.append((r + 1, *values, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) if digest else (r + 1, ids.tolist(), *values))
                yield pd.concat([pdf[names].iloc[at].reset_index(drop=True), pd.DataFrame(out, columns=columns)], axis=1)

    return rows.withColumn("_key", key.cast("string")).mapInPandas(trimmed(made_of), schema)


def op9_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every turn of `conversations`, as digests."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return segmentations(rows, F.concat_ws(":", "conv_id", "turn"), public_tokenizers.path(MODEL), digest=True)


def op9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every whole text of `documents`, as digests."""
    rows = table(spark, sf_dir, "documents").select(known_id("doc_id").alias("doc_id"), "text")
    made = segmentations(rows, F.col("doc_id"), public_tokenizers.path(MODEL), digest=True)
    return made.withColumn("doc_id", null_id(F.col("doc_id")))

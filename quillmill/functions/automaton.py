"""Many patterns in one pass: an automaton as arrays, stepped through all texts of a batch at
once. The state table has a row a prefix of a pattern and a column a character; a step looks up
the next state of thousands of text pieces together.

A batch's texts are laid end to end, parted by a character that no pattern has, and cut into
pieces of equal length. Each piece starts as many characters early as the longest pattern needs,
so it reaches its own first character in a state that knows all patterns open there.

Dictionaries of any size: a table has at most CELLS entries, and larger ones are dealt to several
tables, each of which is stepped through the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries of a table, characters of a piece at least, and characters of texts stepped at once.
CELLS, PIECE, BATCH_CHARS = 1 << 23, 256, 1 << 21


class Table:
    """The automaton of some patterns (distinct, not empty)."""

    def __init__(self, words: list[str]) -> None:
        letters = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        self.width, self.longest = len(letters) + 1, max(map(len, words))
        self.letters = np.array(sorted(map(ord, letters)), dtype=np.uint32)
        down: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for k, w in enumerate(words):
            at = 0
            for c in w:
                code = letters[c]
                if code not in down[at]:
                    down[at][code] = len(down)
                    down.append({})
                    ends.append(-1)
                at = down[at][code]
            ends[at] = k
        n = len(down)
        self.table = np.zeros((n, self.width), dtype=np.int32)
        shorter = np.zeros(n, dtype=np.int64)  # the longest proper suffix that is a prefix of a pattern
        told: list[list[int]] = [[]]  # patterns that end in a state, longest first
        told += [[]] * (n - 1)
        for code, child in down[0].items():
            self.table[0, code] = child
        level = list(down[0].values())
        for child in level:
            told[child] = [ends[child]] if ends[child] >= 0 else []
        while level:
            deeper = []
            self.table[level] = self.table[shorter[level]]
            for at in level:
                for code, child in down[at].items():
                    shorter[child] = self.table[at, code]
                    self.table[at, code] = child
                    deeper.append(child)
            for child in deeper:
                told[child] = ([ends[child]] if ends[child] >= 0 else []) + told[shorter[child]]
            level = deeper
        self.many = np.array([len(x) for x in told], dtype=np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.told = np.array([k for x in told for k in x], dtype=np.int64)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Columns of the table for characters; 0 for those that no pattern has."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0).astype(np.int32)

    def ends_in(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, pattern) of every occurrence, overlapping ones too; place: its last character."""
        early, piece = self.longest - 1, max(PIECE, 8 * self.longest)
        n = len(points)
        if not n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        rows = -(-n // piece)
        padded = np.zeros(early + rows * piece, dtype=np.int32)
        padded[early : early + n] = self.codes(points)
        cut = np.lib.stride_tricks.sliding_window_view(padded, early + piece)[::piece]
        steps = np.ascontiguousarray(cut.T)
        flat, state = self.table.ravel(), np.zeros(rows, dtype=np.int32)
        places, states = [], []
        for j, codes in enumerate(steps):
            state = flat[state * self.width + codes]
            if j >= early:
                hit = np.flatnonzero(self.many[state])
                if len(hit):
                    places.append(hit * piece + (j - early))
                    states.append(state[hit])
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        place, state = np.concatenate(places), np.concatenate(states)
        each = self.many[state]
        at = np.repeat(self.first[state] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return np.repeat(place, each), self.told[at]


class Patterns:
    """Tables of a dictionary; patterns keep their places in it."""

    def __init__(self, words: list[str]) -> None:
        self.size = len(words)
        self.tables: list[tuple[Table, np.ndarray]] = []
        order = sorted((w, k) for k, w in enumerate(words) if w)  # neighbours share prefixes
        todo = [order] if order else []
        while todo:
            part = todo.pop()
            if len(part) > 1 and sum(len(w) for w, _ in part) * (len({c for w, _ in part for c in w}) + 1) > CELLS:
                todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            names = list(dict.fromkeys(w for w, _ in part))
            place = {w: k for w, k in reversed(part)}
            self.tables.append((Table(names), np.array([place[w] for w in names], dtype=np.int64)))

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, occurrences) by text and pattern, of those that occur."""
        out, first = [], 0
        sizes = [len(t) + 1 for t in texts]
        while first < len(texts):
            last, chars = first, 0
            while last < len(texts) and (last == first or chars + sizes[last] <= BATCH_CHARS):
                chars += sizes[last]
                last += 1
            # surrogatepass: texts may hold lone surrogates, which are characters like others here
            points = np.frombuffer("\0".join(texts[first:last]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            breaks = np.cumsum(sizes[first:last]) - 1  # the places between texts
            for table, names in self.tables:
                place, pattern = table.ends_in(points)
                out.append((np.searchsorted(breaks, place) + first) * self.size + names[pattern])
            first = last
        key, n = np.unique(np.concatenate(out) if out else np.zeros(0, dtype=np.int64), return_counts=True)
        return key // max(1, self.size), key % max(1, self.size), n


def _lists(rows: int, text: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.searchsorted(text, np.arange(1, rows))) if rows else []


def occurrences(text: Column, words: list[str]) -> Column:
    """Struct of `at`, the places in words (from 0, ascending) of those that a text holds, and
    `n`, how often each does, overlapping occurrences too. Words must be distinct."""
    if any("\0" in w for w in words):
        raise ValueError("a pattern cannot hold the character that parts texts")

    @F.pandas_udf("at array<int>, n array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        patterns = Patterns(words)
        for s in batches:
            of, at, n = patterns.count(s.fillna("").to_list())
            yield pd.DataFrame({"at": _lists(len(s), of, at.astype(np.int32)), "n": _lists(len(s), of, n.astype(np.int32))}, columns=["at", "n"])

    return found(text)

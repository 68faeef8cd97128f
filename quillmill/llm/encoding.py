"""Encoding of many texts with a file of the tokenizers library.

Words recur, so each worker keeps the ids of the units it has met and asks the library for
new ones only. A unit is a stretch of text at whose ends the vocabulary's pattern ends a
pre-token whatever stands around it, so that ids of units, one after another, are the ids of
the text:

* between units lies white space, or a change between letters, digits and other signs;
* a word with an apostrophe stays whole, as the patterns take endings such as 's apart;
* where white space is kept (spaced), a space belongs to the unit after it and any other
  white-space character is a unit.

Texts are cut this way if they hold ASCII and Latin letters only, have no string of a special
token and (spaced) no two white-space characters in a row; all others are encoded whole.
Units are cut and compared in bulk, by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

from .common import PrefixHash

#: Units remembered by a worker; beyond that it starts anew.
MEMORY = 1_000_000
_ENCODERS: dict[tuple[str, bool], Encoder] = {}

_SEPARATOR, _BLANK, _LETTER, _DIGIT, _SIGN, _BAD = range(6)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[0] = _SEPARATOR
_CLASS[[*range(9, 14), 32]] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[48:58] = _DIGIT
#: Control characters on which patterns and Python may differ, and bytes of other letters or signs.
_CLASS[[*range(1, 9), *range(14, 32), 127, 0xC0, 0xC1, 0xC2, *range(0xC6, 256)]] = _BAD
_ODD = re.compile(rb"<\||\xc3[\x97\xb7]|\x00")


class Encoder:
    """Ids of texts by the vocabulary at path; spaced: white space takes part."""

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        #: For each id, whether it ends a word, where the vocabulary has such marks.
        self.final = None
        vocabulary = {} if spaced else self.tokenizer.get_vocab()
        if any(t.endswith("</w>") for t in vocabulary):
            self.final = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        #: Hashes of the units met, sorted, and the number of each; its ids are
        #: flat[first[number] : first[number + 1]].
        self.keys, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.first = np.zeros(1 << 16, dtype=np.int64)

    def ask(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, units: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the units, and their ids in it, one after another, with their sizes.

        Words are asked for in runs where the vocabulary marks the ends of words, which
        spares one answer a word; a run whose marks do not add up is asked for word by word."""
        words = [] if self.final is None else [k for k, u in enumerate(units) if u.isalpha()]
        order, ids, sizes = [], [], []
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            found = np.array(self.ask([" ".join([units[i] for i in part])])[0], dtype=np.uint32)
            ends = np.flatnonzero(self.final[found]) + 1
            if len(ends) == len(part) and ends[-1] == len(found):
                order += part
                ids.append(found)
                sizes.append(np.diff(ends, prepend=0))
        done = set(order)
        rest = [k for k in range(len(units)) if k not in done]
        found = self.ask([units[k] for k in rest])
        ids.append(np.array([i for x in found for i in x], dtype=np.uint32))
        sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        return order + rest, np.concatenate(ids), np.concatenate(sizes)

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        order, ids, sizes = self.units(units)
        base, n = len(self.keys), len(keys)
        used = int(self.first[base])
        total = used + len(ids)
        while base + n + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        while total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[base + 1 : base + n + 1] = used + np.cumsum(sizes)
        self.flat[used:total] = ids
        every, numbers = np.concatenate([self.keys, keys[order]]), np.concatenate([self.numbers, np.arange(base, base + n, dtype=np.int32)])
        by = np.argsort(every, kind="stable")
        self.keys, self.numbers = every[by], numbers[by]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of sorted keys, -1 for new ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.numbers[at], np.int32(-1))

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the units of texts joined by zero bytes."""
        kind = _CLASS[data]
        change = np.ones(len(data), dtype=bool)
        change[1:] = kind[1:] != kind[:-1]
        quote = np.flatnonzero(data == 0x27)
        if len(quote):  # no unit ends within a word that has an apostrophe
            edges = np.flatnonzero(kind <= _BLANK)
            at = np.searchsorted(edges, quote)
            low = np.where(at > 0, edges[np.maximum(at - 1, 0)], -1) + 2
            high = np.where(at < len(edges), edges[np.minimum(at, len(edges) - 1)], len(data))
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                change[a:b] = False
        if not self.spaced:
            start = np.flatnonzero(change)
            end = np.append(start[1:], len(data))
            keep = kind[start] > _BLANK
            return start[keep], end[keep]
        change |= kind <= _BLANK  # each white-space character starts a unit
        after = np.flatnonzero(data == 32) + 1
        after = after[after < len(data)]
        change[after[kind[after] > _BLANK]] = False  # and a space goes with what follows
        start = np.flatnonzero(change)
        end = np.append(start[1:], len(data))
        keep = kind[start] != _SEPARATOR
        return start[keep], end[keep]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (uint32) of each text."""
        if len(self.keys) > MEMORY:
            self.forget()
        out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(texts)
        split, parts, whole = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            body = text.encode("utf-8", "surrogatepass")
            if _ODD.search(body) or self.spaced and len(" ".join(text.split())) != len(text):
                whole.append(i)
            else:
                split.append(i)
                parts.append(body)
        if parts:
            data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
            ends = np.cumsum(np.fromiter((len(x) + 1 for x in parts), dtype=np.int64, count=len(parts)))
            bad = np.unique(np.searchsorted(ends, np.flatnonzero(_CLASS[data] == _BAD), side="right"))
            if len(bad):
                whole += [split[k] for k in bad]
                bad = set(bad.tolist())
                parts = [x for k, x in enumerate(parts) if k not in bad]
                split = [x for k, x in enumerate(split) if k not in bad]
                data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
                ends = np.cumsum(np.fromiter((len(x) + 1 for x in parts), dtype=np.int64, count=len(parts)))
        for i, ids in zip(whole, self.ask([texts[i] for i in whole]), strict=True):
            out[i] = np.array(ids, dtype=np.uint32)
        if not parts:
            return out
        start, end = self.cut(data)
        keys, example, which = np.unique(PrefixHash(data).span(start, end), return_index=True, return_inverse=True)
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            where = example[new]
            body = data.tobytes()
            self.learn(keys[new], [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            at = self.find(keys)
        row = at[which]
        base = self.first[row]
        size = self.first[row + 1] - base
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(base - (upto - size), size) + np.arange(total)]
        last = np.concatenate([[0], upto])[np.searchsorted(start, ends)]
        for i, a, b in zip(split, [0, *last[:-1].tolist()], last.tolist(), strict=True):
            out[i] = ids[a:b]
        return out


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's own encoder for that file."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def encoded(texts: list[str], path: str, spaced: bool, limit: int = 4 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(position, ids) of each text in order, about limit characters at a time."""
    enc, first, size = encoder(path, spaced), 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or i > first and size + len(texts[i]) > limit:
            yield from zip(range(first, i), enc.encode(texts[first:i]), strict=True)
            first, size = i, 0
        size += len(texts[i]) if i < len(texts) else 0

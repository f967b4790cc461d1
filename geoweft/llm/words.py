"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a longest run of letters, digits and underscores of the lower-case text."""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .arrow import once

U = np.uint64
_STEP, _PAIR = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for run in re.finditer(r"\w+", "".join(map(chr, range(0x110000)))):
        table[run.start():run.end()] = True
    return table


def _is_word() -> np.ndarray:
    """Of each code point whether it belongs to words."""
    return once("words", _word_table)


@dataclass
class Words:
    """Of each word its hash and text; the texts' first words, and one past the last."""
    hashes: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def shingles(self, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of every run of n words; of a text with fewer words, if
        `short`, the one run that it is."""
        total = len(self.hashes)
        if total >= n:
            ok = self.doc[:total - n + 1] == self.doc[n - 1:]
            at = np.flatnonzero(ok)
            run = np.zeros(total - n + 1, U)
            for j, p in enumerate(powers(_PAIR, n)):
                run += self.hashes[j:total - n + 1 + j] * p
            out, doc = mix(run[at]), self.doc[at]
        else:
            at = doc = np.zeros(0, np.int64)
            out = np.zeros(0, U)
        if short:
            counts = np.diff(self.first)
            few = np.flatnonzero((counts > 0) & (counts < n))
            if len(few):
                p = powers(_PAIR, n)
                own = np.array([np.sum(self.hashes[self.first[d]:self.first[d + 1]] * p[:counts[d]], dtype=U) + U(counts[d]) for d in few], U)
                out, doc, at = np.concatenate([out, mix(own)]), np.concatenate([doc, few]), np.concatenate([at, self.first[few]])
        return out, doc, at

    def whole(self) -> np.ndarray:
        """128 bits for each text's words in their order, as rows of two numbers."""
        total, docs = len(self.hashes), len(self.first) - 1
        out = np.zeros((docs, 2), U)
        if total:
            place = np.arange(total) - self.first[self.doc]
            some = np.flatnonzero(np.diff(self.first) > 0)
            for i, base in enumerate((_STEP, _PAIR)):
                p = powers(base, int(place.max()) + 1)
                sums = np.add.reduceat(mix(self.hashes + U(i)) * p[place], self.first[some])
                out[some, i] = mix(sums + np.diff(self.first)[some].astype(U))
        return out


def words(texts: list[str]) -> Words:
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return Words(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64))
    inside = _is_word()[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in low])
    first = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    if not len(starts):
        return Words(np.zeros(0, U), np.zeros(0, np.int64), first)
    at = np.flatnonzero(inside)
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(offsets, lengths)
    p = powers(_STEP, int(lengths.max()))
    sums = np.add.reduceat((codes[at].astype(U) + U(1)) * p[place], offsets)
    return Words(mix(sums), np.repeat(np.arange(len(texts)), np.diff(first)), first)

"""Elias-Fano coded sequences and the n-gram trie made of them.

A monotone sequence keeps its low bits as they are (whole bytes) and its high bits in unary: a one for each value, a
zero at each step to the next high part. The coded arrays lie flat one after another, so ``Trie.load`` reads them in
place from any buffer, such as anonymous memory (``mapped``) or a file that is mapped; only the places of the zeros are
spelled out on loading.
"""

from __future__ import annotations

import json
import mmap
from dataclasses import dataclass

import numpy as np

from . import arrays as A

Arrays = dict[str, np.ndarray]


class Monotone:
    """A non-decreasing sequence of 64-bit integers, searched and read for whole arrays at once."""

    def __init__(self, low: np.ndarray, high: np.ndarray, meta: np.ndarray) -> None:
        self.n, self.width = int(meta[0]), int(meta[1])  # width: bytes of low bits
        self.low, self.high, self.meta = low, high, meta
        bits = np.unpackbits(high, bitorder="little")[: int(meta[2])]
        zeros = np.flatnonzero(bits == 0)
        self.start = np.append(0, zeros - np.arange(len(zeros))).astype(np.int64)  # values below each high part

    @classmethod
    def code(cls, values: np.ndarray) -> Arrays:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = min(7, max(0, -(-max(0, (top // max(1, n)).bit_length()) // 8)))
        low = (values.astype(A.U)[:, None] >> (A.U(8) * np.arange(width, dtype=A.U))[None]).astype(np.uint8)
        high = (values.astype(A.U) >> A.U(8 * width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return {"low": low.ravel(), "high": np.packbits(bits, bitorder="little"), "meta": np.array([n, width, len(bits)], np.int64)}

    def lows(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), A.U)
        for i in range(self.width):
            out |= self.low[at * self.width + i].astype(A.U) << A.U(8 * i)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Where each value's first place at or after it is (the successor), by bisection among its high part's values."""
        high = values >> A.U(8 * self.width)
        past = high >= A.U(len(self.start) - 1)
        h = np.where(past, A.U(0), high).astype(np.int64)
        lo, hi = self.start[h], self.start[np.minimum(h + 1, len(self.start) - 1)]
        want = values & A.U((1 << (8 * self.width)) - 1)
        return np.where(past, self.n, bisect(lo, hi, want, self.lows))

    def get(self, at: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.start, at, "right") - 1
        return (high.astype(A.U) << A.U(8 * self.width)) | self.lows(at)

    def has(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are in the sequence, and where."""
        if not self.n:
            return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
        at = self.find(values)
        found = at < self.n
        found[found] = self.get_at_high(values[found], at[found])
        return found, at

    def get_at_high(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the value at each place equals the one sought there."""
        h = (values >> A.U(8 * self.width)).astype(np.int64)
        ok = (h < len(self.start) - 1) & (at < self.start[np.minimum(h + 1, len(self.start) - 1)])
        ok[ok] = self.lows(at[ok]) == (values[ok] & A.U((1 << (8 * self.width)) - 1))
        return ok


def bisect(lo: np.ndarray, hi: np.ndarray, want: np.ndarray, read: callable) -> np.ndarray:
    """The first place in each [lo, hi) whose value, as ``read`` gives it, is not below the one wanted; or hi."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = read(mid) < want[open_]
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


EXACT, STEPS = 1 << 15, 682


def encode(count: np.ndarray) -> np.ndarray:
    """16-bit codes of counts: exact below ``EXACT``, else on a logarithmic scale of ``STEPS`` steps an octave, rounded
    down (a part in a thousand). 0: none."""
    large = EXACT + np.floor(np.log2(np.maximum(count, EXACT) / EXACT) * STEPS)
    return np.where(count < EXACT, count, np.minimum(large, 65535)).astype(np.uint16)


def decode(code: np.ndarray) -> np.ndarray:
    return np.where(code < EXACT, code, EXACT * np.exp2((code.astype(np.float64) - EXACT) / STEPS))


def mapped(data: bytes) -> mmap.mmap:
    """The bytes in anonymous memory of their own, which goes back to the system as soon as nothing uses it."""
    out = mmap.mmap(-1, max(1, len(data)))
    out.write(data)
    return out


TAIL = 40  # bits of a word's name that a list keeps


def tail(name: np.ndarray) -> np.ndarray:
    """Names that are hashes have their first bit set; they keep it and the next ones."""
    return np.where(name >> A.U(63), name >> A.U(64 - TAIL), name)


@dataclass
class Level:
    """Lists of one-word extensions: each parent's list is sorted, and ``pointers`` say where it starts and ends."""

    high: np.ndarray  # first 32 bits of the tails
    low: np.ndarray  # the other 8
    code: np.ndarray
    pointers: Monotone

    @staticmethod
    def parts(tails: np.ndarray, code: np.ndarray, pointers: np.ndarray) -> Arrays:
        more = {f"pointers_{k}": v for k, v in Monotone.code(pointers).items()}
        return {"high": (tails >> A.U(8)).astype(np.uint32), "low": tails.astype(np.uint8), "code": code, **more}

    def find(self, parent: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tails stand in their parents' lists, and where: a bisection between two pointers."""
        lo, hi = (self.pointers.get(parent + i).astype(np.int64) for i in (0, 1))
        at = bisect(lo, hi, tails, lambda i: (self.high[i].astype(A.U) << A.U(8)) | self.low[i])
        found = at < hi
        there = at[found]
        found[found] = ((self.high[there].astype(A.U) << A.U(8)) | self.low[there]) == tails[found]
        return found, at


@dataclass
class Trie:
    """Words with their counts; contexts with pointers to the words that follow them; of each such pair, pointers to the
    words that come before it. Counts of pairs and triples are 16-bit codes."""

    words: Monotone
    count: np.ndarray
    contexts: Monotone
    pairs: Level
    triples: Level

    @staticmethod
    def build(word: np.ndarray, count: np.ndarray, context: np.ndarray, after: np.ndarray, pair_count: np.ndarray, of: np.ndarray, before: np.ndarray, triple_count: np.ndarray) -> bytes:
        """``word``: sorted hashes. ``context`` (name) and ``after`` (tail): pairs, sorted. ``of`` (number of its pair)
        and ``before`` (tail): triples, sorted."""
        contexts, first = np.unique(context, return_index=True)
        parts = {"count": count.astype(np.int64)}
        for name, seq in (("words", word), ("contexts", contexts)):
            parts |= {f"{name}_{k}": v for k, v in Monotone.code(seq).items()}
        for name, level in (("pairs", (after, encode(pair_count), np.append(first, len(context)))), ("triples", (before, encode(triple_count), np.searchsorted(of, np.arange(len(context) + 1))))):
            parts |= {f"{name}_{k}": v for k, v in Level.parts(*level).items()}
        head, body, at = [], [], 0
        for name, x in parts.items():
            head.append((name, x.dtype.str, at, len(x)))
            body.append(x.tobytes() + bytes(-x.nbytes % 8))
            at += len(body[-1])
        table = json.dumps(head).encode()
        table += b" " * (-len(table) % 8)
        return b"".join((len(table).to_bytes(8, "little"), table, *body))

    @classmethod
    def load(cls, source: bytes | mmap.mmap) -> Trie:
        """From a buffer; nothing is copied."""
        first = 8 + int.from_bytes(source[:8], "little")
        z = {name: np.frombuffer(source, kind, n, first + at) for name, kind, at, n in json.loads(source[8:first])}
        seq = lambda name: Monotone(*(z[f"{name}_{k}"] for k in ("low", "high", "meta")))
        level = lambda name: Level(*(z[f"{name}_{k}"] for k in ("high", "low", "code")), seq(f"{name}_pointers"))
        return cls(seq("words"), z["count"], seq("contexts"), level("pairs"), level("triples"))

    def counts(self, word: np.ndarray) -> np.ndarray:
        """Counts of words, 0 for unknown ones."""
        found, at = self.words.has(word)
        out = np.zeros(len(word), np.int64)
        out[found] = self.count[at[found]]
        return out

    def pair_codes(self, context: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs' counts, and the pairs' numbers (-1: not in the trie)."""
        known, at = self.contexts.has(context)
        place, known = np.full(len(context), -1), np.flatnonzero(known)
        found, where = self.pairs.find(at[known], after[known])
        place[known[found]] = where[found]
        return np.where(place < 0, 0, self.pairs.code[place] if len(self.pairs.code) else 0).astype(np.uint16), place

    def triple_codes(self, pair: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Codes of the counts of the triples that the words ``before`` make with pairs of these numbers."""
        out, known = np.zeros(len(pair), np.uint16), np.flatnonzero(pair >= 0)
        found, where = self.triples.find(pair[known], before[known])
        out[known[found]] = self.triples.code[where[found]]
        return out

"""Elias-Fano sequences and the trie levels made of them, queried in compact form with NumPy."""

from __future__ import annotations

import io
import os
import tempfile
from dataclasses import dataclass
from functools import cached_property

import numpy as np

U = np.uint64
#: Bits that tell the successors of one context apart; contexts have the rest of 64.
TAIL = 24


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of width bits, one after the other, in 64-bit words."""
    words = np.zeros(len(values) * width // 64 + 2, U)
    if width:
        at = np.arange(len(values), dtype=U) * U(width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        low = values & U((1 << width) - 1)
        np.bitwise_or.at(words, word, low << shift)
        over = shift + U(width) > 64
        np.bitwise_or.at(words, word[over] + 1, low[over] >> (U(64) - shift[over]))
    return words


@dataclass
class EliasFano:
    """A non-decreasing sequence of n values below 2^64: low bits in fields, high bits as gaps between set bits."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(58, max(0, (top // max(1, n)).bit_length() - 1))
        at = (values >> U(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((n + (top >> width) + 2) // 64 + 1) * 64, np.uint8)
        bits[at] = 1
        return cls(n, width, _pack_low(values, width), np.packbits(bits, bitorder="little").view(U))

    @cached_property
    def _bits(self) -> np.ndarray:
        return np.unpackbits(self.high.view(np.uint8), bitorder="little")

    @cached_property
    def _gaps(self) -> np.ndarray:
        """The high part of each value. A reader decodes it when it first asks: four bytes a value, once for all that it asks."""
        at = np.flatnonzero(self._bits)
        return (at - np.arange(len(at))).astype(np.uint32)

    @cached_property
    def _ends(self) -> np.ndarray:
        """How many values have at most each high part."""
        at = np.flatnonzero(self._bits == 0)
        return (at - np.arange(len(at))).astype(np.int32)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.width)
        word, shift = (at >> U(6)).astype(np.int64), at & U(63)
        more = np.where(shift > 0, self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return ((self.low[word] >> shift) | more) & U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        return self._gaps[i].astype(U) << U(self.width) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value that isn't below each x (n if none), and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high = x >> U(self.width)
        last = U(len(self._ends) - 1)
        beyond = high > last
        high = np.minimum(high, last).astype(np.int64)
        end = self._ends[high].astype(np.int64)
        begin = np.where(high > 0, self._ends[np.maximum(high - 1, 0)], 0).astype(np.int64)
        want = x & U((1 << self.width) - 1)
        lo, hi = begin, end
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less = self._low(np.minimum(mid, self.n - 1)) < want
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        same = (lo < end) & ~beyond
        same[same] = self._low(lo[same]) == want[same]
        return np.where(beyond, self.n, lo), same

    def parts(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}_n": np.array([self.n, self.width]), f"{name}_low": self.low, f"{name}_high": self.high}

    @classmethod
    def read(cls, parts: dict[str, np.ndarray], name: str) -> EliasFano:
        n, width = parts[f"{name}_n"].tolist()
        return cls(n, width, parts[f"{name}_low"], parts[f"{name}_high"])


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of one byte, and the 256 values at most that they stand for: the most frequent ones as they are, the others evenly spread."""
    distinct, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
    if len(distinct) <= 256:
        return inverse.astype(np.uint8), distinct
    book = np.unique(np.concatenate([distinct[np.argsort(times)[-192:]], np.linspace(distinct[0], distinct[-1], 64)]))
    at = np.clip(np.searchsorted(book, distinct), 1, len(book) - 1)
    code = np.where(distinct - book[at - 1] <= book[at] - distinct, at - 1, at)
    return code[inverse].astype(np.uint8), book


@dataclass
class Trie:
    """One level over another: contexts with a quantised weight each, the monotone pointers to their ranges, their successors, and a
    quantised value of each successor.

    A successor is kept as its context's number and TAIL bits of its own, so that the sequence rises across contexts and a
    successor is sought within its context's range.
    """

    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    parts: dict[str, np.ndarray]

    @classmethod
    def of(cls, context: np.ndarray, tail: np.ndarray, value: np.ndarray, weight: np.ndarray) -> Trie:
        """The trie of n-grams sorted by context and then tail (below 2^TAIL), all different, with a value each, and a weight of each distinct context."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        number = np.cumsum(new) - 1
        if len(context) and number[-1] >> (64 - TAIL):
            raise ValueError("too many contexts for one trie")
        begin = np.flatnonzero(new)
        (codes, book), (weights, weight_book) = quantise(value), quantise(weight)
        parts = {"codes": codes, "book": book, "weights": weights, "weight_book": weight_book}
        return cls(EliasFano.of(context[begin]), EliasFano.of(np.append(begin, len(context))), EliasFano.of(number.astype(U) << U(TAIL) | tail), parts)

    def find(self, context: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams there are, and the value of each; of those that aren't, the weight of the context (0 where that isn't either)."""
        found, value = np.zeros(len(context), bool), np.zeros(len(context))
        p = self.parts
        for a in range(0, len(context), 1 << 16):
            part = slice(a, a + (1 << 16))
            number, there = self.contexts.successor(context[part])
            rows = np.flatnonzero(there)
            number = number[rows]
            value[a + rows] = p["weight_book"][p["weights"][number]]
            place, same = self.successors.successor(number.astype(U) << U(TAIL) | tail[part][rows])
            rows, number, place = rows[same], number[same], place[same]
            inside = (self.pointers.get(number).astype(np.int64) <= place) & (place < self.pointers.get(number + 1).astype(np.int64))
            found[a + rows[inside]] = True
            value[a + rows[inside]] = p["book"][p["codes"][place[inside]]]
        return found, value

    def dump(self) -> bytes:
        return dump(self.contexts.parts("c") | self.pointers.parts("p") | self.successors.parts("s") | self.parts)

    @classmethod
    def load(cls, parts: dict[str, np.ndarray]) -> Trie:
        return cls(*(EliasFano.read(parts, k) for k in "cps"), {k: parts[k] for k in ("codes", "book", "weights", "weight_book")})


def dump(parts: dict[str, np.ndarray]) -> bytes:
    """Named arrays as bytes that mapped() can read; each begins at a multiple of 64."""
    head, body, at = [], io.BytesIO(), 0
    for name, a in parts.items():
        a = np.ascontiguousarray(a)
        head.append(f"{name} {a.dtype.str} {at} {a.size}")
        body.write(a.tobytes())
        at = -(-body.tell() // 64) * 64
        body.write(b"\0" * (at - body.tell()))
    text = "\n".join(head).encode()
    return (str(len(text)).encode() + b"\n" + text).ljust(-(-(len(text) + 12) // 64) * 64) + body.getvalue()


def mapped(blob: bytes) -> dict[str, np.ndarray]:
    """The arrays of a dump, mapped from a file of the executor's own that goes with the last of them."""
    size, rest = blob[:12].split(b"\n", 1)[0], blob.index(b"\n") + 1
    head = blob[rest : rest + int(size)].decode()
    start = -(-(int(size) + 12) // 64) * 64
    if len(blob) == start:
        return {n: np.zeros(0, t) for n, t, _, _ in map(str.split, head.split("\n"))}
    f, path = tempfile.mkstemp()
    try:
        with os.fdopen(f, "wb") as out:
            out.write(blob)
        whole = np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)  # the mapping outlives the name
    out = {}
    for name, kind, at, n in map(str.split, head.split("\n")):
        a = start + int(at)
        out[name] = whole[a : a + int(n) * np.dtype(kind).itemsize].view(kind)
    return out

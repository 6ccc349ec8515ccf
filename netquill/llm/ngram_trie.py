"""A shard of an n-gram trie in Elias-Fano form.

The first level holds the names of the contexts, the second, context by context, the sorted words that follow, as numbers among the shard's own words.
The numbers of all contexts make one monotone sequence (each context continues where the one before ended); so do the names, the pointers to
the second level and the running totals of the counts. All four are kept as Elias-Fano sequences: the low bits packed, the high bits in
unary. Counts are whole and exact.

All arrays lie in one flat buffer, the value of one row of a table.
"""

from __future__ import annotations

import json

import numpy as np


class EliasFano:
    """A monotone sequence of whole numbers: low bits packed in 64-bit words, high bits in unary, counts of ones before each word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.low, self.high, self.before = n, bits, low, high, before

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(int(np.floor(np.log2((top + 1) / n))), 0) if n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        before = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))[:-1].astype(np.int32)
        return cls(n, bits, low, high, before)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``: select in the high bits, then the low bits."""
        word = np.searchsorted(self.before, i, side="right") - 1
        rest, rank, at = self.high[word], i - self.before[word], np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count(rest & np.uint64((1 << width) - 1))
            jump = rank >= ones
            rank = np.where(jump, rank - ones, rank)
            rest = np.where(jump, rest >> np.uint64(width), rest)
            at += jump * width
        value = word * 64 + at - i
        if self.bits:
            bit = i.astype(np.uint64) * np.uint64(self.bits)
            w, s = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            low = self.low[w] >> s
            low |= np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
            value = (value << self.bits) | (low & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return value


class Trie:
    """Counts of the words after contexts; names of contexts have 63 bits, of words 64."""

    _LEVELS = ("contexts", "pointers", "nexts", "totals")

    def __init__(self, arrays: dict[str, np.ndarray], meta: dict):
        self.arrays, self.meta = arrays, meta
        whole = lambda name: (ef := EliasFano(*meta[name], *(arrays[f"{name}.{k}"] for k in ("low", "high", "before"))))[np.arange(ef.n)]
        self.contexts, self.pointers, self.nexts, self.totals = map(whole, self._LEVELS)  # of one shard, for all its questions
        size = np.diff(self.pointers)
        self.base = np.append(0, self.nexts[self.pointers[1:] - 1] + 1)[: len(size)]

    @classmethod
    def of(cls, context: np.ndarray, word: np.ndarray, n: np.ndarray) -> Trie:
        """From grams in any order; those that repeat are added up."""
        words, number = np.unique(word, return_inverse=True)
        order = np.lexsort((number, context))
        context, number, n = context[order], number[order], n[order]
        new = np.append(True, (context[1:] != context[:-1]) | (number[1:] != number[:-1]))
        n = np.add.reduceat(n, np.flatnonzero(new))
        context, number = context[new], number[new]
        starts = np.append(np.flatnonzero(np.append(True, context[1:] != context[:-1])), len(context))
        arrays, meta = {"words": words}, {}
        levels = (context[starts[:-1]], starts, cls._monotone(number, starts), np.append(0, np.cumsum(n)))
        for name, values in zip(cls._LEVELS, levels, strict=True):
            ef = EliasFano.of(values)
            meta[name] = [ef.n, ef.bits]
            arrays |= {f"{name}.low": ef.low, f"{name}.high": ef.high, f"{name}.before": ef.before}
        return cls(arrays, meta)

    @staticmethod
    def _monotone(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each context's values plus the last value of the contexts before it, and that sum's end for the next one."""
        size = np.diff(starts)
        last = np.zeros(len(size), np.int64)
        full = size > 0
        last[full] = values[starts[1:][full] - 1] + 1
        return values + np.repeat(np.append(0, np.cumsum(last))[:-1], size)

    def to_bytes(self) -> bytes:
        head, at, parts = {"meta": self.meta, "arrays": {}}, 0, []
        for name, a in self.arrays.items():
            raw = np.ascontiguousarray(a).tobytes()
            raw += b"\0" * (-len(raw) % 8)
            head["arrays"][name] = [at, len(a), a.dtype.str]
            parts.append(raw)
            at += len(raw)
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(parts)

    @classmethod
    def from_buffer(cls, buffer) -> Trie:
        """Views into ``buffer`` (bytes, or a memory-mapped file); nothing is copied."""
        size = int.from_bytes(bytes(buffer[:8]), "little")
        head = json.loads(bytes(buffer[8 : 8 + size]))
        arrays = {k: np.frombuffer(buffer, np.dtype(t), n, 8 + size + at) for k, (at, n, t) in head["arrays"].items()}
        return cls(arrays, head["meta"])

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each gram: its count, the count of all words after its context, and how many different words these are."""
        place = np.minimum(np.searchsorted(self.contexts, context.astype(np.int64)), len(self.contexts) - 1)
        seen = self.contexts[place] == context.astype(np.int64)
        low, high = self.pointers[place], self.pointers[place + 1]
        words = self.arrays["words"]
        number = np.minimum(np.searchsorted(words, word), len(words) - 1)
        target = self.base[place] + number
        at = np.minimum(np.searchsorted(self.nexts, target), len(self.nexts) - 1)
        hit = seen & (words[number] == word) & (self.nexts[at] == target) & (at < high) & (at >= low)
        return np.where(hit, self.totals[at + 1] - self.totals[at], 0), np.where(seen, self.totals[high] - self.totals[low], 0), np.where(seen, high - low, 0)

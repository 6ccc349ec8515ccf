"""Word shingles and SetSketch registers, for whole batches of texts at once.

A register holds 1 - floor of the logarithm, to base ``b``, of the smallest exponential variate of the set's elements, cut off at 0 and
q + 1: exponentially spaced, truncated minima. The register-wise maximum of two sketches is the sketch of the union. With a base near 1
two registers agree with a probability near the Jaccard similarity, so runs of registers can be banded, and the counts of greater,
equal and smaller registers give a likelihood for the similarity.

Each element is the seed of a Poisson process whose points fall on random registers, so the points beyond the largest register's minimum need
not be drawn: the work per set is about m log m, plus one point for each element, not m for each.
"""

from __future__ import annotations

import hashlib

import numpy as np

from netquill.llm.common import LOWER_ASCII, mix64, prefix_hashes, random_words, span_hashes, word_spans

SHINGLE_WORDS = 5
REGISTERS = 320
BASE = 1.001
RATE = 20.0
LIMIT = 65534  # q: registers are 0 to q + 1, two bytes
BANDS_MOST = 64

_PLACE = random_words(31, 64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other and sorted within a text, and the places where texts begin.

    A-Z is lower-cased. A text of fewer words than ``size`` has its whole word sequence as its one shingle, one without words none.
    """
    n = len(offsets) - 1
    low = LOWER_ASCII[data]
    start, end, text = word_spans(low, offsets)
    words = span_hashes(prefix_hashes(low), start, end)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    out, sizes = [], np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        full = max(len(words) - size + 1, 0)
        rolled = np.zeros(full, np.uint64)
        for j in range(size):
            rolled += words[j : j + full] * _PLACE[j]
        rolled = mix64(rolled)
        for i in range(n):
            a, k = first[i], count[i]
            if k >= size:
                u = np.sort(rolled[a : a + k - size + 1])
                if len(u) > 1:
                    u = u[np.append(True, u[1:] != u[:-1])]
            elif k:
                u = mix64((words[a : a + k] * _PLACE[:k]).sum(keepdims=True) + np.uint64(int(k)))
            else:
                continue
            out.append(u)
            sizes[i] = len(u)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.append(0, np.cumsum(sizes))


def _minima(elements: np.ndarray, owner: np.ndarray, sets: int, reach: np.ndarray, m: int) -> np.ndarray:
    """Smallest point of each register of each set among the points below the set's ``reach``; infinity where there is none."""
    out = np.full(sets * m, np.inf)
    seed, own, at = elements.copy(), owner, np.zeros(len(elements))
    with np.errstate(over="ignore"):
        while len(seed):
            seed = mix64(seed + np.uint64(0x9E3779B97F4A7C15))
            at = at - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / m
            keep = np.flatnonzero(at <= reach[own])
            seed, own, at = seed[keep], own[keep], at[keep]
            register = (mix64(seed ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.int64) * m >> 32
            np.minimum.at(out, own * m + register, at)
    return out.reshape(sets, m)


def sketches(elements: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (sets x m, two bytes) of the sets elements[at[i]:at[i+1]]; all 0 for an empty set."""
    sizes = np.diff(at)
    sets = len(sizes)
    owner = np.repeat(np.arange(sets), sizes)
    reach = (np.log(m) + 4) / np.maximum(sizes, 1)
    low = _minima(elements, owner, sets, reach, m)
    while True:
        short = np.flatnonzero(np.isinf(low).any(axis=1) & (sizes > 0))
        if not len(short):
            break
        reach[short] *= 2
        some = np.isin(owner, short)
        low[short] = _minima(elements[some], np.searchsorted(short, owner[some]), len(short), reach[short], m)
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(low / RATE) / np.log(BASE))
    k[sizes == 0] = 0
    return np.clip(k, 0, LIMIT + 1).astype(np.uint16)


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of (sorted) elements."""
    raw = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def band_hashes(registers: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each run of ``rows`` registers (sets x bands); its last six bits are the band's number."""
    sets, m = registers.shape
    if m // rows > BANDS_MOST:
        raise ValueError(f"at most {BANDS_MOST} bands")
    parts = registers[:, : m // rows * rows].reshape(sets, m // rows, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (parts * _PLACE[:rows]).sum(axis=2)
        band = np.arange(m // rows, dtype=np.uint64)
        hashes = mix64(mixed + mix64(band + np.uint64(1))[None])
        return (hashes & ~np.uint64(BANDS_MOST - 1) | band[None]).view(np.int64)


def rows_for(similarity: float, most_missed: float = 5e-6, m: int = REGISTERS) -> int:
    """The most registers a band may have so that two sets of ``similarity`` meet in no band with a probability of ``most_missed`` at most:
    fewer bands, and fewer chance meetings, than any shorter one."""
    fit = [r for r in range(1, m + 1) if m // r <= BANDS_MOST and (1 - similarity**r) ** (m // r) <= most_missed]
    if not fit:
        raise ValueError(f"no band of {m} registers finds a similarity of {similarity}")
    return max(fit)


def first_common_band(a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Number of the first band in which both sketches of a pair agree; 0 if there is none."""
    return (a == b)[:, : a.shape[1] // rows * rows].reshape(len(a), -1, rows).all(axis=2).argmax(axis=1)


def similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (pairs x m) with known set sizes.

    With x = share of the set that is only in one of them, a register of it is the greater one with probability
    -log_b(1 - x (b - 1) / b); the likelihood of the three counts is concave in the similarity, its maximum is found by halving.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def slope(j: np.ndarray) -> np.ndarray:
        step = 1e-7
        p, q = chance(np.maximum(u - v * j, 1e-12)), chance(np.maximum(v - u * j, 1e-12))
        p2, q2 = chance(np.maximum(u - v * (j + step), 1e-12)), chance(np.maximum(v - u * (j + step), 1e-12))
        value = lambda p, q: more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))
        return value(p2, q2) - value(p, q)

    for _ in range(30):
        mid = (low + high) / 2
        up = slope(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return (low + high) / 2

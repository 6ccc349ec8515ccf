"""Totals over sliding windows, from rows sorted by key, slot and time: numpy over Arrow batches, one stream per task.

The rows of a key are cut into time slots, and each slot also gets copies of the rows that its windows reach back to, so a slot
is answered by itself. A stream keeps only the rows of the group at hand that windows still reach; everything else is let go.

A window ``[t-h, t]`` is a difference of prefix sums between its first row and the last row of the instant ``t``. A distinct count is
one too: a value enters when its predecessor is more than ``h`` away and leaves when its successor is. All sums are whole numbers;
squares are kept in limbs and leave as 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows handled at once; more while the windows reach back to more.
CHUNK_ROWS = 1 << 16
#: Kinds of rows.
FLOW, NAME, ODD = 0, 1, 2
GAP_UNIT = float(2**32)  # gaps are summed as exact multiples of 2^-32 s
_DECIMAL_TOP = 10**38 >> 64


def _array(table: pa.Table, name: str) -> pa.Array:
    return table.column(name).chunk(0)


def _values(table: pa.Table, name: str) -> np.ndarray:
    column = _array(table, name)
    return (column.fill_null(0) if column.null_count else column).to_numpy(zero_copy_only=False)


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """A number for each value, nulls too, and how many numbers there may be."""
    found = column.dictionary_encode()
    return found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary) + 1


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; NaN equals NaN."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= (c[1:] != c[:-1]) & ~((c[1:] != c[1:]) & (c[:-1] != c[:-1]))
    return out


def _groups(table: pa.Table, key: str) -> np.ndarray:
    return np.cumsum(_begins(_codes(_array(table, key))[0], _values(table, "slot"))) - 1


def chunks(batches: Iterator[pa.RecordBatch], key: str, horizon: float) -> Iterator[tuple[pa.Table, np.ndarray, int, int]]:
    """``(rows, group, first, end)``: the windows of the rows from ``first`` to ``end`` can be answered from the rows before ``end``."""
    held, first, waiting, size = None, 0, [], 0

    def joined() -> pa.Table:
        parts = ([] if held is None else [held]) + ([pa.Table.from_batches(waiting)] if waiting else [])
        return pa.concat_tables(parts).combine_chunks()

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append(b)
        size += b.num_rows
        if size < max(CHUNK_ROWS, 0 if held is None else held.num_rows):
            continue
        table = joined()
        group, ts = _groups(table, key), _values(table, "ts")
        end = int(np.flatnonzero(_begins(group, ts))[-1])  # rows of the last instant may still come
        if end > first:
            yield table, group, first, end
        start = int(np.searchsorted(group, group[-1]))
        start = min(end, start + int(np.searchsorted(ts[start:], ts[-1] - horizon)))
        held, first, waiting, size = table.slice(start), max(first, end) - start, [], 0
    if held is not None or waiting:
        table = joined()
        if table.num_rows > first:
            yield table, _groups(table, key), first, table.num_rows


class _Windows:
    """Windows of rows sorted by group, time and tie."""

    def __init__(self, group: np.ndarray, ts: np.ndarray, tie: np.ndarray):
        self.group, self.ts = group, ts
        self.at = np.empty(len(ts), np.complex128)  # ordered by its real, then its imaginary part
        self.at.real, self.at.imag = group, ts
        begins = _begins(group, ts, tie)
        self.last = np.append(begins[1:], True)[: len(ts)]
        self.end = np.append(np.flatnonzero(begins)[1:], len(ts))[np.cumsum(begins) - 1] if len(ts) else np.zeros(0, np.int64)
        self.starts: dict[float, np.ndarray] = {}

    def start(self, h: float) -> np.ndarray:
        if h not in self.starts:
            edge = np.empty(len(self.ts), np.complex128)
            edge.real, edge.imag = self.group, self.ts - h
            self.starts[h] = np.searchsorted(self.at, edge)
        return self.starts[h]

    def total(self, values: np.ndarray, h: float) -> np.ndarray:
        upto = _prefix(values)
        return upto[self.end] - upto[self.start(h)]

    def distinct(self, rows: np.ndarray, codes: np.ndarray, size: int, h: float) -> np.ndarray:
        """Distinct values among ``rows`` (places), whose values are ``codes``."""
        key = self.group[rows] * size + codes
        order = np.argsort(key, kind="stable")
        key, place = key[order], rows[order]
        ts, same = self.ts[place], key[1:] == key[:-1]
        opens, closes = np.ones(len(key), bool), np.ones(len(key), bool)
        opens[1:] = ~(same & (ts[:-1] >= ts[1:] - h))
        closes[:-1] = ~(same & (ts[:-1] >= ts[1:] - h))
        enters, leaves = np.zeros(len(self.ts), np.int64), np.zeros(len(self.ts), np.int64)
        enters[place], leaves[place] = opens, closes
        return _prefix(enters)[self.end] - _prefix(leaves)[self.start(h)]


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=out[1:])
    return out


def _decimals(parts: list[tuple[np.ndarray, int]]) -> pa.Array:
    """Sums of ``values << shift`` as 38-digit decimals; null beyond them."""
    n = len(parts[0][0])
    low, high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for values, shift in parts:
        v = values.astype(np.uint64)
        if shift >= 64:
            high += v << np.uint64(shift - 64)
            continue
        more = v << np.uint64(shift)
        low = low + more
        high += (low < more).astype(np.uint64) + (v >> np.uint64(64 - shift) if shift else np.uint64(0))
    words = np.ascontiguousarray(np.stack([low, high], 1)).astype("<u8")
    out = pa.Array.from_buffers(pa.decimal128(38, 0), n, [None, pa.py_buffer(words.tobytes())])
    fits = high < np.uint64(_DECIMAL_TOP)
    return out if fits.all() else pa.array([x if ok else None for x, ok in zip(out.to_pylist(), fits)], pa.decimal128(38, 0))


def _limbs(column: pa.Array) -> list[np.ndarray]:
    """Decimals that aren't negative, in four parts of 32 bits."""
    words = np.frombuffer(column.buffers()[1], "<u8").reshape(-1, 2)[column.offset : column.offset + len(column)].copy()
    if column.null_count:
        words[column.is_null().to_numpy(zero_copy_only=False)] = 0
    low = np.uint64(0xFFFFFFFF)
    return [words[:, 0] & low, words[:, 0] >> np.uint64(32), words[:, 1] & low, words[:, 1] >> np.uint64(32)]


def _tie(table: pa.Table) -> np.ndarray:
    return _values(table, "tie") if "tie" in table.column_names else np.zeros(table.num_rows, np.int64)


def _given(table: pa.Table, keep: list[str], rows: np.ndarray, found: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    kept = table.select(keep).take(pa.array(rows)).combine_chunks()
    columns = {n: kept.column(n).combine_chunks() for n in keep}
    columns |= {n: v if isinstance(v, pa.Array) else pa.array(v) for n, v in found.items()}
    return pa.record_batch(list(columns.values()), list(columns))


def destination_totals(table: pa.Table, group: np.ndarray, first: int, end: int, measures: list[str], keep: list[str], every: bool) -> pa.RecordBatch:
    """The rows of their own slot (``every``; else one for each instant) with the totals of their destination."""
    table, group = table.slice(0, end).combine_chunks(), group[:end]
    w = _Windows(group, _values(table, "ts"), _tie(table))
    value = lambda n: _values(table, n)
    totals = {
        "n10": lambda: w.total(value("n"), 10.0), "n60": lambda: w.total(value("n"), 60.0), "s0": lambda: w.total(value("s0"), 10.0),
        "bytes": lambda: w.total(value("tb"), 60.0),
        "sources": lambda: w.distinct(np.arange(end), *_codes(_array(table, "src_ip")), 60.0),
    }
    answered = value("own").astype(bool) & (np.arange(end) >= first)
    rows = np.flatnonzero(answered if every else answered & w.last)
    return _given(table, keep, rows, {f"d_{m}": totals[m]()[rows] for m in measures})


def source_totals(table: pa.Table, group: np.ndarray, first: int, end: int, source: list[str], pair: list[str], keep: list[str]) -> pa.RecordBatch:
    """One row for each instant of a source, or of a pair if ``pair`` asks for its totals or ``keep`` for the destination."""
    table, group = table.slice(0, end).combine_chunks(), group[:end]
    ts, tie, kind = _values(table, "ts"), _tie(table), _values(table, "kind")
    w = _Windows(group, ts, tie)
    value = lambda n: _values(table, n)
    of = lambda n, k: np.where(kind == k, value(n), 0)
    flows, named = np.flatnonzero(kind == FLOW), np.flatnonzero(kind == NAME)

    def other(rows: np.ndarray) -> tuple[np.ndarray, int]:
        return _codes(_array(table, "other").take(pa.array(rows)))

    def names() -> np.ndarray:
        known = _array(table, "other").take(pa.array(named)).fill_null("")
        rows = named[np.asarray(known.to_numpy(zero_copy_only=False) != "", bool)]
        return w.distinct(rows, *other(rows), 60.0)

    totals = {
        "n10": lambda: w.total(of("n", FLOW), 10.0), "n60": lambda: w.total(of("n", FLOW), 60.0),
        "failed": lambda: w.total(of("odd", FLOW), 60.0), "s0": lambda: w.total(value("s0"), 60.0),
        "ob60": lambda: w.total(value("ob"), 60.0), "ob300": lambda: w.total(value("ob"), 300.0),
        "ips": lambda: w.distinct(flows, *other(flows), 60.0),
        "ports": lambda: w.distinct(flows, *_codes(_array(table, "dst_port").take(pa.array(flows))), 60.0),
        "queries": lambda: w.total(of("n", NAME), 60.0), "nx": lambda: w.total(of("odd", NAME), 60.0), "domains": names,
        "weird": lambda: w.total(of("n", ODD), 60.0),
    }
    if "other" in keep:
        codes, size = other(flows)
        code = group[flows] * size + codes
        order = np.argsort(code, kind="stable")
        rows, code = flows[order], code[order]
        p = _Windows(np.cumsum(_begins(code)) - 1, ts[rows], tie[rows])
    else:
        rows, p = flows, _Windows(group[flows], ts[flows], tie[flows])
    answered = p.last & value("own").astype(bool)[rows] & (rows >= first)
    found: dict[str, np.ndarray | pa.Array] = {f"s_{m}": totals[m]()[rows[answered]] for m in source}
    if pair:
        begin, stop = p.start(300.0)[answered], p.end[answered]

        def within(values: np.ndarray, after: int = 0) -> np.ndarray:
            """``after`` leaves out what lies between the first row of a window and the one before it."""
            upto = _prefix(values)
            return upto[stop] - upto[begin + after]

        gap = np.zeros(len(rows), np.int64)
        near = (p.group[1:] == p.group[:-1]) & (p.ts[:-1] >= p.ts[1:] - 300.0)
        gap[1:] = np.where(near, (p.ts[1:] - p.ts[:-1]) * GAP_UNIT, 0.0).astype(np.int64)
        high, low = gap >> 21, gap & ((1 << 21) - 1)
        totals = {
            "n": lambda: within(value("n")[rows]), "ob": lambda: within(value("ob")[rows]), "gap": lambda: within(gap, 1),
            "gap_sq": lambda: _decimals([(within(high * high, 1), 42), (within(high * low, 1), 22), (within(low * low, 1), 0)]),
            "ob_sq": lambda: _decimals([(within(x), 32 * i) for i, x in enumerate(_limbs(_array(table, "ob_sq").take(pa.array(rows))))]),
        }
        found |= {f"p_{m}": totals[m]() for m in pair}
    return _given(table, keep, rows[answered], found)

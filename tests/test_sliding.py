"""Sliding totals: streams cut anywhere give the same totals, and windows need little disk."""

import os
import random

import pyarrow as pa
import pytest

from helpers import flow, flows_df
from netquill.operators import sliding as SL
from netquill.operators.windows import window_features
from netquill.sources.stage import staged

SOURCE = ["n10", "n60", "failed", "s0", "ob60", "ob300", "ips", "ports", "queries", "nx", "domains", "weird"]
PAIR = ["n", "ob", "gap", "gap_sq", "ob_sq"]
KEYS = ["src_ip", "other", "ts"]


def sorted_rows(seed):
    rng = random.Random(seed)
    rows = []
    for src in (None, "a", "b"):
        for slot in (0, 1):
            own = sorted(rng.randint(0, 2400) / 4 + 600 * slot for _ in range(rng.choice([3, 150])))
            for ts in own:
                kind = rng.choice([0, 0, 0, 1, 2])
                name = rng.choice([["x", "y", None], ["q", "", None, "r"], [None]][kind])
                ob = rng.choice([0, 5, 2**62]) if kind == 0 else None
                rows.append({"src_ip": src, "slot": slot, "ts": ts, "other": name, "kind": kind, "dst_port": rng.choice([1, 2, None]), "n": rng.randint(1, 3),
                             "odd": 1, "s0": 1 if kind == 0 else None, "ob": ob, "ob_sq": None if ob is None else ob * ob, "own": ts >= 600 * slot + 100})
    types = {"src_ip": pa.string(), "slot": pa.int64(), "ts": pa.float64(), "other": pa.string(), "kind": pa.int32(), "dst_port": pa.int64(), "n": pa.int64(),
             "odd": pa.int64(), "s0": pa.int64(), "ob": pa.int64(), "ob_sq": pa.decimal128(38, 0), "own": pa.bool_()}
    return pa.Table.from_pylist(rows, schema=pa.schema(types.items()))


def answered(batches):
    out = []
    for table, group, first, end in SL.chunks(iter(batches), "src_ip", 301.0):
        out += SL.source_totals(table, group, first, end, SOURCE, PAIR, KEYS).to_pylist()
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,size", [(1, 1), (2, 7), (3, 40)])
def test_streams_may_be_cut_anywhere(monkeypatch, seed, size):
    table = sorted_rows(seed)
    whole = answered(table.to_batches())
    monkeypatch.setattr(SL, "CHUNK_ROWS", 1)
    assert answered(table.to_batches(max_chunksize=size)) == whole
    kept = {(r["src_ip"], r["other"], r["ts"]) for r in table.to_pylist() if r["own"] and r["kind"] == 0}
    assert {tuple(r[k] for k in KEYS) for r in whole} == kept and len(whole) == len(kept)


def test_squares_beyond_64_bits():
    parts = [SL._limbs(pa.array([2**126, None, 0, 10**37 + 1], pa.decimal128(38, 0)))]
    assert SL._decimals([(x, 32 * i) for i, x in enumerate(parts[0])]).to_pylist() == [2**126, 0, 0, 10**37 + 1]
    assert SL._decimals([(x, 32 * i + 1) for i, x in enumerate(parts[0])]).to_pylist()[0] is None  # 39 digits


def test_flows_without_an_address(spark):
    """What is known of the other side is still answered."""
    rows = [flow(0, "A", None, "d"), flow(1, "B", "s", "d"), flow(2, "C", "s", None), flow(3, "D", "s", "d"), flow(4, "E", None, None)]
    got = {r["uid"]: r.asDict() for r in window_features(flows_df(spark, rows)).collect()}
    known = {u: (r["win_src_flow_count_60s"], r["win_dst_unique_sources_60s"], r["win_pair_flow_count_300s"]) for u, r in got.items()}
    assert known == {"A": (None, 1, None), "B": (1, 2, 1), "C": (2, None, None), "D": (3, 2, 2), "E": (None, None, None)}


def test_windows_need_little_disk(spark, tmp_path):
    """Every flow used to become up to sixteen movements that were shuffled and written twice: over 1500 bytes a flow."""
    rng = random.Random(7)
    n = 20_000
    rows = [flow(rng.uniform(0, 1800), f"C{i}", f"10.0.{rng.randint(0, 5)}.{rng.randint(0, 250)}", f"9.9.9.{rng.randint(1, 100)}", 80, "SF", rng.randint(0, 5000)) for i in range(n)]
    table = staged(flows_df(spark, rows))
    written = []

    def stage(df, by=()):
        path = str(tmp_path / f"stage-{len(written)}")
        df.write.parquet(path)
        written.append(sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)))
        return spark.read.parquet(path)

    assert window_features(table, stage=stage).count() == n
    assert sum(written) < 100 * n

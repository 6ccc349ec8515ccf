"""Window features against hand-computed goldens and a brute-force restatement."""

import random

import pytest

from helpers import brute_windows, flow, flows_df
from netquill.contract import WINDOW_FEATURES
from netquill.operators.windows import window_features

DNS = "ts double, src_ip string, query string, rcode_name string"


def compute(spark, rows, dns=(), weird=(), **kw):
    d = spark.createDataFrame(list(dns), DNS)
    w = spark.createDataFrame(list(weird), "ts double, src_ip string")
    out = window_features(flows_df(spark, rows), d, w, **kw)
    return {r["uid"]: r.asDict() for r in out.collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for uid, features in want.items():
        for name in WINDOW_FEATURES:
            assert got[uid][name] == pytest.approx(features[name], abs=1e-9), (uid, name)


def test_scan_golden(spark):
    src = "192.168.1.100"
    rows = [flow(100, "U1", src, "10.0.0.1", 80, "SF", 100, 300), flow(110, "U2", src, "10.0.0.1", 80, "SF", 100, 300),
            flow(120, "U3", src, "10.0.0.2", 443, "S0"), flow(130, "U4", src, "10.0.0.3", 8080, "REJ")]
    u4 = compute(spark, rows)["U4"]
    assert [u4[k] for k in ("win_src_flow_count_60s", "win_src_unique_dst_ips_60s", "win_src_unique_dst_ports_60s",
                            "win_src_failed_conn_ratio_60s", "win_src_s0_syn_ratio_60s", "win_src_flow_rate_10s",
                            "win_src_total_orig_bytes_300s")] == [4, 3, 3, 0.5, 0.25, 0.2, 200]


def test_beacon_golden(spark):
    rows = [flow(t, f"B{t}", "192.168.1.50", "45.33.32.156", 443, ob=128) for t in (100, 130, 160)]
    last = compute(spark, rows)["B160"]
    assert [last[k] for k in ("win_pair_flow_count_300s", "win_pair_delta_t_mean", "win_pair_delta_t_std", "win_pair_delta_t_cv",
                              "win_pair_orig_bytes_std")] == [3, 30, 0, 0, 0]


def random_input(seed, n=160, hot=0.4, grid=4):
    """Ties, copies, exact window edges and one source holding a large share of all rows."""
    rng = random.Random(seed)
    rows, dns, weird = [], [], []
    for i in range(n):
        src = "10.0.0.1" if rng.random() < hot else f"10.0.0.{rng.randint(2, 5)}"
        ts = rng.randint(0, 700 * grid) / grid + (1e6 if seed % 2 else 0)
        rows.append(flow(ts, f"C{i}", src, f"9.9.9.{rng.randint(1, 4)}", rng.choice([53, 80, 443, 60000]),
                         rng.choice(["SF", "S0", "REJ", ""]), rng.randint(0, 5000), None))
        if rng.random() < 0.4:
            dns.append((ts + rng.choice([0.0, -60.0, -60.25]), src, rng.choice(["a.b", "c.d", "", "e.f"]), rng.choice(["NOERROR", "NXDOMAIN"])))
        if rng.random() < 0.2:
            weird.append((ts, src))
    rows += [flow(rows[0][0], f"D{i}", rows[0][2], rows[0][4], rows[0][5], "S0", 77) for i in range(30)]  # copies
    return rows, dns, weird


@pytest.mark.parametrize("seed,slot", [(1, 60.0), (2, 7.0), (3, 1000.0)])
def test_brute_force_and_slot_width(spark, seed, slot):
    rows, dns, weird = random_input(seed)
    random.Random(seed).shuffle(rows)
    assert_same(compute(spark, rows, dns, weird, slot_seconds=slot), brute_windows(rows, dns, weird))


def test_arrival_order(spark):
    rows, dns, weird = random_input(8, 60, grid=1)
    rows.sort(key=lambda r: r[0])
    numbered = flows_df(spark, rows).toPandas()
    numbered["n"] = range(len(numbered))
    frame = spark.createDataFrame(numbered)
    d = spark.createDataFrame(dns, DNS)
    w = spark.createDataFrame(weird, "ts double, src_ip string")
    got = {r["uid"]: r.asDict() for r in window_features(frame, d, w, arrival="n").collect()}
    assert_same(got, brute_windows(rows, dns, weird, arrival=True))


def test_no_leftover_from_large_values(spark):
    """Constant large byte counts give a spread of exactly zero."""
    rows = [flow(1000 + i, f"L{i}", "10.0.0.1", "9.9.9.9", ob=10 ** 12 + 7) for i in range(50)]
    assert {r["win_pair_orig_bytes_std"] for r in compute(spark, rows).values()} == {0.0}


def test_rounded_window_edge(spark):
    """``ts + h`` may round; membership is decided by ``t - h`` alone."""
    rows = [flow(t, f"E{i}", "10.0.0.1", "9.9.9.9") for i, t in enumerate((4.1, 70.1, 130.1, 64.1, 64.05, 124.05))]
    assert_same(compute(spark, rows), brute_windows(rows))

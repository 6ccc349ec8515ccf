"""Small literal inputs shared by the tests."""

from __future__ import annotations

import math
import os

FLOW_SCHEMA = (
    "ts double, uid string, src_ip string, src_port long, dst_ip string, dst_port long, protocol string, service string, "
    "duration double, orig_bytes long, resp_bytes long, total_bytes long, orig_packets long, resp_packets long, "
    "total_packets long, bytes_per_packet double, missed_bytes long, conn_state string, history string"
)


def flow(ts, uid, src, dst, dport=80, state="SF", ob=0, tb=None, sport=50000):
    tb = ob if tb is None else tb
    return (float(ts), uid, src, sport, dst, dport, "tcp", "", 0.0, ob, tb - ob, tb, 1, 1, 2, 0.0, 0, state, "")


def flows_df(spark, rows):
    return spark.createDataFrame(rows, FLOW_SCHEMA)


def py_round(x, n=4):
    return round(x, n)


def brute_windows(rows, dns=(), weird=(), arrival=False):
    """The window definitions, one flow at a time. Rows are ``flow`` tuples."""
    names = [c.split()[0] for c in FLOW_SCHEMA.split(", ")]
    recs = [dict(zip(names, r)) for r in rows]
    out = {}
    for i, f in enumerate(recs):
        t = f["ts"]

        def back(h, keys, i=i, f=f, t=t):
            return [
                g for j, g in enumerate(recs)
                if all(g[k] == f[k] for k in keys) and t - h <= g["ts"] <= t
                and (not arrival or g["ts"] < t or j <= i)
            ]

        s10, s60, s300 = (back(h, ["src_ip"]) for h in (10.0, 60.0, 300.0))
        d10, d60 = (back(h, ["dst_ip"]) for h in (10.0, 60.0))
        pair = sorted(back(300.0, ["src_ip", "dst_ip"]), key=lambda g: g["ts"])
        q = [x for x in dns if x[1] == f["src_ip"] and t - 60.0 <= x[0] <= t]
        w = [x for x in weird if x[1] == f["src_ip"] and t - 60.0 <= x[0] <= t]
        gaps = [b["ts"] - a["ts"] for a, b in zip(pair, pair[1:])]
        std = lambda v: math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) if len(v) > 1 else 0.0
        mean = sum(gaps) / len(gaps) if gaps else 0.0
        out[f["uid"]] = {
            "win_src_flow_count_60s": len(s60),
            "win_src_flow_rate_10s": py_round(len(s10) / 10),
            "win_src_unique_dst_ips_60s": len({g["dst_ip"] for g in s60}),
            "win_src_unique_dst_ports_60s": len({g["dst_port"] for g in s60}),
            "win_src_failed_conn_ratio_60s": py_round(sum(g["conn_state"] != "SF" for g in s60) / len(s60)),
            "win_src_s0_syn_ratio_60s": py_round(sum(g["conn_state"] == "S0" for g in s60) / len(s60)),
            "win_src_total_orig_bytes_300s": sum(g["orig_bytes"] for g in s300),
            "win_src_outbound_byte_rate_60s": py_round(sum(g["orig_bytes"] for g in s60) / 60),
            "win_src_dns_query_count_60s": len(q),
            "win_src_dns_nxdomain_ratio_60s": py_round(sum(x[3] == "NXDOMAIN" for x in q) / len(q)) if q else 0.0,
            "win_src_dns_unique_domains_60s": len({x[2] for x in q if x[2]}),
            "win_src_weird_count_60s": len(w),
            "win_dst_inbound_flow_rate_10s": py_round(len(d10) / 10),
            "win_dst_unique_sources_60s": len({g["src_ip"] for g in d60}),
            "win_dst_s0_syn_ratio_10s": py_round(sum(g["conn_state"] == "S0" for g in d10) / len(d10)),
            "win_dst_avg_bytes_per_flow_60s": py_round(sum(g["total_bytes"] for g in d60) / len(d60)),
            "win_pair_flow_count_300s": len(pair),
            "win_pair_total_orig_bytes_300s": sum(g["orig_bytes"] for g in pair),
            "win_pair_delta_t_mean": py_round(mean),
            "win_pair_delta_t_std": py_round(std(gaps)),
            "win_pair_delta_t_cv": py_round(min(5.0, std(gaps) / (mean + 1e-6))) if gaps else 1.0,
            "win_pair_orig_bytes_std": py_round(std([float(g["orig_bytes"]) for g in pair])) if gaps else 0.0,
        }
    return out


CONN_HEADER = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration",
               "orig_bytes", "resp_bytes", "conn_state", "missed_bytes", "history", "orig_pkts", "resp_pkts"]
DNS_HEADER = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "query", "qtype_name", "rcode_name", "answers", "rtt"]


def write_log(path, header, rows, separator="\t"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    code = "\\x%02x" % ord(separator)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"#separator {code}\n#set_separator\t,\n#empty_field\t(empty)\n#unset_field\t-\n")
        f.write(separator.join(["#fields", *header]) + "\n")
        f.write(separator.join(["#types", *["string"] * len(header)]) + "\n")
        for r in rows:
            f.write(separator.join(str(x) for x in r) + "\n")
        f.write("#close\t2024-01-01\n")


def conn_row(ts, uid, src="192.168.1.50", dst="93.184.216.34", dport=80, state="SF", ob=180, rb=4500):
    return [ts, uid, src, 51234, dst, dport, "tcp", "http", "0.12", ob, rb, state, 0, "ShADda", 4, 6]

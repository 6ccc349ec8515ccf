import ipaddress
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netquill.functions import scalars as S
from netquill.functions.netaddr import is_private_ip


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("r")).collect()]


def test_numbers_and_placeholders(spark):
    raw = ["-", "(empty)", "", None, " 12 ", "12.9", "-7.5", "1e3", "1d", "abc", ".5", "5.", "inf", "nan", "1e400"]
    assert apply(spark, S.safe_int, raw) == [0, 0, 0, 0, 12, 12, -7, 1000, 0, 0, 0, 5, 0, 0, 0]
    assert apply(spark, S.safe_float, raw)[:12] == [0, 0, 0, 0, 12, 12.9, -7.5, 1000, 0, 0, 0.5, 5]
    assert apply(spark, S.clean_str, ["-", "(empty)", None, " a ", "b"]) == ["", "", "", "a", "b"]


def test_entropy_goldens(spark):
    assert apply(spark, S.shannon_entropy, ["ab", "abcd", "", None, "a", "google.com"]) == [1.0, 2.0, 0.0, 0.0, 0.0, 2.6464]


def test_domain_goldens(spark):
    assert apply(spark, S.dns_vowel_ratio, ["bcdfg.com", "aeiou.com", "", "123"]) == [0.125, 0.75, 0.0, 0.0]
    assert apply(spark, S.dns_numeric_ratio, ["1234.com", ""]) == [0.5714, 0.0]
    assert apply(spark, S.dns_subdomain_depth, ["a.b.c.d.tunnel.com", "com", ".", "", "-", "a..b."]) == [5, 0, 0, 0, 0, 1]
    assert apply(spark, S.dns_max_label_len, ["abcdefghijklmnopqrstuvwxyz.io", ".", ""]) == [26, 0, 0]


def test_answers(spark):
    assert apply(spark, S.split_answers, ["-", None, "a, b,-,", "x"]) == [[], [], ["a", "b"], ["x"]]


def test_rounding_is_half_even(spark):
    assert apply(spark, S.round_half_even, [1 / 32, 3 / 32, 2.5e-5], "double") == [0.0312, 0.0938, 0.0]


def test_nan_is_clamped(spark):
    assert apply(spark, S.clamp0, [math.nan, -1.0, 2.0], "double") == [0.0, 0.0, 2.0]


def test_iso(spark):
    assert apply(spark, S.iso_timestamp, [0.0, 1704067207.25], "double") == [
        "1970-01-01T00:00:00+00:00", "2024-01-01T00:00:07.250000+00:00"]


def test_history_keeps_placeholder_length(spark):
    cols = S.history_flags(F.col("v"))
    assert apply(spark, lambda c: cols["history_len"], ["-", None, "ShADda"]) == [1.0, 0.0, 6.0]


def expected_private(x):
    if not x or x in ("-", "(empty)", "0.0.0.0"):
        return False
    try:
        a = ipaddress.ip_address(x.strip())
    except ValueError:
        return False
    return a.is_private or a.is_loopback or a.is_link_local


FIXED = ["192.168.1.1", "10.0.0.50", "172.31.255.255", "127.0.0.1", "8.8.8.8", "-", "not_an_ip", "0.0.0.0", "", "192.0.0.9",
         "192.0.0.8", "010.0.0.1", "256.1.1.1", "::1", "::", "fe80::1%eth0", "2001:db8::1", "2001:1::1", "2001:4:112::9",
         "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1::2::3", "1:2:3:4:5:6:7:8", "64:ff9b:1::", "FC00::1"]


def test_private_fixed(spark):
    assert apply(spark, is_private_ip, FIXED) == [expected_private(x) for x in FIXED]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.ip_addresses(v=4).map(str), st.ip_addresses(v=6).map(str),
                          st.integers(0, 2 ** 128 - 1).map(lambda n: ipaddress.IPv6Address(n >> 3).exploded)), min_size=50, max_size=200))
def test_private_random(spark, addresses):
    assert apply(spark, is_private_ip, addresses) == [expected_private(x) for x in addresses]


@pytest.mark.parametrize("decision,threat", [("AUTOMATED_DETECTION", True), ("ANALYST_REVIEW", False), ("FALSE_POSITIVE", False)])
def test_is_threat(spark, decision, threat):
    row = spark.range(1).select(S.is_threat(F.lit("DDOS"), F.lit(False), F.lit(decision)).alias("t")).first()
    assert row["t"] is threat

import numpy as np
from pyspark.sql import functions as F

from netquill.operators import quantiles as Q

PROBS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def close(got: float, want: float) -> bool:
    return (np.isnan(got) and np.isnan(want)) or got == want or abs(got - want) < 1e-6 * max(1, abs(want))


def test_exact_per_group(spark):
    rng = np.random.default_rng(3)
    data = {"a": np.round(rng.normal(size=4000), 2), "b": np.full(2500, 7.0), "c": np.array([1.0, 2.0, 3.0, 10.0]), "one": np.array([4.0]),
            "two": np.array([1.0, 2.0]), "tail": np.concatenate([np.zeros(3000), rng.pareto(0.3, 3000)])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in Q.exact_percentiles(df, ["k"], "v", PROBS).collect()}
    assert set(got) == set(data)
    for k, values in data.items():
        assert got[k]["n"] == len(values)
        for name, p in PROBS.items():
            assert close(got[k][name], np.percentile(values, p * 100)), (k, name)
    whole = Q.exact_percentiles(df, [], "v", {"m": 0.5}).first()
    assert abs(whole["m"] - np.median(np.concatenate(list(data.values())))) < 1e-9


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),)], "v double")
    r = Q.exact_percentiles(df, [], "v", {"low": 0.25, "mid": 0.5, "inf": 0.75, "top": 1.0}).first()
    assert (r["n"], r["low"], r["mid"], r["inf"]) == (5, 2.0, 3.0, float("inf")) and np.isnan(r["top"])


def test_a_million_distinct_values_over_many_ranges(spark):
    skewed = F.pow(F.lit(1.00001), F.pmod(F.xxhash64("id"), F.lit(1_000_003)))
    df = spark.range(1_000_000).select(skewed.alias("v"))
    values = np.array(df.toPandas()["v"])
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        r = Q.exact_percentiles(df, [], "v", PROBS).first()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert r["n"] == len(values)
    for name, p in PROBS.items():
        assert close(r[name], np.percentile(values, p * 100)), name

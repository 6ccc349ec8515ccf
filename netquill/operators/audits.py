"""Per-run audit aggregates over the labelled feature table and raw logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.functions.scalars import round_half_even
from netquill.operators import timeline as TL

RUN = "experiment_id"


def run_audit(table: DataFrame) -> DataFrame:
    """Per run: flows, missed bytes, context counts and value ranges."""
    lo_hi = lambda c, n: [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max")]
    return table.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.sum("missed_bytes").alias("total_missed_bytes"),
        F.count_if(F.col("has_ssl_context") == 1).alias("ssl_context_flows"),
        F.count_if(F.col("has_dns_context") == 1).alias("dns_context_flows"),
        *lo_hi("flow_duration", "duration"), *lo_hi("orig_bytes", "orig_bytes"), *lo_hi("resp_bytes", "resp_bytes"),
    )


def run_distribution(table: DataFrame, column: str) -> DataFrame:
    """Per run and value of ``column`` (protocol, connection state, port): flows."""
    return table.groupBy(RUN, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def recon_audit(table: DataFrame) -> DataFrame:
    return table.groupBy(RUN).agg(
        F.count_distinct("destination_port").alias("scanned_ports_count"),
        F.count_if(F.col("is_well_known_dst_port") == 1).alias("well_known"),
        F.count_if(F.col("is_registered_dst_port") == 1).alias("registered"),
        F.count_if(F.col("is_dynamic_dst_port") == 1).alias("dynamic"),
        F.max("win_src_unique_dst_ports_60s").alias("max_unique_dst_ports_60s"),
    )


def dns_audit(table: DataFrame) -> DataFrame:
    """Per run, over flows with DNS context."""
    mean = lambda c, d: round_half_even(F.avg(c), d)
    return table.filter(F.col("has_dns_context") == 1).groupBy(RUN).agg(
        F.count(F.lit(1)).alias("dns_flows_total"),
        mean("dns_query_len", 2).alias("mean_query_len"), F.max("dns_query_len").alias("max_query_len"),
        mean("dns_query_entropy", 4).alias("mean_entropy"), F.max("dns_query_entropy").alias("max_entropy"),
        mean("dns_subdomain_depth", 2).alias("mean_depth"), F.max("dns_subdomain_depth").alias("max_depth"),
        mean("dns_max_label_len", 2).alias("mean_max_label_len"),
        mean("dns_numeric_ratio", 4).alias("mean_numeric_ratio"), mean("dns_vowel_ratio", 4).alias("mean_vowel_ratio"),
        F.count_if(F.col("dns_qtype_is_A") == 1).alias("qtype_a_count"),
        F.count_if(F.col("dns_qtype_is_TXT") == 1).alias("qtype_txt_count"),
        F.count_if(F.col("dns_is_nxdomain") == 1).alias("nxdomain_count"),
    )


def answer_histogram(table: DataFrame) -> DataFrame:
    dns = table.filter(F.col("has_dns_context") == 1)
    return dns.groupBy(RUN, F.col("dns_answer_count").cast("long").alias("answers")).agg(F.count(F.lit(1)).alias("n"))


def tls_audit(table: DataFrame) -> DataFrame:
    """Per run, over flows with TLS context."""
    return table.filter(F.col("has_ssl_context") == 1).groupBy(RUN).agg(
        F.count(F.lit(1)).alias("ssl_flows_total"),
        F.min("ssl_sni_len").alias("sni_len_min"), F.max("ssl_sni_len").alias("sni_len_max"),
        F.min("ssl_sni_entropy").alias("sni_entropy_min"), F.max("ssl_sni_entropy").alias("sni_entropy_max"),
        *[
            F.count_if(F.col(c) == 1).alias(n)
            for c, n in (
                ("ssl_is_outdated_version", "outdated_version_count"), ("ssl_is_self_signed", "self_signed_count"),
                ("ssl_has_ja3_fingerprint", "ja3_count"), ("ssl_resumed_flag", "resumed_count"),
            )
        ],
    )


def slow_http_audit(table: DataFrame) -> DataFrame:
    mean = lambda c, d: round_half_even(F.avg(c), d)
    return table.groupBy(RUN).agg(
        mean("flow_duration", 4).alias("mean_duration_seconds"), mean("orig_bytes", 2).alias("mean_orig_bytes"),
        mean("resp_bytes", 2).alias("mean_resp_bytes"), mean("total_packets", 2).alias("mean_packets_per_flow"),
    )


def interval_stats(flows: DataFrame, keys: list[str], slot_seconds: float = TL.DEFAULT_SLOT_SECONDS) -> DataFrame:
    """Inter-arrival statistics per key with at least two flows.

    Flows at one instant are merged first; the zero gaps between them enter as their count.
    """
    at = flows.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("_rows"))
    gaps = TL.neighbours(at, keys, slot_seconds=slot_seconds).withColumn("_gap", F.col("ts") - F.col("prev_ts"))
    zeros = F.sum(F.col("_rows") - 1)
    links = F.sum("_rows") - 1
    total = F.coalesce(F.sum("_gap"), F.lit(0.0))
    g = gaps.groupBy(*keys).agg(
        F.sum("_rows").alias("count"), links.alias("_links"), zeros.alias("_zeros"), total.alias("_total"),
        F.count("_gap").alias("_m"), F.avg("_gap").alias("_avg"), F.var_pop("_gap").alias("_var"),
        F.min("_gap").alias("_lo"), F.max("_gap").alias("_hi"),
    ).filter(F.col("count") > 1)
    mean = F.col("_total") / F.col("_links")
    # Merge the variance of the non-zero gaps with the zero gaps.
    m, z = F.col("_m"), F.col("_zeros")
    avg, var = F.coalesce("_avg", F.lit(0.0)), F.coalesce("_var", F.lit(0.0))
    pooled = (m * (var + (avg - mean) * (avg - mean)) + z * mean * mean) / F.col("_links")
    std = F.sqrt(F.greatest(F.lit(0.0), pooled))
    r4 = round_half_even
    return g.select(
        *keys, "count",
        r4(mean).alias("mean_interval_seconds"),
        r4(F.when(z > 0, F.lit(0.0)).otherwise(F.col("_lo"))).alias("min_interval_seconds"),
        r4(F.coalesce("_hi", F.lit(0.0))).alias("max_interval_seconds"),
        r4(std).alias("std_interval_seconds"),
        r4(std / (mean + F.lit(1e-6))).alias("cv_interval"),
    )


def weird_events(weird: DataFrame, runs: DataFrame) -> DataFrame:
    """Anomaly names per run with their counts."""
    named = weird.join(runs.select("uid", RUN), "uid")
    return named.groupBy(RUN, F.col("name").alias("event")).agg(F.count(F.lit(1)).alias("n"))


def beacon_signature(table: DataFrame, max_cv: float = 0.30, min_count: int = 15) -> DataFrame:
    """Regular, frequent host pairs: the model-free hunt for beacons."""
    return table.filter(
        (F.col("win_pair_delta_t_cv") < max_cv) & (F.col("win_pair_flow_count_300s") > min_count)
    )

"""Raw connection and DNS rows -> typed rows, and traffic summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.contract import CONN_FIELDS
from netquill.functions import scalars as S


def field(raw: DataFrame, name: str) -> Column:
    """A raw field, from a ``record`` map or from a column of that name; null when absent."""
    if "record" in raw.columns:
        return F.try_element_at("record", F.lit(name))
    if name in raw.columns:
        return F.col(f"`{name}`")
    return F.lit(None).cast("string")


def _leftovers(raw: DataFrame) -> Column:
    if "record" in raw.columns:
        return F.map_filter("record", lambda k, _: ~k.isin(CONN_FIELDS))
    extra = [c for c in raw.columns if c not in CONN_FIELDS]
    pairs = [x for c in extra for x in (F.lit(c), F.col(f"`{c}`"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def normalize_conn(raw: DataFrame) -> DataFrame:
    """Raw ``conn`` rows -> nested flow rows with the unconsumed fields in ``metadata``."""
    get = lambda n: field(raw, n)
    ob, rb = S.safe_int(get("orig_bytes")), S.safe_int(get("resp_bytes"))
    op, rp = S.safe_int(get("orig_pkts")), S.safe_int(get("resp_pkts"))
    return raw.select(
        S.safe_float(get("ts")).alias("timestamp"),
        S.clean_str(get("uid")).alias("uid"),
        F.struct(S.clean_str(get("id.orig_h")).alias("ip"), S.safe_int(get("id.orig_p")).alias("port")).alias("source"),
        F.struct(S.clean_str(get("id.resp_h")).alias("ip"), S.safe_int(get("id.resp_p")).alias("port")).alias("destination"),
        F.struct(S.clean_str(get("proto")).alias("protocol"), S.clean_str(get("service")).alias("service")).alias("network"),
        F.struct(
            S.safe_float(get("duration")).alias("duration"),
            ob.alias("orig_bytes"), rb.alias("resp_bytes"), (ob + rb).alias("total_bytes"),
            op.alias("orig_packets"), rp.alias("resp_packets"), (op + rp).alias("total_packets"),
            S.bytes_per_packet(ob + rb, op + rp).alias("bytes_per_packet"),
            S.safe_int(get("missed_bytes")).alias("missed_bytes"),
        ).alias("metrics"),
        S.clean_str(get("conn_state")).alias("connection_state"),
        _leftovers(raw).alias("metadata"),
    )


def flatten(nested: DataFrame) -> DataFrame:
    """Nested flow rows -> the flat silver layout the other operators read."""
    return nested.select(
        F.col("timestamp").alias("ts"), "uid",
        F.col("source.ip").alias("src_ip"), F.col("source.port").alias("src_port"),
        F.col("destination.ip").alias("dst_ip"), F.col("destination.port").alias("dst_port"),
        F.col("network.protocol").alias("protocol"), F.col("network.service").alias("service"),
        "metrics.*",
        F.col("connection_state").alias("conn_state"),
        F.coalesce(F.try_element_at("metadata", F.lit("history")), F.lit("")).alias("history"),
    )


def connection_features(raw: DataFrame) -> DataFrame:
    """The 18-column flat projection of raw ``conn`` rows."""
    n = normalize_conn(raw)
    m = lambda x: F.col(f"metrics.{x}")
    return n.select(
        "uid", "timestamp",
        F.col("source.ip").alias("source_ip"), F.col("source.port").alias("source_port"),
        F.col("destination.ip").alias("destination_ip"), F.col("destination.port").alias("destination_port"),
        F.col("network.protocol").alias("protocol"), F.col("network.service").alias("service"),
        m("duration").alias("duration"),
        m("orig_bytes").alias("orig_bytes"), m("resp_bytes").alias("resp_bytes"), m("total_bytes").alias("total_bytes"),
        m("orig_packets").alias("orig_pkts"), m("resp_packets").alias("resp_pkts"), m("total_packets").alias("total_packets"),
        m("bytes_per_packet").alias("bytes_per_packet"),
        "connection_state", m("missed_bytes").alias("missed_bytes"),
    )


def dns_projection(raw: DataFrame) -> DataFrame:
    """The 9-column projection of raw ``dns`` rows with parsed answers."""
    get = lambda n: field(raw, n)
    out = raw.select(
        S.clean_str(get("uid")).alias("uid"),
        S.safe_float(get("ts")).alias("timestamp"),
        S.clean_str(get("id.orig_h")).alias("source_ip"),
        S.clean_str(get("id.resp_h")).alias("destination_ip"),
        S.clean_str(get("query")).alias("query"),
        S.clean_str(get("qtype_name")).alias("qtype_name"),
        S.clean_str(get("rcode_name")).alias("rcode_name"),
        S.split_answers(get("answers")).alias("answers"),
    )
    return out.withColumn("answer_count", F.size("answers"))


def typed_aux(raw: DataFrame, kind: str) -> DataFrame:
    """Raw dns / weird / ssl / quic rows -> the typed columns correlation needs."""
    wanted = {
        "dns": ["query", "qtype_name", "rcode_name", "answers", "rtt"],
        "weird": ["name", "notice"],
        "ssl": ["server_name", "version", "validation_status", "subject", "issuer", "ja3", "resumed"],
        "quic": ["server_name", "client_initial_dcid"],
    }[kind]
    get = lambda n: field(raw, n)
    order = F.col("seq") if "seq" in raw.columns else F.lit(0)
    return raw.select(
        S.safe_float(get("ts")).alias("ts"), order.alias("seq"),
        S.strip(F.coalesce(get("uid"), F.lit(""))).alias("uid"),
        S.strip(F.coalesce(get("id.orig_h"), F.lit(""))).alias("src_ip"),
        S.strip(F.coalesce(get("id.resp_h"), F.lit(""))).alias("dst_ip"),
        *[get(n).alias(n) for n in wanted],
    )


def hosts(flows: DataFrame, dns: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty addresses in ``column`` over connections and DNS."""
    return flows.select(column).unionByName(dns.select(column)).filter(F.col(column) != "").distinct()


def traffic_summary(flows: DataFrame, dns: DataFrame) -> DataFrame:
    """One row: connections, queries, distinct hosts over both logs, bytes and packets."""
    both = flows.select("src_ip", "dst_ip", F.lit(1).alias("is_conn"), "total_bytes", "total_packets").unionByName(
        dns.select("src_ip", "dst_ip", F.lit(0).alias("is_conn"), F.lit(0).cast("long").alias("total_bytes"),
                   F.lit(0).cast("long").alias("total_packets"))
    )
    known = lambda c: F.when(F.col(c) != "", F.col(c))
    return both.agg(
        F.sum("is_conn").alias("total_connections"),
        F.sum(1 - F.col("is_conn")).alias("total_dns_queries"),
        F.count_distinct(known("src_ip")).alias("unique_source_ips"),
        F.count_distinct(known("dst_ip")).alias("unique_destination_ips"),
        F.sum("total_bytes").alias("total_bytes_observed"),
        F.sum("total_packets").alias("total_packets_observed"),
    )


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """Frequency of every non-empty value of ``column``."""
    return rows.filter(F.col(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))

"""Per-connection context: join auxiliary logs to flows by uid and derive features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.contract import DNS_FEATURES, QUIC_FEATURES, SSL_FEATURES, WEIRD_FEATURES
from netquill.functions import scalars as S
from netquill.functions.netaddr import is_private_ip


#: Texts that stand for a missing uid.
NO_UID = ("", "-", "(empty)")


def _keyed(aux: DataFrame) -> DataFrame:
    return aux.filter(~F.col("uid").isin(*NO_UID))


def last_per_uid(aux: DataFrame, columns: list[str], name: str, order_by: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row per uid: the struct of ``columns`` of its last row.

    ``max_by`` combines before the shuffle, so a uid with very many rows costs one row.
    """
    order = F.struct(*order_by)
    return _keyed(aux).groupBy("uid").agg(F.max_by(F.struct(*columns), order).alias(name))


def attach_last(flows: DataFrame, aux: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Left join of flows with the last auxiliary row of the same uid (null when none)."""
    return flows.join(last_per_uid(aux, columns, name), "uid", "left")


def weird_by_uid(weird: DataFrame) -> DataFrame:
    """Anomalies per uid as an array of (name, notice, n).

    Equal anomalies are counted, so the array is bounded by the anomaly vocabulary.
    """
    counted = _keyed(weird).groupBy("uid", "name", "notice").agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct("name", "notice", "n")))
    return counted.groupBy("uid").agg(items.alias("weird"))


def flow_feature_columns() -> dict[str, Column]:
    """Features 0-26 over the flat flow columns."""
    c = F.col
    ob, rb, tb = S.clamp0(c("orig_bytes")), S.clamp0(c("resp_bytes")), S.clamp0(c("total_bytes"))
    op, rp, tp = S.clamp0(c("orig_packets")), S.clamp0(c("resp_packets")), S.clamp0(c("total_packets"))
    return {
        "flow_duration": S.clamp0(c("duration")),
        "orig_bytes": ob, "resp_bytes": rb, "total_bytes": tb,
        "orig_packets": op, "resp_packets": rp, "total_packets": tp,
        "bytes_per_packet": c("bytes_per_packet").cast("double"),
        **S.byte_packet_ratios(ob, rb, op, tb, tp),
        "missed_bytes": S.clamp0(c("missed_bytes")),
        **S.port_class(c("dst_port")),
        "is_src_private_ip": S.flag(is_private_ip(c("src_ip"))),
        "is_dst_private_ip": S.flag(is_private_ip(c("dst_ip"))),
        **S.proto_onehot(c("protocol")),
        **S.state_onehot(c("conn_state")),
        **S.history_flags(c("history")),
    }


def _or_zero(context: Column, columns: dict[str, Column]) -> dict[str, Column]:
    """Zero every feature of rows without context."""
    return {n: F.when(context.isNotNull(), v.cast("double")).otherwise(F.lit(0.0)) for n, v in columns.items()}


def dns_feature_columns(rec: Column) -> dict[str, Column]:
    """Features 27-39 over the joined DNS struct."""
    query = S.unplaced(rec["query"])
    qtype = F.upper(F.coalesce(rec["qtype_name"], F.lit("")))
    rcode = F.upper(F.coalesce(rec["rcode_name"], F.lit("")))
    values = [
        F.lit(1.0), F.length(query), S.shannon_entropy(query), S.dns_subdomain_depth(query),
        S.dns_max_label_len(query), S.dns_numeric_ratio(query), S.dns_vowel_ratio(query),
        S.flag(qtype == "A"), S.flag(qtype == "TXT"), S.flag(qtype.isin("NULL", "CNAME", "ANY")),
        S.flag(rcode == "NXDOMAIN"), F.size(S.split_answers(rec["answers"])),
        S.round_half_even(S.clamp0(S.safe_float(rec["rtt"]))),
    ]
    return _or_zero(rec, dict(zip(DNS_FEATURES, values)))


def quic_feature_columns(rec: Column) -> dict[str, Column]:
    """Features 40-43 over the joined QUIC struct."""
    sni, dcid = S.unplaced(rec["server_name"]), S.unplaced(rec["client_initial_dcid"])
    values = [F.lit(1.0), F.length(sni), S.shannon_entropy(sni), F.length(dcid)]
    return _or_zero(rec, dict(zip(QUIC_FEATURES, values)))


def weird_feature_aggregates() -> list[Column]:
    """Features 44-48 as aggregates over the anomalies of one uid."""
    name, notice = F.coalesce("name", F.lit("")), F.coalesce("notice", F.lit(""))
    values = [
        F.lit(1.0), F.count(F.lit(1)),
        F.max(S.flag(name.isin("bad_SYN_ack", "SYN_inside_connection"))),
        F.max(S.flag(name.contains("HTTP"))),
        F.max(S.flag(F.upper(notice) == "T")),
    ]
    return [v.cast("double").alias(n) for n, v in zip(WEIRD_FEATURES, values)]


def weird_features(weird: DataFrame) -> DataFrame:
    return _keyed(weird).groupBy("uid").agg(*weird_feature_aggregates())


def ssl_feature_columns(rec: Column) -> dict[str, Column]:
    """Features 49-55 over the joined TLS struct."""
    get = lambda n: F.coalesce(rec[n], F.lit(""))
    sni, version = S.unplaced(rec["server_name"]), S.strip(get("version"))
    subject, issuer, ja3 = S.strip(get("subject")), S.strip(get("issuer")), S.strip(get("ja3"))
    self_signed = F.lower(get("validation_status")).contains("self signed") | (
        (subject == issuer) & ~subject.isin("", "-")
    )
    # TLS versions counted as outdated.
    outdated = version.isin("SSLv3", "TLSv10", "TLSv11", "TLS 1.0", "TLS 1.1")
    values = [
        F.lit(1.0), F.length(sni), S.shannon_entropy(sni), S.flag(outdated), S.flag(self_signed),
        S.flag(~ja3.isin("", "-", "(empty)")), S.flag(F.upper(get("resumed")) == "T"),
    ]
    return _or_zero(rec, dict(zip(SSL_FEATURES, values)))


# Columns of each auxiliary log that features read.
CONTEXT_COLUMNS = {
    "dns": ["query", "qtype_name", "rcode_name", "answers", "rtt"],
    "quic": ["server_name", "client_initial_dcid"],
    "ssl": ["server_name", "version", "validation_status", "subject", "issuer", "ja3", "resumed"],
}
_CONTEXT_FEATURES = {"dns": dns_feature_columns, "quic": quic_feature_columns, "ssl": ssl_feature_columns}


def context_features(aux: DataFrame, kind: str) -> DataFrame:
    """uid -> the dns / quic / ssl features of its last row.

    The features are computed on the auxiliary side, so the join with flows carries
    finished numbers and the (usually much smaller) log pays for the string work.
    """
    last = last_per_uid(aux, CONTEXT_COLUMNS[kind], "ctx")
    return last.select("uid", *[v.alias(n) for n, v in _CONTEXT_FEATURES[kind](F.col("ctx")).items()])

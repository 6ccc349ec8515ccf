"""The benchmark tables written out as log files, for the text and streaming queries.

Files go to the session's shared checkpoint folder, one new subfolder per call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netquill.operators.policy import ACTIVE_CLASSES
from netquill.sources import bindings as B
from netquill.sources import zeek as Z
from netquill.sources.stage import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def further_logs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The four kinds that no feature reads, bound to tables of their own."""
    c = F.col
    pages, orders = B.table(spark, d, "pages"), B.table(spark, d, "orders")
    customers, events = B.table(spark, d, "customer"), B.table(spark, d, "events")
    uid = lambda prefix, key: F.concat(F.lit(prefix), c(key)).alias("uid")
    return {
        "http": pages.select((c("page_id") * 1.5).alias("ts"), uid("H", "page_id"), F.lit("GET").alias("method"), c("url").alias("uri"), F.length("html").alias("response_body_len")),
        "files": orders.select((c("o_orderkey") * 0.5).alias("ts"), uid("F", "o_orderkey"), F.lit("SHA1").alias("analyzers"), c("o_orderpriority").alias("mime_type")),
        "x509": customers.select((c("c_custkey") * 2.0).alias("ts"), uid("X", "c_custkey"), c("c_name").alias("certificate.subject")),
        "ntp": events.filter(c("event_id") % 3 == 0).select((c("event_id") * 0.25).alias("ts"), uid("N", "event_id"), F.lit(4).alias("version")),
    }


def log_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The bound logs that features read, with log field names."""
    hosts = lambda df: df.withColumnsRenamed({"src_ip": "id.orig_h", "dst_ip": "id.resp_h"})
    return {
        "conn": B.raw_conn(spark, d),
        "dns": hosts(B.dns(spark, d)),
        "weird": hosts(B.weird(spark, d)),
        "ssl": B.ssl(spark, d),
        "quic": B.quic(spark, d),
    }


def write_logs(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("conn", "dns", "weird", "ssl", "quic"), conn_time: Column | None = None) -> str:
    """Write the chosen logs as ``<folder>/<kind>.log/part-*`` and return the folder; ``conn_time`` replaces the flows' ``ts``."""
    folder = scratch(spark, "logs")
    tables = log_tables(spark, d)
    if not set(kinds) <= set(tables):
        tables |= further_logs(spark, d)
    for kind, rows in tables.items():
        if kind in kinds:
            if kind == "conn" and conn_time is not None:
                rows = rows.withColumn("ts", conn_time)
            # The last row of a uid wins, so its rows are written in order.
            Z.write_zeek(rows, f"{folder}/{kind}.log", order=("seq",) if kind != "conn" and "seq" in rows.columns else ())
    return folder


def write_repeated_conn(spark: SparkSession, d: str) -> str:
    """Connection logs in which every tenth uid comes again, five seconds later and in another folder."""
    folder = scratch(spark, "logs")
    rows = B.raw_conn(spark, d)
    Z.write_zeek(rows, f"{folder}/first/conn.log")
    again = rows.filter(event_number("uid") % 10 == 0).withColumn("ts", (F.col("ts").cast("double") + 5).cast("string"))
    Z.write_zeek(again, f"{folder}/second/conn.log")
    return folder


def event_number(uid: str) -> Column:
    return F.substring(uid, 2, 20).cast("long")


def write_spoiled_conn(spark: SparkSession, d: str) -> str:
    """Connection log in which every tenth row has one cell too many, and further files without a header that hold every 25th row again."""
    folder = scratch(spark, "logs")
    rows = B.raw_conn(spark, d)
    spoiled = rows.withColumn("local_orig", F.when(event_number("uid") % 10 == 0, "T\textra").otherwise(F.col("local_orig")))
    Z.write_zeek(spoiled, f"{folder}/conn.log")
    bare = rows.filter(event_number("uid") % 25 == 0).select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`"), F.lit("-")) for c in rows.columns]))
    bare.write.mode("append").text(f"{folder}/conn.log")
    return folder


PRIMES = [3, 5, 7, 11, 13, 17]


def rule_scorer(features: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: class weights from byte and packet counts."""
    seed = F.col("total_bytes").cast("long") + F.col("total_packets").cast("long")
    primes = F.array(*[F.lit(p).cast("long") for p in PRIMES[: len(ACTIVE_CLASSES)]])
    weights = F.transform(primes, lambda p: (F.lit(1) + (seed * p) % 97).cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return features.withColumn("probs", F.transform(weights, lambda x: x / total)).withColumn("processing_time_ms", F.lit(1.0))

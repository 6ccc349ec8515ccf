"""Tab-separated Zeek logs as DataFrames.

Rows keep their place in the file as ``seq = (file, block start, line id)``, taken before
any shuffle, so "last row wins" and "header before row" stay decidable in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquill.contract import LOG_KINDS
from netquill.operators.flows import flatten, normalize_conn, typed_aux
from netquill.sources.stage import shuffles_let_go

RAW_ROW = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("seq", T.StructType([
        T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("line", T.LongType()),
    ])),
    T.StructField("record", T.MapType(T.StringType(), T.StringType())),
])
_META = "#"


def located(lines: DataFrame) -> DataFrame:
    """Text rows plus the file and block they come from; also valid on a stream."""
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def with_place(rows: DataFrame) -> DataFrame:
    """Located rows (a batch read or one micro-batch) plus their line order in ``seq``."""
    return rows.select("value", F.struct("file", "block", F.monotonically_increasing_id().alias("line")).alias("seq"))


def _separator(text: Column) -> Column:
    """``\\x09``-style or literal separator of a ``#separator`` line."""
    token = F.get(F.split(F.trim(text), r"\s+"), F.lit(1))
    code = F.conv(F.regexp_extract(token, r"^\\x([0-9a-fA-F]+)$", 1), 16, 10).try_cast("int")
    return F.when(token.startswith("\\x"), F.coalesce(F.char(code), F.lit("\t"))).otherwise(token)


def headers(placed: DataFrame) -> DataFrame:
    """One row per file: its ``#fields`` declarations and separators, each with its place."""
    meta = placed.filter(F.col("value").startswith("#fields") | F.col("value").startswith("#separator"))
    place = F.struct(F.col("seq.block").alias("block"), F.col("seq.line").alias("line"))
    is_fields = F.col("value").startswith("#fields")
    entry = F.struct(place.alias("at"), F.col("value").alias("text"))
    return meta.groupBy(F.col("seq.file").alias("file")).agg(
        F.array_sort(F.collect_list(F.when(is_fields, entry))).alias("field_lines"),
        F.array_sort(F.collect_list(F.when(~is_fields, entry))).alias("separator_lines"),
    )


#: Files whose headers are broadcast; with more of them the headers are joined like any table, and Spark splits a large file's rows.
HEADER_FILES = 10_000


def _with_headers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the declarations of their file. As long as there are few files, no row is shuffled for it."""
    few = found.limit(HEADER_FILES + 1).collect()
    if len(few) > HEADER_FILES:
        return rows.join(found, "file", "left")
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(few, found.schema)), "file", "left")


def _in_force(entries: Column, place: Column) -> Column:
    """Text of the last declaration standing before ``place``."""
    return F.try_element_at(F.filter(entries, lambda e: e["at"] < place), F.lit(-1))["text"]


def _split(text: Column, separator: Column) -> Column:
    quoted = F.concat(F.lit("\\Q"), separator, F.lit("\\E"))
    return F.when(separator == "\t", F.split(text, "\t")).otherwise(F.split(text, quoted))


def parsed(placed: DataFrame) -> DataFrame:
    """Data rows with ``fields``, ``cells`` and, when they cannot be read, a ``reason``."""
    text = F.regexp_replace("value", "[\\r\\n]+$", "")
    place = F.struct(F.col("seq.block").alias("block"), F.col("seq.line").alias("line"))
    rows = placed.withColumn("value", text).filter((F.col("value") != "") & ~F.col("value").startswith(_META))
    rows = _with_headers(rows.withColumn("file", F.col("seq.file")), headers(placed))
    no_lines = F.array().cast("array<struct<at:struct<block:bigint,line:bigint>,text:string>>")
    declared = _in_force(F.coalesce("field_lines", no_lines), place)
    rows = rows.withColumn(
        "sep",
        F.coalesce(_separator(_in_force(F.coalesce("separator_lines", no_lines), place)), F.lit("\t")),
    ).withColumn("declared", declared)
    names = _split(F.col("declared"), F.col("sep"))
    fields = F.transform(F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))), lambda f: F.trim(f))
    rows = rows.withColumn("fields", fields).withColumn("cells", _split(F.col("value"), F.col("sep")))
    reason = F.when(F.col("fields").isNull() | (F.size("fields") == 0), "no_header").when(
        F.size("fields") != F.size("cells"), "field_count"
    )
    return rows.select("seq", "file", "value", "fields", "cells", reason.alias("reason"))


def records(placed: DataFrame) -> DataFrame:
    """Readable rows as ``(seq, record map)``."""
    good = parsed(placed).filter(F.col("reason").isNull())
    return good.select("seq", F.map_from_arrays("fields", "cells").alias("record"))


def malformed(placed: DataFrame) -> DataFrame:
    """Skipped rows with the reason, for a quarantine table."""
    return parsed(placed).filter(F.col("reason").isNotNull()).select(
        "file", F.col("seq.line").alias("line"), F.col("value").alias("text"), "reason"
    )


def malformed_counts(placed: DataFrame) -> DataFrame:
    return malformed(placed).groupBy("file", "reason").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return with_place(located(spark.read.text(path)))


def zeek_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of one log kind. ``path`` may be a file, a directory or a glob."""
    return records(_lines(spark, path))


def existing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob on any Hadoop file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath()) for f in found] if found is not None else []


def zeek_dir_scan(spark: SparkSession, directory: str, kinds: list[str] = LOG_KINDS) -> dict[str, DataFrame]:
    """All log kinds below ``directory`` (a glob is fine); a missing kind is an empty table."""
    empty = spark.createDataFrame([], T.StructType(RAW_ROW.fields[1:]))
    out = {}
    for kind in kinds:
        pattern = f"{directory.rstrip('/')}/{kind}.log"
        out[kind] = zeek_scan(spark, pattern) if existing(spark, pattern) else empty
    return out


def record_counts(raw: dict[str, DataFrame]) -> DataFrame:
    """Rows per log kind."""
    parts = [df.select(F.lit(kind).alias("kind")) for kind, df in raw.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def silver(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Raw records -> typed tables ready for the feature matrix."""
    out = {"conn": flatten(normalize_conn(raw["conn"]))}
    for kind in ("dns", "weird", "ssl", "quic"):
        if kind in raw:
            out[kind] = typed_aux(raw[kind], kind)
    return out


def write_zeek(rows: DataFrame, path: str, key: str = "uid", order: tuple[str, ...] = (), files: int | None = None) -> None:
    """Write text columns as log files. Rows of one ``key`` stay together, sorted by ``order``.

    Every group of rows is preceded by its own ``#fields`` line, so each file starts with one.
    """
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in rows.columns if c not in order]
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in columns])
    place = F.pmod(F.xxhash64(key), F.lit(files)).cast("long")
    body = rows.select(line.alias("value"), place.alias("_p"), F.lit(1).alias("_r"), F.col(key).alias("_k"), *order)
    nulls = [F.lit(None).cast(dict(body.dtypes)[c]).alias(c) for c in ("_k", *order)]
    header = rows.sparkSession.range(files).select(
        F.lit("\t".join(["#fields", *columns])).alias("value"), F.col("id").alias("_p"), F.lit(0).alias("_r"), *nulls
    )
    placed = body.unionByName(header).repartition(files, "_p").sortWithinPartitions("_p", "_r", "_k", *order)
    with shuffles_let_go(rows.sparkSession):
        placed.select("value").write.mode("overwrite").text(path)

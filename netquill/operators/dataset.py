"""Labelled training table: assembly, profile, duplicates, splits and integrity checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquill.contract import (
    FEATURE_COLUMNS, THREAT_CLASSES,
)
from netquill.functions.scalars import endpoint_str, round_half_even
from netquill.operators.assemble import feature_array
from netquill.operators.quantiles import exact_percentiles
from netquill.operators.timeline import DEFAULT_SLOT_SECONDS, numbered
from netquill.sources.stage import staged

TRAIN_SHARE = 0.70


def label_dimension(spark) -> DataFrame:
    """The fixed nine-row class dimension."""
    from netquill.contract import ACTIVE_CLASSES

    rows = [(i, c, c in ACTIVE_CLASSES) for i, c in enumerate(THREAT_CLASSES)]
    return spark.createDataFrame(rows, "label_id int, label string, active boolean")


def labelled_rows(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature table + (uid, experiment, label) -> labelled feature rows."""
    named = labels.select(F.col("uid").alias("flow_uid"), "experiment_id", "label", "label_id")
    return matrix.join(named, "flow_uid").select(
        "experiment_id", "flow_uid", "timestamp",
        endpoint_str(F.col("source_ip"), F.col("source_port")).alias("source_endpoint"),
        endpoint_str(F.col("destination_ip"), F.col("destination_port")).alias("destination_endpoint"),
        "protocol", "connection_state", F.lit("flow").alias("resolution"), "label", "label_id",
        feature_array().alias("features"),
    )


def wide(rows: DataFrame) -> DataFrame:
    """Labelled rows with the feature array spread over the 78 named columns."""
    keep = [c for c in rows.columns if c != "features"]
    return rows.select(*keep, *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(FEATURE_COLUMNS)])


def with_row_id(rows: DataFrame, slot_seconds: float = DEFAULT_SLOT_SECONDS, name: str = "master_row_id") -> DataFrame:
    """Sequential ids 1..N by (experiment, time, uid): positions per run plus run offsets."""
    placed = numbered(rows, ["experiment_id"], "timestamp", ["flow_uid"], slot_seconds, "_position")
    sizes = rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("experiment_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("experiment_id", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return placed.join(starts, "experiment_id").withColumn(name, F.col("_start") + F.col("_position")).drop(
        "_start", "_position", "group_size"
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value with their percentage of all rows."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return counts.select(column, "n", round_half_even(F.col("n") * 100.0 / total, 2).alias("pct"))


def value_counts(table: DataFrame, features: list[str]) -> DataFrame:
    """Rows per feature and value, for all columns in one scan.

    Every Arrow batch is counted column by column before anything is shuffled, so a flag column sends two rows a batch, not one a
    row. Nulls are not counted; negative zero is zero.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [np.unique(b.column(i).drop_null().to_numpy(zero_copy_only=False) + 0.0, return_counts=True) for i in range(b.num_columns)]
            sizes = [len(v) for v, _ in pairs]
            yield pa.record_batch(
                [pa.array(np.repeat(np.arange(len(pairs), dtype=np.int32), sizes)), pa.array(np.concatenate([v for v, _ in pairs])),
                 pa.array(np.concatenate([n for _, n in pairs]).astype(np.int64))], ["place", "value", "n"],
            )

    cells = table.select(*[F.col(n).cast("double") for n in features])
    names = F.array(*[F.lit(n) for n in features])
    combined = cells.mapInArrow(counted, "place int, value double, n long").groupBy("place", "value").agg(F.sum("n").alias("n"))
    return combined.select(F.get(names, F.col("place")).alias("feature"), "value", "n")


def feature_profile(table: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Per feature: min, max, mean, median, population std, distinct count, share of zeros; all from the counts per value."""
    counts = staged(value_counts(table, features))
    v, n = F.col("value"), F.col("n")
    basics = counts.groupBy("feature").agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.sum(n).alias("rows"), (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.count(F.lit(1)).alias("unique_count"), F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zeros"),
    )
    spread = counts.join(basics.select("feature", "mean", "rows"), "feature").groupBy("feature").agg(
        F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.max("rows")).alias("std")
    )
    middle = exact_percentiles(counts, ["feature"], "value", {"median": 0.5}, weight="n").drop("n")
    r4 = lambda c: round_half_even(F.col(c), 4).alias(c)
    return basics.join(spread, "feature").join(middle, "feature").select(
        "feature", r4("min"), r4("max"), r4("mean"), r4("median"), r4("std"), "unique_count",
        round_half_even(F.col("zeros") / F.col("rows") * 100.0, 2).alias("zero_pct"),
    )


def feature_flags(profile: DataFrame) -> DataFrame:
    """Constant, near-constant, sparse and extreme-range verdicts over a profile."""
    constant = F.col("unique_count") == 1
    return profile.select(
        "feature",
        constant.alias("is_constant"),
        (~constant & (F.col("unique_count") <= 3) & (F.col("zero_pct") > 95.0)).alias("is_near_constant"),
        (~constant & (F.col("zero_pct") >= 90.0)).alias("is_sparse"),
        ((F.col("max") - F.col("min")) > 10000.0).alias("is_extreme_range"),
    )


def zero_variance_columns(table: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Features with at most one distinct value, from one min/max pass over all columns at once."""
    ends = table.agg(*[F.struct(F.lit(n).alias("feature"), F.min(F.col(n).cast("double")).alias("lo"), F.max(F.col(n).cast("double")).alias("hi")).alias(n) for n in features])
    spans = ends.select(F.inline(F.array(*[F.col(n) for n in features])))  # one row in, a row for each column out
    return spans.filter(F.col("lo").eqNullSafe(F.col("hi"))).select("feature")


def duplicate_clusters(table: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """Groups of rows with equal feature vectors: size, excess rows, runs and classes involved.

    Grouping on the vector itself combines copies before the shuffle. Members are not
    collected; :func:`duplicate_members` lists them as rows.
    """
    return (
        table.withColumn("_v", F.array(*[F.col(f).cast("double") for f in features]))
        .groupBy("_v", "experiment_id", "label").agg(F.count(F.lit(1)).alias("_n"), F.min("flow_uid").alias("_first"))
        .groupBy("_v").agg(
            F.sum("_n").alias("duplicate_count"), F.min("_first").alias("cluster_id"),
            F.count_distinct("experiment_id").alias("experiments"), F.count_distinct("label").alias("classes"),
        )
        .filter(F.col("duplicate_count") > 1)
        .select("cluster_id", "duplicate_count", (F.col("duplicate_count") - 1).alias("excess_rows"), "experiments", "classes", "_v")
    )


def duplicate_members(table: DataFrame, features: list[str] = FEATURE_COLUMNS) -> DataFrame:
    """One row per member of every duplicate cluster."""
    clusters = duplicate_clusters(table, features).select("_v", "cluster_id")
    rows = table.withColumn("_v", F.array(*[F.col(f).cast("double") for f in features]))
    return rows.join(clusters, "_v").select("cluster_id", "flow_uid", "experiment_id", "label", "protocol", "destination_endpoint")


def label_violations(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows whose (label, label_id) is not a row of the class dimension."""
    return rows.join(F.broadcast(dimension), ["label", "label_id"], "left_anti")


def with_run_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Attach per-run capture facts; Spark broadcasts them only while they are small."""
    return rows.join(facts, "experiment_id", "left")


def _cut(n: Column) -> Column:
    return F.rint(n * F.lit(TRAIN_SHARE))


def holdout_split(
    rows: DataFrame,
    train_runs: list[str],
    test_runs: dict[str, str],
    row_id: str = "flow_uid",
    slot_seconds: float = DEFAULT_SLOT_SECONDS,
) -> DataFrame:
    """Add ``part`` (train/test) and ``partition``: named runs whole, others first 70 % by time."""
    run = F.col("experiment_id")
    role = F.when(run.isin(train_runs), "train_holdout")
    for name, text in test_runs.items():
        role = role.when(run == name, text)
    placed = numbered(rows, ["experiment_id"], "timestamp", [row_id], slot_seconds, "_position")
    early = F.col("_position") <= _cut(F.col("group_size"))
    part = (
        F.when(run.isin(train_runs), "train").when(run.isin(list(test_runs)), "test")
        .when(early, "train").otherwise("test")
    )
    return placed.withColumn("part", part).withColumn("partition", role.otherwise("chronological_70_30")).drop(
        "_position", "group_size"
    )


def split_manifest(split: DataFrame) -> DataFrame:
    return split.groupBy("experiment_id", "partition").agg(
        F.count_if(F.col("part") == "train").alias("train_count"),
        F.count_if(F.col("part") == "test").alias("test_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def validation_split(
    split: DataFrame,
    whole_train: list[str],
    whole_validation: list[str],
    row_id: str = "flow_uid",
    slot_seconds: float = DEFAULT_SLOT_SECONDS,
) -> DataFrame:
    """Cut the training part again, 70/30 by time per run; the test part is not touched."""
    train = split.filter(F.col("part") == "train")
    run = F.col("experiment_id")
    placed = numbered(train, ["experiment_id"], "timestamp", [row_id], slot_seconds, "_position")
    early = F.col("_position") <= _cut(F.col("group_size"))
    inner = (
        F.when(run.isin(whole_train), "sub_train").when(run.isin(whole_validation), "validation")
        .when(early, "sub_train").otherwise("validation")
    )
    return placed.withColumn("inner_part", inner).drop("_position", "group_size")


def split_quality(rows: DataFrame, split: DataFrame, row_id: str = "flow_uid") -> DataFrame:
    """One row: sizes, rows in both parts and rows in neither (both must be zero)."""
    ids = split.groupBy(row_id).agg(
        F.count_if(F.col("part") == "train").alias("tr"), F.count_if(F.col("part") == "test").alias("te")
    )
    state = rows.select(row_id).distinct().join(ids, row_id, "left")
    tr, te = F.coalesce("tr", F.lit(0)), F.coalesce("te", F.lit(0))
    return state.agg(
        F.count_if(tr > 0).alias("train_rows"), F.count_if(te > 0).alias("test_rows"),
        F.count_if((tr > 0) & (te > 0)).alias("in_both"), F.count_if((tr == 0) & (te == 0)).alias("in_neither"),
    )


def label_rule(flows: DataFrame, run_class: Column, target_port: Column, wide_states: bool = False) -> DataFrame:
    """Ground truth of a run: in DDOS runs only flows at the target or in a failed state are DDOS."""
    states = ["S0", "REJ", "RSTO", "RSTR"] if wide_states else ["S0", "REJ"]
    attack = (F.col("dst_port") == target_port) | F.col("conn_state").isin(states)
    label = (
        F.when(run_class == "BENIGN", "BENIGN")
        .when(run_class == "DDOS", F.when(attack, "DDOS").otherwise("BENIGN"))
        .otherwise(run_class)
    )
    ids = F.create_map(*[x for i, c in enumerate(THREAT_CLASSES) for x in (F.lit(c), F.lit(i))])
    unknown = -1 if wide_states else 0
    return flows.withColumn("label", label).withColumn(
        "label_id", F.coalesce(F.try_element_at(ids, F.col("label")), F.lit(unknown))
    )

"""Exact interpolated percentiles without collecting a group.

Rows are first added up to counts per value, with map-side combine, so copies of a value cost nothing further. The counts are dealt over
ranges of (key, value): the size of every range says in which one a wanted rank lies, and only that range is ordered. Ranges are
cut by the distribution of the distinct values, so a heavy tail gets as many of them as it needs; one path serves all sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netquill.sources.stage import staged


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None) -> DataFrame:
    """Per key: ``n`` and one linearly interpolated percentile column per entry of ``probs``; ``weight`` is a column that says for how
    many rows a row stands.

    Null values are not counted. NaN counts as the largest value, so only percentiles that reach it are NaN. Rows with a null
    key have no group.
    """
    by = list(keys) or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    many = F.lit(1) if weight is None else F.col(weight)
    rows = rows.select(*by, F.col(value).cast("double").alias("_v"), many.cast("long").alias("_w")).dropna(subset=by).filter(F.col("_v").isNotNull())
    counted = rows.groupBy(*by, "_v").agg(F.sum("_w").alias("c"))
    # written, because the number of a range must not change between the passes
    parts = staged(counted.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))

    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*by, "_part").agg(F.sum("c").alias("in_part"))
    totals = totals.withColumn("n", F.sum("in_part").over(whole)).withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))
    targets = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    wanted = totals.withColumn("t", F.explode(targets)).withColumn("name", F.col("t.name")).withColumn("rank", F.col("t.p") * (F.col("n") - 1))
    wanted = wanted.filter((F.col("before") <= F.ceil("rank")) & (F.col("before") + F.col("in_part") > F.floor("rank")))
    within = Window.partitionBy(*by, "name", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.join(wanted.drop("t", "in_part"), [*by, "_part"]).withColumn("reached", F.col("before") + F.sum("c").over(within))
    at = lambda k: F.min(F.when(F.col("reached") > k, F.col("_v")))
    found = ranked.groupBy(*by, "n", "name", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    value_at = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank")))
    out = found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == x, value_at)).alias(x) for x in probs])
    return out if keys else out.drop("_all")

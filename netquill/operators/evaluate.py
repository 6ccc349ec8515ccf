"""Model evaluation from prediction rows: ``label``, ``prediction`` and ``probs``.

Everything first shrinks to counts with map-side combine; threshold sweeps explode each row
over a fixed, literal grid instead of joining one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.contract import ACTIVE_CLASSES, ACTIVE_LABEL_IDS
from netquill.functions.scalars import round_half_even
from netquill.operators import policy as P

# The swept thresholds.
COVERAGE_THRESHOLDS = [0.0, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
SWEEP_THRESHOLDS = [0.50, 0.35, 0.25]
HIGH_CONFIDENCE = 0.90


def with_argmax(scored: DataFrame) -> DataFrame:
    """Add ``prediction`` (argmax label), ``max_confidence`` and ``is_correct``."""
    out = scored.withColumn("prediction", P.argmax_label(F.col("probs"))).withColumn("max_confidence", F.array_max("probs"))
    return out.withColumn("is_correct", F.col("label") == F.col("prediction"))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def label_pairs(predicted: DataFrame, by: list[str] = (), prediction: str = "prediction") -> DataFrame:
    """Counts per (group, label, prediction): the only pass over the rows."""
    return predicted.groupBy(*by, "label", F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predicted: DataFrame) -> DataFrame:
    """Active classes in rows (truth) and columns; an unknown prediction counts as the first class."""
    known = F.when(F.col("prediction").isin(ACTIVE_CLASSES), F.col("prediction")).otherwise(F.lit(ACTIVE_CLASSES[0]))
    pairs = label_pairs(predicted.withColumn("prediction", known))
    every = F.array(*[F.lit(c) for c in ACTIVE_CLASSES])
    spine = pairs.sparkSession.range(1).select(F.explode(every).alias("label"))
    cells = [F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0)).alias(f"pred_{c.lower()}") for c in ACTIVE_CLASSES]
    counted = pairs.groupBy("label").agg(*cells)
    return spine.join(counted, "label", "left").na.fill(0)


def class_scores(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """TP / FP / FN, support, precision, recall and F1 per class seen in truth or prediction."""
    one_sided = pairs.select(
        *by,
        F.inline(F.array(
            F.struct(F.col("label").alias("class_name"), F.col("n").alias("as_truth"), F.lit(0).cast("long").alias("as_pred"),
                     F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).cast("long").alias("tp")),
            F.struct(F.col("prediction").alias("class_name"), F.lit(0).cast("long").alias("as_truth"), F.col("n").alias("as_pred"),
                     F.lit(0).cast("long").alias("tp")),
        )),
    )
    sums = one_sided.groupBy(*by, "class_name").agg(
        F.sum("as_truth").alias("support"), F.sum("as_pred").alias("predicted"), F.sum("tp").alias("tp")
    )
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select(
        *by, "class_name", "support", "tp", (F.col("predicted") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"),
        ratio(2.0 * precision * recall, precision + recall).alias("f1"),
    )


def per_class_metrics(predicted: DataFrame) -> DataFrame:
    """Rounded per-class scores of the active classes."""
    ids = F.create_map(*[x for c, i in zip(ACTIVE_CLASSES, ACTIVE_LABEL_IDS) for x in (F.lit(c), F.lit(i))])
    s = class_scores(label_pairs(predicted)).filter(F.col("class_name").isin(ACTIVE_CLASSES))
    return s.select(
        "class_name", F.try_element_at(ids, F.col("class_name")).alias("class_id"), F.col("support").alias("test_support"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
        round_half_even(F.col("precision")).alias("precision"), round_half_even(F.col("recall")).alias("recall"),
        round_half_even(F.col("f1")).alias("f1_score"),
    )


def _macro(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """Macro scores over classes in truth or prediction; balanced accuracy over classes in truth."""
    seen = F.col("support") > 0
    return scores.groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"),
    )


def macro_metrics(predicted: DataFrame, by: list[str] = (), prediction: str = "prediction") -> DataFrame:
    m = _macro(class_scores(label_pairs(predicted, by, prediction), by), by)
    names = ["macro_precision", "macro_recall", "macro_f1", "weighted_f1", "balanced_accuracy"]
    return m.select(*by, *[round_half_even(F.col(n)).alias(n) for n in names])


def _truth_position() -> Column:
    return F.array_position(P.class_array(), F.col("label")) - 1


def log_loss(scored: DataFrame, eps: float = 2.220446049250313e-16) -> DataFrame:
    p = F.get(F.col("probs"), _truth_position().cast("int"))
    clipped = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return scored.agg(round_half_even(F.avg(-F.log(clipped))).alias("log_loss"))


def one_vs_rest(scored: DataFrame) -> DataFrame:
    """One row per (prediction row, class): probability and whether the class is the truth."""
    return scored.select(F.posexplode("probs").alias("pos", "p"), _truth_position().alias("_truth")).select(
        F.get(P.class_array(), F.col("pos")).alias("class_name"), "p",
        (F.col("pos") == F.col("_truth")).cast("double").alias("y"),
    )


def brier_mean(scored: DataFrame) -> DataFrame:
    per_class = one_vs_rest(scored).groupBy("class_name").agg(F.avg((F.col("y") - F.col("p")) ** 2).alias("b"))
    return per_class.agg(round_half_even(F.avg("b")).alias("mean_brier_score"))


def reliability_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Pooled one-vs-rest calibration in uniform bins; empty bins do not appear."""
    edge = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return one_vs_rest(scored).groupBy(edge.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        round_half_even(F.avg("p")).alias("mean_predicted"), round_half_even(F.avg("y")).alias("fraction_positive"),
    )


def _mean_or_zero(condition: Column) -> Column:
    return round_half_even(F.coalesce(F.avg(F.when(condition, F.col("max_confidence"))), F.lit(0.0)))


def _confidence_columns() -> list[Column]:
    ok = F.col("is_correct")
    return [_mean_or_zero(F.lit(True)), _mean_or_zero(ok), _mean_or_zero(~ok)]


def per_experiment_accuracy(predicted: DataFrame) -> DataFrame:
    mean, right, wrong = _confidence_columns()
    ok = F.col("is_correct")
    return predicted.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("test_flows"),
        F.count_if(ok).alias("correct_predictions"), F.count_if(~ok).alias("incorrect_predictions"),
        round_half_even(F.avg(ok.cast("double"))).alias("accuracy"),
        mean.alias("mean_confidence"), right.alias("correct_confidence"), wrong.alias("incorrect_confidence"),
    )


def confidence_by_class(predicted: DataFrame) -> DataFrame:
    mean, right, wrong = _confidence_columns()
    ok = F.col("is_correct")
    return predicted.groupBy(F.col("label").alias("class_name")).agg(
        F.count(F.lit(1)).alias("total_test_count"),
        F.count_if(ok).alias("correct_count"), F.count_if(~ok).alias("incorrect_count"),
        mean.alias("overall_confidence"), right.alias("correct_confidence"), wrong.alias("incorrect_confidence"),
    )


def confidence_summary(predicted: DataFrame) -> DataFrame:
    mean, right, wrong = _confidence_columns()
    ok = F.col("is_correct")
    return predicted.agg(
        F.count(F.lit(1)).alias("overall_test_samples"),
        F.count_if(ok).alias("correct_samples"), F.count_if(~ok).alias("incorrect_samples"),
        mean.alias("overall_mean_confidence"), right.alias("correct_mean_confidence"), wrong.alias("incorrect_mean_confidence"),
        F.count_if(~ok & (F.col("max_confidence") > HIGH_CONFIDENCE)).alias("high_confidence_errors_count"),
    )


def coverage_curve(predicted: DataFrame, thresholds: list[float] = COVERAGE_THRESHOLDS) -> DataFrame:
    """Accepted / abstained, coverage and accuracy at every confidence threshold.

    Rows are first counted by how many thresholds they pass; only those few counts meet the grid.
    """
    grid = sorted(thresholds)
    passed = sum(((F.col("max_confidence") >= t).cast("int") for t in grid), F.lit(0))
    counts = predicted.groupBy(passed.alias("passed")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_correct")).alias("ok")
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("needs"), F.lit(float(t)).alias("confidence_threshold")) for i, t in enumerate(grid)])
    taken = F.col("passed") >= F.col("s.needs")
    sums = counts.withColumn("s", F.explode(steps)).groupBy("s.confidence_threshold").agg(
        F.sum("n").alias("total"), F.sum(F.when(taken, F.col("n")).otherwise(0)).alias("accepted"),
        F.sum(F.when(taken, F.col("ok")).otherwise(0)).alias("ok"),
    )
    accuracy = F.when(F.col("accepted") > 0, F.col("ok") / F.col("accepted") * 100.0).otherwise(F.lit(0.0))
    error = F.when(F.col("accepted") > 0, 100.0 - accuracy).otherwise(F.lit(0.0))
    return sums.select(
        "confidence_threshold",
        round_half_even(F.col("accepted") / F.col("total") * 100.0, 2).alias("coverage_percentage"),
        F.col("accepted").alias("accepted_sample_count"),
        (F.col("total") - F.col("accepted")).alias("abstained_review_count"),
        round_half_even(accuracy, 2).alias("accepted_accuracy_pct"),
        round_half_even(error, 2).alias("accepted_error_rate_pct"),
    )


def threshold_grid(scored: DataFrame, recon: list[float] = SWEEP_THRESHOLDS, dns: list[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """Macro and class scores of the class-threshold rule over a literal grid."""
    cells = F.array(*[
        F.struct(F.lit(float(r)).alias("recon_threshold"), F.lit(float(d)).alias("dns_tunnel_threshold"))
        for r in recon for d in dns
    ])
    by = ["recon_threshold", "dns_tunnel_threshold"]
    swept = scored.select("label", "probs", F.inline(cells)).withColumn(
        "prediction", P.swept_label(F.col("probs"), F.col(by[0]), F.col(by[1]))
    )
    scores = class_scores(label_pairs(swept, by), by)
    of = lambda c, m: F.coalesce(F.max(F.when(F.col("class_name") == c, F.col(m))), F.lit(0.0))
    focus = scores.groupBy(*by).agg(
        of("RECON", "recall").alias("recon_recall"), of("RECON", "precision").alias("recon_precision"),
        of("DNS_TUNNEL", "recall").alias("dns_tunnel_recall"), of("DNS_TUNNEL", "precision").alias("dns_tunnel_precision"),
    )
    names = ["macro_f1", "macro_recall", "balanced_accuracy", "recon_recall", "recon_precision",
             "dns_tunnel_recall", "dns_tunnel_precision"]
    return _macro(scores, by).join(focus, by).select(*by, *[round_half_even(F.col(n)).alias(n) for n in names])


# The columns of the error tables.
INSPECT = [
    "flow_uid", "experiment_id", "timestamp", "source_endpoint", "destination_endpoint", "protocol", "connection_state",
    "label", "prediction", "max_confidence", "flow_duration", "total_bytes", "total_packets", "bytes_per_packet",
    "orig_bytes_ratio", "win_src_flow_count_60s", "win_src_unique_dst_ports_60s", "win_dst_avg_bytes_per_flow_60s",
    "win_pair_delta_t_mean", "win_pair_delta_t_cv", "win_pair_orig_bytes_std", "dns_query_len", "dns_query_entropy",
]
CLASS_INSPECT = {
    "RECON": ["protocol", "destination_endpoint", "win_src_unique_dst_ports_60s", "win_src_flow_count_60s",
              "total_packets", "bytes_per_packet"],
    "DNS_TUNNEL": ["dns_query_len", "dns_query_entropy", "dns_subdomain_depth", "dns_numeric_ratio",
                   "win_src_dns_query_count_60s"],
}


def probability_columns() -> list[Column]:
    return [F.get("probs", F.lit(i)).alias(f"prob_{c.lower()}") for i, c in enumerate(ACTIVE_CLASSES)]


def misclassified(predicted: DataFrame) -> DataFrame:
    return predicted.filter(~F.col("is_correct")).select(*INSPECT, *probability_columns())


def class_error_table(predicted: DataFrame, label: str) -> DataFrame:
    """Rows that are, or were taken for, ``label``."""
    involved = (F.col("label") == label) | (F.col("prediction") == label)
    return predicted.filter(involved).select(
        "flow_uid", "experiment_id", "label", "prediction", F.col("max_confidence").alias("confidence"), *CLASS_INSPECT[label]
    )


def importance_stability(importances: DataFrame) -> DataFrame:
    """(feature, seed, importance) -> spread over seeds."""
    r5 = lambda c: round_half_even(c, 5)
    return importances.groupBy("feature").agg(
        r5(F.avg("importance")).alias("mean_importance_across_seeds"),
        r5(F.stddev_pop("importance")).alias("std_importance_across_seeds"),
        r5(F.min("importance")).alias("min_importance"), r5(F.max("importance")).alias("max_importance"),
    )


def top_features(importances: DataFrame, k: int = 10, by: str = "importance") -> DataFrame:
    return importances.orderBy(F.col(by).desc(), "feature").limit(k)

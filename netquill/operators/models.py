"""Classifiers on the feature contract: training, calibration, scoring, importance, ablation.

Everything is ``pyspark.ml``; probabilities leave as arrays in active-class order, so the
decision policy and all evaluation operators apply unchanged.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier,
)
from pyspark.ml.feature import RobustScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquill import contract as K
from netquill.operators import dataset as D
from netquill.operators import evaluate as E
from netquill.operators import policy as P
from netquill.operators.timeline import numbered
from netquill.sources.stage import importable, staged

SEED = 42
#: The seeds over which the spread of importances is measured.
SEEDS = (42, 101, 202, 303, 404)
_N = len(K.ACTIVE_CLASSES)


def class_index() -> Column:
    """Position of ``label`` among the active classes, as the numeric training label."""
    return (F.array_position(P.class_array(), F.col("label")) - 1).cast("double")


def prepared(table: DataFrame, columns: list[str]) -> DataFrame:
    """Feature vector ``x``, numeric ``y`` and the balanced weight ``w`` = n / (k * count).

    The per-class weights are a broadcastable table of at most six rows.
    """
    rows = table.withColumn("y", class_index()).filter(F.col("y") >= 0).withColumn(
        "x", array_to_vector(F.array(*[F.col(c).cast("double") for c in columns]))
    )
    return with_class_weight(rows)


def with_class_weight(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("_c"))
    totals = counts.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k")).withColumnRenamed("n", "_n").withColumnRenamed("k", "_k")
    n, k = totals.select("_n").scalar(), totals.select("_k").scalar()
    weights = counts.select("y", (n / (k * F.col("_c"))).alias("w"))
    return rows.join(F.broadcast(weights), "y")


def majority_probabilities(train: DataFrame, rows: DataFrame) -> DataFrame:
    """The dummy baseline: all probability on the most frequent training class."""
    top = train.groupBy("y").agg(F.count(F.lit(1)).alias("c")).agg(F.max_by("y", F.struct("c", -F.col("y"))).alias("y")).scalar()
    return rows.withColumn("_top", top).withColumn(
        "probs", F.array(*[(F.col("_top") == i).cast("double") for i in range(_N)])
    ).drop("_top")


def _gbt(max_iter: int = 20, max_depth: int = 5, step: float = 0.1, min_instances: int = 20, seed: int = SEED) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="w", maxIter=max_iter, maxDepth=max_depth, stepSize=step,
        minInstancesPerNode=min_instances, seed=seed,
    )


#: Rows up to which the boosters of all classes are fitted at once. Each of them holds a binned copy of the rows, about 400 bytes a row.
ROWS_AT_ONCE = 500_000


class _ClassByClass(OneVsRest):
    """One versus rest, with as many classes fitted at once as there is room for; the fitted models don't depend on that."""

    def _fit(self, dataset: DataFrame) -> OneVsRestModel:
        few = dataset.select(self.getLabelCol()).limit(ROWS_AT_ONCE + 1).count() <= ROWS_AT_ONCE
        return super()._fit(dataset) if not few else OneVsRest._fit(self.copy({self.parallelism: _N}), dataset)


def boosted(**params) -> OneVsRest:
    """Gradient boosting for several classes: one binary booster per class."""
    return _ClassByClass(classifier=_gbt(**params), featuresCol="x", labelCol="y", weightCol="w", parallelism=2)


def estimators(trees: int = 100, gbt_iter: int = 20, seed: int = SEED) -> dict[str, Pipeline]:
    """The baseline learners by name (the dummy is :func:`majority_probabilities`)."""
    common = {"labelCol": "y", "weightCol": "w"}
    return {
        "logistic_regression": Pipeline(stages=[
            RobustScaler(inputCol="x", outputCol="xs", withCentering=True, withScaling=True),
            LogisticRegression(featuresCol="xs", maxIter=200, **common),
        ]),
        "decision_tree": Pipeline(stages=[DecisionTreeClassifier(featuresCol="x", seed=seed, maxDepth=12, **common)]),
        "random_forest": Pipeline(stages=[RandomForestClassifier(featuresCol="x", numTrees=trees, seed=seed, **common)]),
        "gradient_boosting": Pipeline(stages=[boosted(max_iter=gbt_iter, seed=seed)]),
    }


def _normalised(raw: Column) -> Column:
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, F.transform(raw, lambda v: v / total)).otherwise(
        F.transform(raw, lambda v: F.lit(1.0 / _N))
    )


def _padded(probability: Column) -> Column:
    """Class probabilities as an array of the six active classes (absent classes get 0)."""
    a = vector_to_array(probability)
    return F.transform(F.sequence(F.lit(0), F.lit(_N - 1)), lambda i: F.coalesce(F.get(a, i), F.lit(0.0)))


def score(model: Model, rows: DataFrame) -> DataFrame:
    """Add ``probs`` to every row with one vectorised ``transform``."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    if not isinstance(stages[-1], OneVsRestModel):
        out = model.transform(rows)
        probs = _padded(F.col("probability"))
    else:  # one margin per class -> logistic per class, normalised; OneVsRestModel itself would send every row through Python once a class
        out = functools.reduce(lambda df, stage: stage.transform(df), stages[:-1], rows)
        for i, m in enumerate(stages[-1].models):
            out = m.transform(out, {m.rawPredictionCol: f"_margin{i}", m.probabilityCol: "", m.predictionCol: ""})
        margins = F.array(*[F.get(vector_to_array(F.col(f"_margin{i}")), F.lit(1)) for i in range(len(stages[-1].models))])
        probs = _normalised(F.transform(
            F.sequence(F.lit(0), F.lit(_N - 1)),
            lambda i: F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.get(margins, i))), F.lit(0.0)),
        ))
    return out.select(*rows.columns, probs.alias("probs"))


def _macro(scored: DataFrame) -> dict:
    """One row of macro scores and log-loss as plain numbers."""
    scored = staged(scored.select("label", "probs"))  # read twice
    judged = E.with_argmax(scored)
    row = E.macro_metrics(judged).first().asDict()
    row["log_loss"] = E.log_loss(scored).first()["log_loss"]
    return row


def _frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))


def baselines(train: DataFrame, test: DataFrame, trees: int = 100, gbt_iter: int = 20) -> DataFrame:
    """Macro scores of every baseline on ``test`` and its training-set gap (one row per model)."""
    out = []
    tests = {"majority": (majority_probabilities(train, test), majority_probabilities(train, train))}
    for name, est in estimators(trees, gbt_iter).items():
        model = est.fit(train)
        tests[name] = (score(model, test), score(model, train))
    for name, (on_test, on_train) in tests.items():
        fit = E.macro_metrics(E.with_argmax(on_train)).first()
        out.append({"model": name, "train_macro_f1": fit["macro_f1"], "train_balanced_accuracy": fit["balanced_accuracy"], **_macro(on_test)})
    return _frame(train.sparkSession, out)


# --- calibration ---------------------------------------------------------------------


def folded(rows: DataFrame, folds: int = 3, slot_seconds: float = 60.0) -> DataFrame:
    """Folds stratified by class: the rows of a class are numbered by time and dealt in turn, so every fold has its share of each."""
    placed = numbered(rows, ["y"], "timestamp", ["flow_uid"], slot_seconds, "_place")
    return placed.withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(folds)).cast("int")).drop("_place", "group_size")


def cross_scored(train: DataFrame, rows: DataFrame, folds: int = 3, **params) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with the probabilities of a booster for each fold (``_raw0`` and on), and for each fold those of the rows it did not see."""
    train = folded(train, folds)
    held, scored_rows = [], rows
    for f in range(folds):
        model = boosted(**params).fit(train.filter(F.col("fold") != f))
        held.append(staged(score(model, train.filter(F.col("fold") == f)).select("y", "probs")))
        scored_rows = score(model, scored_rows).withColumnRenamed("probs", f"_raw{f}")
    return staged(scored_rows), held


def calibrated_probabilities(train: DataFrame, rows: DataFrame, method: str = "sigmoid", folds: int = 3,
                             scored: tuple[DataFrame, list[DataFrame]] | None = None, **params) -> DataFrame:
    """Average over folds of a booster calibrated on the fold it did not see.

    Per fold and class the held-out probability is mapped to the class frequency by a
    logistic (``sigmoid``) or monotone (``isotonic``) fit, then the six are normalised.
    ``scored`` is what :func:`cross_scored` gave, for several methods over the same boosters.
    """
    scored_rows, held = scored or cross_scored(train, rows, folds, **params)
    maps = [[_calibrator(h, i, method) for i in range(_N)] for h in held]
    # columns of their own, since a Python function can't stand inside the lambdas that follow
    mapped = {f"_mapped{f}": F.array(*[fit(F.get(F.col(f"_raw{f}"), F.lit(i))) for i, fit in enumerate(of_fold)]) for f, of_fold in enumerate(maps)}
    scored_rows = scored_rows.withColumns(mapped)
    arrays = [_normalised(F.col(c)) for c in mapped]
    mean = functools.reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), arrays)
    return scored_rows.select(*rows.columns, F.transform(mean, lambda v: v / F.lit(float(len(held)))).alias("probs"))


def _calibrator(held: DataFrame, i: int, method: str):
    """Fit one class on held-out scores; returns a Column -> Column mapping."""
    points = held.select(
        F.get("probs", F.lit(i)).alias("p"), (F.col("y") == i).cast("double").alias("label"),
        array_to_vector(F.array(F.get("probs", F.lit(i)))).alias("features"),
    )
    if points.filter(F.col("label") == 1).isEmpty():
        return lambda c: F.lit(0.0)
    if method == "sigmoid":
        lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=50).fit(points)
        slope, intercept = float(lr.coefficients[0]), float(lr.intercept)
        return lambda c: F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * c + F.lit(intercept))))
    iso = IsotonicRegression(featuresCol="features", labelCol="label").fit(points)
    xs, ys = [float(v) for v in iso.boundaries], [float(v) for v in iso.predictions]

    return _curve(np.array(xs), np.array(ys))


def _curve(xs: np.ndarray, ys: np.ndarray):
    """Linear interpolation between the points, flat outside; the curve may have thousands of points, so it is searched, not scanned."""

    def step(c: pd.Series) -> pd.Series:
        p = c.to_numpy()
        at = np.searchsorted(xs, p, side="right")
        i = np.clip(at, 1, max(len(xs) - 1, 1))
        j = np.minimum(i, len(xs) - 1)
        with np.errstate(all="ignore"):
            between = ys[i - 1] + (ys[j] - ys[i - 1]) * (p - xs[i - 1]) / (xs[j] - xs[i - 1])
        return pd.Series(np.where(at == 0, ys[0], np.where(at == len(xs), ys[-1], between)))

    return F.pandas_udf(step, "double")


def calibration_comparison(train: DataFrame, test: DataFrame, folds: int = 3, **params) -> DataFrame:
    """Log-loss, Brier score and macro F1: uncalibrated, sigmoid and isotonic."""
    variants = {"uncalibrated": score(boosted(**params).fit(train), test)}
    scored = cross_scored(train, test, folds, **params)
    for method in ("sigmoid", "isotonic"):
        variants[method] = calibrated_probabilities(train, test, method, folds, scored, **params)
    out = []
    for name, scored in variants.items():
        scored = staged(scored.select("label", "probs"))
        out.append({
            "model": name, "log_loss": E.log_loss(scored).first()[0], "mean_brier_score": E.brier_mean(scored).first()[0],
            "macro_f1": E.macro_metrics(E.with_argmax(scored)).first()["macro_f1"],
        })
    return _frame(train.sparkSession, out)


# The seven sensitivity settings (learner parameters of the boosted model).
SENSITIVITY = {
    "baseline": {},
    "shallower": {"max_depth": 3},
    "shallow_small_leaves": {"max_depth": 3, "min_instances": 10},
    "fewer_leaves": {"max_depth": 4},
    "smaller_leaves": {"min_instances": 10},
    "slower_longer": {"step": 0.05, "more": 1.5},
    "smaller_leaves_slower": {"min_instances": 10, "step": 0.05},
}


def sensitivity(sub_train: DataFrame, validation: DataFrame, train: DataFrame, test: DataFrame,
                settings: dict[str, dict] = SENSITIVITY, max_iter: int = 20) -> DataFrame:
    """Validation and test scores of every parameter setting."""
    out = []
    for name, setting in settings.items():
        params = {k: v for k, v in setting.items() if k != "more"}
        params["max_iter"] = math.ceil(max_iter * setting.get("more", 1.0))
        inner = E.macro_metrics(E.with_argmax(score(boosted(**params).fit(sub_train), validation))).first()
        outer = _macro(score(boosted(**params).fit(train), test))
        out.append({
            "config_name": name, "params": json.dumps(params, sort_keys=True),
            "val_macro_f1": inner["macro_f1"], "val_balanced_acc": inner["balanced_accuracy"],
            "test_macro_f1": outer["macro_f1"], "test_balanced_acc": outer["balanced_accuracy"], "test_log_loss": outer["log_loss"],
        })
    return _frame(train.sparkSession, out)


# --- importance and ablation -----------------------------------------------------------


def impurity_importance(model: PipelineModel, columns: list[str]) -> DataFrame:
    """Feature importances of the tree model at the end of a pipeline."""
    values = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double")


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a keyed permutation of 0 to n - 1 sends ``i``: a Feistel network on the next even number of bits, walked on until it is inside.

    Sums wrap modulo 2**64 and only their low half is used, so every ``n`` below 2**62 works alike.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03 + 1) % 2**64) for r in range(6)]
    out = i.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & low
            for key in keys:
                mixed = (right + key) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed >> np.uint64(32)) & low)
            out[todo] = left << half | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _partner_number(n: int, key: int):
    def sent(i: pd.Series) -> pd.Series:
        return pd.Series(permuted(i.to_numpy(), n, key))

    return F.pandas_udf(sent, "long")


def tree_of(model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """``(feature, threshold, right, label)`` of a model that is one decision tree over numbers, in depth-first order; else None.

    An inner node's left child follows it and ``right`` is the other; a leaf has feature -1 and its label."""
    stages = model.stages if isinstance(model, PipelineModel) else [model]
    if len(stages) != 1 or not isinstance(stages[0], DecisionTreeClassificationModel):
        return None
    feature, threshold, right, label, opened = [], [], [], [], []
    for line in stages[0].toDebugString.split("\n")[1:]:
        if found := re.fullmatch(r" *If \(feature (\d+) <= (\S+)\)", line):
            opened.append(len(feature))
            row = (int(found[1]), float(found[2]), -1, -1)
        elif re.fullmatch(r" *Else \(feature \d+ > \S+\)", line):
            right[opened.pop()] = len(feature)
            continue
        elif found := re.fullmatch(r" *Predict: (\S+)", line):
            row = (-1, 0.0, -1, int(float(found[1])))
        elif line.strip():
            return None  # a split by categories
        else:
            continue
        for column, cell in zip((feature, threshold, right, label), row):
            column.append(cell)
    return np.array(feature), np.array(threshold), np.array(right), np.array(label)


def predicted(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """Label numbers of the rows of ``x``, a step down the tree at a time for all rows together."""
    feature, threshold, right, label = tree
    at, todo = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(todo := todo[feature[at[todo]] >= 0]):
        node = at[todo]
        at[todo] = np.where(x[todo, feature[node]] <= threshold[node], node + 1, right[node])
    return label[at]


def _hits_by_tree(tree: tuple[np.ndarray, ...], paired: DataFrame, width: int) -> DataFrame:
    """``(f, hits, n)``: right answers with one slot taken from the partner. A slot that the tree never looks at changes nothing."""
    used = sorted({int(f) for f in tree[0] if f >= 0})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, other = (b.column(n).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).copy() for n in ("v", "pv"))
                truth = b.column("truth").to_numpy(zero_copy_only=False)
                hits = np.full(width, (predicted(tree, x) == truth).sum(), np.int64)
                for f in used:
                    own = x[:, f].copy()
                    x[:, f] = other[:, f]
                    hits[f] = (predicted(tree, x) == truth).sum()
                    x[:, f] = own
                yield pa.record_batch([pa.array(np.arange(width, dtype=np.int32)), pa.array(hits), pa.array(np.full(width, b.num_rows, np.int64))], ["f", "hits", "n"])

    truth = F.coalesce(F.array_position(P.class_array(), F.col("label")) - 1, F.lit(-1)).cast("long").alias("truth")
    each = paired.select(truth, "v", "pv").mapInArrow(counted, "f int, hits long, n long")
    return each.groupBy("f").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def permutation_importance(model: Model, rows: DataFrame, columns: list[str], repeats: int = 5, seed: int = SEED,
                           slot_seconds: float = 60.0) -> DataFrame:
    """Accuracy lost when one feature is permuted over all rows, mean and std over repeats; no rows give no importances.

    Each repeat pairs every row with one partner row through a keyed permutation of the
    row numbers (one equi-join for all features). A single decision tree answers all swaps of a batch of pairs at once; for other
    models a row fans out into one copy per feature with that slot taken from the partner, and one ``transform`` scores them all.
    """
    spark = rows.sparkSession
    importable(spark)
    tree = tree_of(model)
    indexed = numbered(rows.withColumn("_all", F.lit(0)), ["_all"], "timestamp", ["flow_uid"], slot_seconds, "i")
    base = staged(indexed.select((F.col("i") - 1).alias("i"), "label", vector_to_array("x").alias("v")))
    n = base.count()
    if n == 0:
        return spark.createDataFrame([], "feature string, importance double, importance_std double")
    hit = (P.argmax_label(F.col("probs")) == F.col("label")).cast("double")
    whole = score(model, base.select("label", array_to_vector("v").alias("x"))).agg(F.avg(hit)).first()[0]
    runs = []
    for r in range(repeats):
        partner = base.select(F.col("i").alias("j"), F.col("v").alias("pv"))
        paired = base.withColumn("j", _partner_number(n, seed * 1_000_003 + r)("i")).join(partner, "j")
        if tree is not None:
            runs.append(_hits_by_tree(tree, paired, len(columns)).select("f", (F.lit(whole) - F.col("hits") / F.col("n")).alias("drop")))
            continue
        swapped = paired.select("label", "v", "pv", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("f"))
        mixed = F.transform("v", lambda x, k: F.when(k == F.col("f"), F.get("pv", F.col("f"))).otherwise(x))
        scored = score(model, swapped.select("label", "f", array_to_vector(mixed).alias("x")))
        runs.append(scored.groupBy("f").agg((F.lit(whole) - F.avg(hit)).alias("drop")))
    every = functools.reduce(DataFrame.unionByName, runs)
    names = F.array(*[F.lit(c) for c in columns])
    return every.groupBy(F.get(names, F.col("f")).alias("feature")).agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("importance_std")
    )


def importance_over_seeds(learner: Callable[[int], Pipeline], train: DataFrame, rows: DataFrame, columns: list[str],
                          seeds: Sequence[int] = SEEDS, repeats: int = 5, k: int = 10) -> DataFrame:
    """The ``k`` features with the highest mean permutation importance over models fitted and permuted under each seed, with spread and rank."""
    each = [permutation_importance(learner(seed).fit(train), rows, columns, repeats, seed).withColumn("seed", F.lit(seed)) for seed in seeds]
    spread = E.importance_stability(functools.reduce(DataFrame.unionByName, each))
    top = E.top_features(spread, k, by="mean_importance_across_seeds")
    order = Window.orderBy(F.col("mean_importance_across_seeds").desc(), "feature")  # k rows
    return top.withColumn("rank", F.row_number().over(order))


def ablation_columns(zero_variance: list[str]) -> dict[str, list[str]]:
    """All features, those that vary on the training part, and these without one group of the contract at a time."""
    lists = {"full_schema": K.FEATURE_COLUMNS, "drop_zero_variance": [c for c in K.FEATURE_COLUMNS if c not in zero_variance]}
    for group, members in K.FEATURE_GROUPS.items():
        lists[f"drop_{group}"] = [c for c in lists["drop_zero_variance"] if c not in members]
    return lists


def ablation(train: DataFrame, test: DataFrame, learner) -> DataFrame:
    """Macro scores of ``learner()`` on every ablated column list (wide train / test tables)."""
    constant = [r["feature"] for r in D.zero_variance_columns(train).collect()]  # at most 78 names
    out = []
    for name, columns in ablation_columns(constant).items():
        model = learner().fit(prepared(train, columns))
        m = _macro(score(model, prepared(test, columns)))
        out.append({"ablation_name": name, "feature_count": len(columns), **m})
    return _frame(train.sparkSession, out)


# --- bundles -----------------------------------------------------------------------------

_SIDECARS = ("metadata.json", "feature_contract.json", "decision_policy.json")


def _text(spark: SparkSession, path: str, content: str | None = None) -> str:
    """Write (or read) a one-line text file through Spark, so any file system works."""
    if content is None:
        return spark.read.text(path).first()[0]
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return content


def save_bundle(model: PipelineModel, path: str, metadata: dict | None = None) -> None:
    """Model plus metadata, contract and policy documents."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    policy = {
        "abstain_threshold": K.ABSTAIN_THRESHOLD, "recon_threshold": K.RECON_THRESHOLD,
        "active_classes": K.ACTIVE_CLASSES, "active_label_ids": K.ACTIVE_LABEL_IDS,
    }
    documents = ({"model_version": K.MODEL_VERSION, **(metadata or {})}, K.contract_document(), policy)
    for name, doc in zip(_SIDECARS, documents):
        _text(spark, f"{path}/{name}", json.dumps(doc, sort_keys=True))


def load_bundle(path: str) -> tuple[PipelineModel, dict[str, dict]]:
    """Load a bundle; a missing piece or a different contract is an error."""
    spark = SparkSession.getActiveSession()
    documents = {}
    for name in _SIDECARS:
        try:
            documents[os.path.splitext(name)[0]] = json.loads(_text(spark, f"{path}/{name}"))
        except Exception as e:
            raise FileNotFoundError(f"model bundle {path} lacks {name}") from e
    if documents["feature_contract"]["columns"] != K.FEATURE_COLUMNS:
        raise ValueError("the bundle was trained on another feature contract")
    return PipelineModel.load(f"{path}/model"), documents


def bundle_scorer(path: str) -> Callable[[DataFrame], DataFrame]:
    """A scorer for the live path from a stored bundle: feature rows get ``probs`` and ``processing_time_ms``."""
    model, _ = load_bundle(path)

    def scorer(features: DataFrame) -> DataFrame:
        x = array_to_vector(F.array(*[F.col(c).cast("double") for c in K.FEATURE_COLUMNS]))
        return score(model, features.withColumn("x", x)).drop("x").withColumn("processing_time_ms", F.lit(0.0))

    return scorer


def round_trip_differences(model: PipelineModel, path: str, rows: DataFrame) -> DataFrame:
    """Rows scored differently by a saved and reloaded model (must be empty)."""
    save_bundle(model, path)
    again, _ = load_bundle(path)
    cells = lambda m: score(m, rows).select("flow_uid", F.transform("probs", lambda p: F.round(p, 9)).alias("probs"))
    return cells(model).exceptAll(cells(again))

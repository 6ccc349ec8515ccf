"""The model queries hand the whole job to their operators: all features, and the operators' own learners, rounds and repeats."""

import inspect

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from netquill import contract as K
from netquill.operators import models as M
from netquill.plans import catalog_runs as R
from netquill.plans.catalog import QUERIES

DEFAULTS = {
    "baseline_models": ("baselines", {"trees": 100, "gbt_iter": 20}),
    "probability_calibration": ("calibration_comparison", {"folds": 3, "params": {}}),
    "hyperparameter_sensitivity": ("sensitivity", {"settings": M.SENSITIVITY, "max_iter": 20}),
    "permutation_importance": ("permutation_importance", {"repeats": 5, "columns": K.FEATURE_COLUMNS}),
    "impurity_importance": ("impurity_importance", {"columns": K.FEATURE_COLUMNS}),
}


class Handed(Exception):
    pass


@pytest.mark.parametrize("name", DEFAULTS)
def test_defaults_are_used(spark, sf, monkeypatch, name):
    operator, want = DEFAULTS[name]
    signature, trees = inspect.signature(getattr(M, operator)), []

    class Fitted:
        def fit(self, _):
            return self

    def estimators(*given, real=M.estimators, **named):
        trees.append(real(*given, **named)["random_forest"].getStages()[-1].getNumTrees())
        return dict.fromkeys(real(), Fitted())

    def stop(*given, **named):
        bound = signature.bind(*given, **named)
        bound.apply_defaults()
        raise Handed(bound.arguments)

    table = spark.range(1)
    monkeypatch.setattr(R, "_parts", lambda spark, d: (table, table, table))
    monkeypatch.setattr(R.D, "validation_split", lambda *a: table.selectExpr("'x' AS inner_part"))
    monkeypatch.setattr(R.M, "prepared", lambda rows, columns: rows)
    monkeypatch.setattr(R.M, "estimators", estimators)
    monkeypatch.setattr(R.M, operator, stop)
    with pytest.raises(Handed) as handed:
        QUERIES[name](spark, sf)
    got = handed.value.args[0]
    assert {k: got.get(k, {}) for k in want} == want and set(trees) <= {100}


def test_all_features_reach_the_learners(spark, sf, monkeypatch):
    split, train, _ = R._parts(spark, sf)
    assert set(K.FEATURE_COLUMNS) <= set(split.columns) and len(train.first()["x"]) == 78
    used = split.selectExpr("max(has_dns_context) AS dns", "max(has_ssl_context) AS ssl").first()
    assert (used["dns"], used["ssl"]) == (1, 1)
    asked = []
    monkeypatch.setattr(R, "_parts", lambda spark, d: (split, None, None))
    monkeypatch.setattr(R.M, "ablation", lambda train, test, learner: asked.append((train.columns, learner())) or spark.range(1))
    models = {r["model"] for r in QUERIES["feature_ablation"](spark, sf).collect()}
    assert models == {"random_forest", "gradient_boosting", "logistic_regression"} and len(asked) == 3


def _vectors(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 4)).astype(float)
    y = (x[:, 0] + 2 * (x[:, 1] > 2)) % 3
    rows = [(f"F{i}", float(i), K.ACTIVE_CLASSES[int(y[i])], float(y[i]), 1.0, Vectors.dense(x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["flow_uid", "timestamp", "label", "y", "w", "x"])


def test_a_tree_answers_all_swaps_without_copies_of_the_rows(spark, monkeypatch):
    """Every row used to fan out into a copy for each feature, scored one by one; the importances are the same."""
    rows = _vectors(spark)
    model = M.estimators()["decision_tree"].fit(rows)
    tree = M.tree_of(model)
    x = np.array([r["x"].toArray() for r in rows.collect()])
    assert M.predicted(tree, x).tolist() == [int(r["prediction"]) for r in model.transform(rows).collect()]
    names = ["a", "b", "c", "d"]
    fast = sorted(map(tuple, M.permutation_importance(model, rows, names, repeats=2).collect()))
    monkeypatch.setattr(M, "tree_of", lambda m: None)
    assert sorted(map(tuple, M.permutation_importance(model, rows, names, repeats=2).collect())) == fast
    assert M.tree_of(M.estimators(trees=2)["random_forest"].fit(rows)) is None


def test_both_calibrations_share_their_boosters(spark, monkeypatch):
    """Three folds were fitted again for the second method: seven fits for the comparison instead of four."""
    rows, fits, fit = _vectors(spark, 240), [], M.OneVsRest._fit
    monkeypatch.setattr(M.OneVsRest, "_fit", lambda self, d: fits.append(self.getParallelism()) or fit(self, d))
    got = M.calibration_comparison(rows, rows, folds=3, max_iter=1, max_depth=2).collect()
    assert [r["model"] for r in got] == ["uncalibrated", "sigmoid", "isotonic"]
    assert fits == [6] * 4  # few rows: all classes at once


def test_isotonic_curve(spark):
    xs, ys = np.array([0.1, 0.2, 0.2, 0.7]), np.array([0.0, 0.25, 0.5, 1.0])
    points = [0.0, 0.1, 0.15, 0.2, 0.45, 0.7, 0.9]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in points], "p double").coalesce(1).select(M._curve(xs, ys)("p")).collect()]
    assert got == [0.0, 0.0, (0.15 - 0.1) * 0.25 / 0.1, 0.5, 0.5 + 0.5 * (0.45 - 0.2) / (0.7 - 0.2), 1.0, 1.0]

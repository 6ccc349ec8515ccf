"""Splits, row numbers and the model path on one small staged table."""

import pytest
import numpy as np
from pyspark.sql import functions as F

from netquill import contract as K
from netquill.operators import dataset as D
from netquill.operators import evaluate as E
from netquill.operators import models as M
from netquill.operators import timeline as TL
from netquill.sources.stage import staged

COLUMNS = ["total_bytes", "flow_duration", "is_well_known_dst_port"]


@pytest.fixture(scope="module")
def table(spark):
    n = F.col("id")
    cls = (n % 6).cast("int")
    names = F.array(*[F.lit(c) for c in K.ACTIVE_CLASSES])
    rows = spark.range(600).select(
        F.concat(F.lit("u"), n).alias("flow_uid"), (n * 3.0).alias("timestamp"), F.get(names, cls).alias("label"),
        F.when(n < 400, "run_hot").otherwise("run_small").alias("experiment_id"),
        (cls * 100.0 + n % 7).alias("total_bytes"), (n % 5).cast("double").alias("flow_duration"),
        F.lit(1.0).alias("is_well_known_dst_port"),
    )
    return staged(rows)


def test_numbering_crosses_slots(spark, table):
    for slot in (10.0, 1e9):
        rows = TL.numbered(table, ["experiment_id"], "timestamp", ["flow_uid"], slot).collect()
        for r in rows:
            want = int(r["timestamp"] // 3) + 1 - (400 if r["experiment_id"] == "run_small" else 0)
            assert r["position"] == want
    ids = sorted(r["master_row_id"] for r in D.with_row_id(table).collect())
    assert ids == list(range(1, 601))


def test_split_cut_is_half_even(spark, table):
    split = D.holdout_split(table, [], {})
    m = {r["experiment_id"]: (r["train_count"], r["test_count"]) for r in D.split_manifest(split).collect()}
    assert m == {"run_hot": (280, 120), "run_small": (140, 60)}
    q = D.split_quality(table, split).first()
    assert (q["in_both"], q["in_neither"]) == (0, 0)


def test_training_scoring_and_importance(spark, table, tmp_path):
    split = D.holdout_split(table, [], {})
    train = staged(M.prepared(split.filter("part = 'train'"), COLUMNS))
    test = staged(M.prepared(split.filter("part = 'test'"), COLUMNS))
    model = M.estimators()["decision_tree"].fit(train)
    assert E.macro_metrics(E.with_argmax(M.score(model, test))).first()["macro_f1"] == 1.0
    imp = {r["feature"]: r["importance"] for r in M.permutation_importance(model, test, COLUMNS, repeats=2).collect()}
    assert imp["total_bytes"] > 0.5 and imp["flow_duration"] == 0 and imp["is_well_known_dst_port"] == 0
    assert M.round_trip_differences(model, str(tmp_path / "bundle"), test).isEmpty()
    with pytest.raises(FileNotFoundError):
        M.load_bundle(str(tmp_path / "nothing"))


def test_permutation_is_a_bijection():
    for n in (0, 1, 2, 3, 10, 97, 1000, 1_000_002, 1_000_003, 1_000_004):
        for seed in range(3):
            sent = M.permuted(np.arange(n), n, seed)
            assert len(sent) == n and (np.bincount(sent, minlength=n) == 1).all()
    moved = M.permuted(np.arange(1000), 1000, 1)
    assert (moved != M.permuted(np.arange(1000), 1000, 2)).sum() > 900 and (moved != np.arange(1000)).sum() > 900
    far = np.array([0, 2**61 - 2, 2**61 - 1])
    assert len(set(M.permuted(far, 2**61, 3).tolist())) == 3 and M.permuted(far, 2**61, 3).max() < 2**61


def test_zero_variance_and_ablation_lists(spark, table):
    assert [r["feature"] for r in D.zero_variance_columns(table, COLUMNS).collect()] == ["is_well_known_dst_port"]
    lists = M.ablation_columns(["missed_bytes"])
    assert len(lists["full_schema"]) == 78 and len(lists["drop_zero_variance"]) == 77
    assert not any("private_ip" in c for c in lists["drop_private_ip"])

"""The levelled history: bounded runs and listings over many batches, lookups that lose nothing, replays and expiry."""

import os
import random

from pyspark.sql import functions as F

from netquill.streaming.history import History


def _land(history, spark, batch, rows):
    history.begin(batch)
    frame = spark.createDataFrame(rows, "uid string, ts double, note string").withColumn("bucket", F.floor(F.col("ts") / 3600))
    hours = history.land("dns", frame, len(rows))
    history.commit()
    return hours


def _rows(rng, batch, n=12):
    at = 1000 * 3600 + batch * 1800  # two batches an hour
    return [(f"U{batch}-{i}", float(at + rng.randrange(1800)), "x" * i) for i in range(n)]


def test_fifty_batches_stay_bounded(spark, tmp_path):
    rng, root = random.Random(4), str(tmp_path / "history")
    history, every, listed, opened = History(spark, root, ["dns"], fan=4), [], [], []
    for batch in range(50):
        if batch in (17, 33):  # a new process
            history = History(spark, root, ["dns"], fan=4)
        rows = _rows(rng, batch)
        every += rows
        hours = _land(history, spark, batch, rows)
        assert hours == sorted({int(t // 3600) for _, t, _ in rows})
        listed.append((len(os.listdir(f"{root}/dns")), len(os.listdir(f"{root}/manifest"))))
        if batch % 7 == 6:
            asked = [f"U{batch - 5}-3", f"U{batch // 2}-1", "nobody"]
            reached = [h - back for h in hours for back in (0, 1)]
            uids = spark.createDataFrame([(u,) for u in asked], "uid string")
            far = history.far("dns", uids, reached)
            got = sorted((r["uid"], r["ts"], r["note"], r["batch_id"]) for r in far.collect()) if far is not None else []
            want = sorted((u, t, n, int(u[1:].split("-")[0])) for u, t, n in every if u in asked and int(t // 3600) not in reached)
            assert got == want
            near = history.near("dns", reached)
            assert near.count() == sum(int(t // 3600) in reached for _, t, _ in every)
            history.far("dns", uids, reached)
            opened.append(history.opened["dns"])
    # four levels of at most three runs, replaced runs for two more batches; a lookup of three uids opens few of the files
    runs = {(e.level, e.run) for e in history.live("dns")}
    assert max(sum(level == x for level, _ in runs) for x in range(4)) <= 3
    assert max(n for n, _ in listed) <= 4 * 3 + 2 * 4 + 3 and max(n for _, n in listed) <= 3
    assert max(far for _, _, far in opened) <= 6 and max(near for _, near, _ in opened) <= 12
    assert spark.read.parquet(*[e.file for e in history.live("dns")]).count() == len(every)


def test_replay_and_expiry(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path / "history")
    history, every = History(spark, root, ["dns"], fan=3), []
    for batch in range(6):
        rows = _rows(rng, batch)
        every += rows
        if batch in (2, 5):  # the batch that compacts is interrupted before and after its commit
            history.begin(batch)
            history.land("dns", spark.createDataFrame(rows[:5], "uid string, ts double, note string").withColumn("bucket", F.floor(F.col("ts") / 3600)), 5)
            _land(History(spark, root, ["dns"], fan=3), spark, batch, rows)
        history = History(spark, root, ["dns"], fan=3)
        _land(history, spark, batch, rows)
    everything = sorted({int(t // 3600) for _, t, _ in every})
    assert history.near("dns", everything).count() == len(every) == history.near("dns", everything).dropDuplicates(["uid"]).count()
    assert history.own("dns").count() == 12
    first = everything[0]
    assert history.expire(first + 1) > 0 and history.expire(first + 1) == 0
    left = sum(t >= (first + 1) * 3600 for _, t, _ in every)
    assert history.near("dns", everything).count() == left
    again = History(spark, root, ["dns"], fan=3)  # a replay after the expiry
    _land(again, spark, 5, _rows(random.Random(6), 5))
    assert again.near("dns", everything).count() == left
    empty = History(spark, str(tmp_path / "none"), ["dns"])
    empty.begin(0)
    assert empty.land("dns", spark.createDataFrame([], "uid string, ts double, bucket long"), 0) == []
    empty.commit()
    assert empty.near("dns", [1]) is None and empty.far("dns", spark.createDataFrame([("a",)], "uid string"), []) is None and empty.own("dns") is None

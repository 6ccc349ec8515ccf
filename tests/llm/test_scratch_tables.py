"""Scratch tables are gone as soon as nothing reads them: what an operator leaves on disk is its result."""

import contextlib
import os
import random
import time

import pytest

from netquill.llm import lm_score, near_dedup, suffix_dedup
from netquill.llm.common import drop, importable, let_go, shared_root


def _left(spark, before=()):
    root = shared_root(spark).removeprefix("file://")
    return {n for n in os.listdir(root) if n.startswith("corpus-")} - set(before)


@pytest.fixture(scope="module")
def docs(spark):
    importable(spark)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(20)]
    texts += [texts[0] + " " + texts[1], "x " + texts[2][:400] + " y", texts[3], texts[4] + " more", None, ""]
    return spark.createDataFrame([(i % 24, t) for i, t in enumerate(texts)], "doc_id long, text string").cache()


def _names(paths):
    return sorted(p.removeprefix("corpus-").rsplit("-", 1)[0] for p in paths)


def test_repeated_spans_leaves_its_spans_only(spark, docs):
    before = _left(spark)
    spans = suffix_dedup.repeated_spans(docs)
    assert _names(_left(spark, before)) == ["suffix-spans"]
    assert spans.count() > 0


def test_near_duplicates_leaves_no_sets_or_members(spark, docs):
    before = _left(spark)
    rows = near_dedup.near_duplicates(docs)
    gone = {"near-classes", "near-members", "near-sets", "near-links", "near-roots", "near-placed", "near-candidates", "near-more"}
    assert not gone & set(_names(_left(spark, before)))
    assert rows.count() == docs.count()


def test_lm_scores_leave_their_rows_only_and_do_not_depend_on_turns(spark, docs):
    before = _left(spark)
    rows = [lm_score.score(docs, lm_score.held_fold(), chunk_bytes=2000, turns=n) for n in (1, 3)]
    assert _names(_left(spark, before)) == ["lm-scores", "lm-scores"]
    one, three = (sorted(r.collect(), key=lambda r: (r["doc_id"], r["n_tokens"], r["score"])) for r in rows)
    assert [r[:6] for r in one] == [r[:6] for r in three] and len(one) == docs.count()
    assert [r["score"] for r in one] == pytest.approx([r["score"] for r in three], rel=1e-12)


def _on_disk(spark):
    """Bytes of each shuffle file and scratch table's file."""
    tops = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_root(spark).removeprefix("file://")]
    found = {}
    for top in tops:
        for d, _, names in os.walk(top):
            for n in names:
                if n.startswith("shuffle_") or "/corpus-" in d:
                    with contextlib.suppress(OSError):  # a file may go meanwhile
                        found[f"{d}/{n}"] = os.path.getsize(f"{d}/{n}")
    return found


def test_lm_scores_need_little_disk_and_let_shuffles_go(spark, monkeypatch):
    """Just before a drop, all that its phase made is there: with a row for each word of a chunk that was three times the texts."""
    importable(spark)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9))) for _ in range(40_000)]
    texts = [" ".join(words[min(int(rng.expovariate(1 / 8000)), 39_999)] for _ in range(500)) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    let_go(spark)
    before, used, left = _on_disk(spark), [], []
    new = lambda: {f: n for f, n in _on_disk(spark).items() if f not in before}

    def measured(*args):
        used.append(sum(new().values()))
        drop(*args)
        time.sleep(1)  # files go in the background
        left.append([f for f in new() if "/corpus-" not in f])

    monkeypatch.setattr(lm_score, "drop", measured)
    assert lm_score.score(docs, lm_score.held_fold(), chunk_bytes=1 << 18).count() == len(texts)
    assert len(used) > 4 and max(used) < 2 * sum(map(len, texts))
    assert left == [[]] * len(left)

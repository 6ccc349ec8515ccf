"""Near-duplicate groups: SetSketch registers, banding, likelihood estimate, exact check, components.

1. One pass over the texts makes the set of word shingles of each text, its size, a 128-bit name and its sketch. Texts with the same set
   form a class; from here on a class counts once, however many copies it has.
2. Bands of registers put classes into buckets. Of the buckets with several classes, every class is first compared with one other: the
   bucket leader with which it shares most bands; the leader of a bucket is its class that meets most others in all bands. That links
   most groups.
3. What is left are pairs in a bucket that are not yet connected. They are estimated in blocks, from the sketches, and only pairs whose
   likelihood estimate comes near the threshold leave the block. Pairs that are already connected cannot change a component.
4. Every candidate is confirmed on the full sets. Components are labelled with their smallest id.

The rows of a band follow from the threshold: two sets just on it meet in no band with a probability of 5e-6 at most (0.85: 40 bands of 8,
3e-6; 0.80: 53 bands of 6, 1e-7). The margin of the estimate is four standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.llm import setsketch
from netquill.llm.common import drop, text_chunks, written
from netquill.llm.components import components

#: Members of a bucket that one block compares at a time; larger buckets are cut into pairs of blocks.
BLOCK = 256
_CHUNK_BYTES = 1 << 20


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("text_key"))


def sketched(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n (set size), d1 and d2 (the set's name), sketch; a text without words has n = 0 and no sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                elements, at = setsketch.shingles(data, offsets)
                registers = setsketch.sketches(elements, at)
                n = len(offsets) - 1
                names = [setsketch.digest(elements[at[i] : at[i + 1]]) for i in range(n)]
                yield pa.record_batch(
                    [b.column("doc_id").slice(first, n), b.column("text_key").slice(first, n), pa.array(np.diff(at)), pa.array([x for x, _ in names], pa.int64()),
                     pa.array([x for _, x in names], pa.int64()), pa.array([r.tobytes() if at[i] < at[i + 1] else None for i, r in enumerate(registers)], pa.binary())],
                    ["doc_id", "text_key", "n", "d1", "d2", "sketch"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return _source(docs, key, text).mapInArrow(sketch, f"doc_id {kind}, text_key long, n long, d1 long, d2 long, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """cid and the full set of the classes ``wanted`` (cid, doc_id, text_key), from the texts of their representatives."""
    source = _source(docs, key, text).withColumnsRenamed({"doc_id": "d", "text_key": "t"})
    met = source.join(wanted, (F.col("t") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("doc_id"))).select("cid", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), _CHUNK_BYTES):
                elements, at = setsketch.shingles(data, offsets)
                n = len(offsets) - 1
                yield pa.record_batch([b.column("cid").slice(first, n), pa.array([elements[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())], ["cid", "elements"])

    return met.mapInArrow(shingled, "cid long, elements binary").dropDuplicates(["cid"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, counted on the full sets."""
    met = pairs.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea")), "a")
    met = met.join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb")), "b")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("ea"), b.column("eb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    return met.select("a", "b", "ea", "eb").mapInArrow(counted, "a long, b long")


def _estimated(blocks: DataFrame, least: float, ratio: float, band_rows: int) -> DataFrame:
    """Pairs within a block, of different components, whose sizes and estimate allow the threshold; each pair once. Blocks arrive
    in order."""

    def pairs_of(group: dict) -> tuple[np.ndarray, np.ndarray]:
        side = group["side"]
        if group["same"]:
            i, j = np.triu_indices(len(side), 1)
        else:
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
        n = group["n"]
        fit = (group["component"][i] != group["component"][j]) & (np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]))
        return i[fit], j[fit]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if not rows.num_rows:
                return
            part = {c: rows.column(c).to_numpy() for c in ("bucket", "ci", "cj", "cid", "component", "n", "side")}
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(rows.num_rows, -1)
            edge = np.flatnonzero(np.append(True, (part["bucket"][1:] != part["bucket"][:-1]) | (part["ci"][1:] != part["ci"][:-1]) | (part["cj"][1:] != part["cj"][:-1])))
            found, waiting = [], 0
            for a, z in zip(edge, np.append(edge[1:], rows.num_rows), strict=True):
                group = {c: part[c][a:z] for c in ("component", "n", "side")} | {"same": part["ci"][a] == part["cj"][a]}
                i, j = pairs_of(group)
                found.append((i + a, j + a))
                waiting += len(i)
                if waiting > 20_000 or z == rows.num_rows:
                    i, j = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                    for at in range(0, len(i), 20_000):
                        x, y = i[at : at + 20_000], j[at : at + 20_000]
                        here = setsketch.first_common_band(sketch[x], sketch[y], band_rows) == part["bucket"][x] % setsketch.BANDS_MOST
                        x, y = x[here], y[here]  # a pair counts in one of its buckets only
                        s = setsketch.similarity(sketch[x], sketch[y], part["n"][x].astype(float), part["n"][y].astype(float))
                        x, y = x[s >= least], y[s >= least]
                        p, q = part["cid"][x], part["cid"][y]
                        yield pa.record_batch([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])
                    found, waiting = [], 0

        for b in batches:
            held.append(b)
            rows = pa.Table.from_batches(held).combine_chunks()
            same = rows.num_rows - 1
            keys = [rows.column(c).to_numpy() for c in ("bucket", "ci", "cj")]
            while same > 0 and all(k[same - 1] == k[-1] for k in keys):
                same -= 1
            yield from emit(rows.slice(0, same))  # the last block may go on in the next batch
            held = rows.slice(same).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held).combine_chunks())

    return blocks.mapInArrow(estimate, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, band_rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """Near-duplicate components of word shingle sets with 100 * intersection >= percent * union.

    One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable), kept (doc_id = component_id), text_key and
    representative, which is true for the rows of one text of each component even if ids repeat. A null id is the largest; if all
    ids of a component are null, its id is null and ``kept`` is true for them. A text that is null, empty or without words is linked
    with nothing. Equal sets are linked. Other columns are not read; an empty table gives an empty result.
    """
    band_rows = band_rows or setsketch.rows_for(percent / 100)
    held: dict[str, str] = {}
    rows = written(sketched(docs, key, text), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    classes = rows.filter(F.col("n") > 0).groupBy("d1", "d2").agg(F.min(order).alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    classes = written(classes.sortWithinPartitions("d1", "d2").withColumn("cid", F.monotonically_increasing_id()), "near-classes", held)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                registers = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(part.num_rows, -1)
                hashes = setsketch.band_hashes(registers, band_rows)
                yield pa.record_batch([pa.array(hashes.ravel()), pa.array(np.repeat(part.column("cid").to_numpy(), hashes.shape[1]))], ["bucket", "cid"])

    bands = classes.select("cid", "sketch").mapInArrow(banded, "bucket long, cid long")
    buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    members = written(bands.join(buckets, "bucket"), "near-members", held)
    # a bucket is led by the class that meets most others: in a star of copies, the text they are copies of
    met = members.groupBy("cid").agg(F.sum("size").alias("met"))
    leaders = members.join(met, "cid").groupBy("bucket").agg(F.max(F.struct("met", "cid")).alias("lead")).select("bucket", F.col("lead.cid").alias("leader"))
    inside = members.select("cid").distinct().join(classes.select("cid", "first.doc_id", "first.text_key"), "cid")
    sets = written(_sets(docs, inside, key, text), "near-sets", held)

    led = members.join(leaders, "bucket").filter(F.col("cid") != F.col("leader")).groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("bands"))
    led = led.groupBy("cid").agg(F.max(F.struct("bands", "leader")).alias("best")).select(F.col("cid").alias("a"), F.col("best.leader").alias("b"))
    links = written(_confirmed(led, sets, percent), "near-links", held)
    roots = written(components(links), "near-roots", held)

    placed = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("root", "cid"))
    placed = written(placed.select("bucket", "cid", "size", "component"), "near-placed", held)
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter(F.col("x") < F.col("y")).select("bucket")
    open_rows = placed.join(mixed, "bucket").join(classes.select("cid", "n", "sketch"), "cid")
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("cid"), parts).cast("int")
    open_rows = open_rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    open_rows = open_rows.select(
        "bucket", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj"), "cid", "component", "n",
        (F.col("own") > F.col("other")).cast("int").alias("side"), "sketch",
    )
    blocks = open_rows.repartition("bucket", "ci", "cj").sortWithinPartitions("bucket", "ci", "cj", "cid")
    least = percent / 100 - 4 * float(np.sqrt(percent / 100 * (1 - percent / 100) / setsketch.REGISTERS))
    candidates = written(_estimated(blocks, least, percent / 100, band_rows).distinct(), "near-candidates", held)
    more = written(_confirmed(candidates, sets, percent), "near-more", held)
    stars = roots.filter(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = written(components(stars.unionByName(more)), "near-components")

    grouped = roots.join(classes.select(F.col("cid").alias("node"), "first"), "node").groupBy("root").agg(F.min("first").alias("best"))
    named = roots.join(grouped, "root").select(F.col("node").alias("cid"), "best")
    resolved = classes.join(named, "cid", "left").select("d1", "d2", F.coalesce("best", "first").alias("best"))
    resolved = written(resolved, "near-resolved")
    drop(docs.sparkSession, held, *held)
    out = rows.drop("sketch").join(resolved, ["d1", "d2"], "left")
    alone = F.col("best").isNull()
    own_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (alone | own_best).alias("kept"), "text_key", (alone | (own_best & (F.col("text_key") == F.col("best.text_key")))).alias("representative"),
    )


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that represent their component in :func:`near_duplicates`, all columns as they are."""
    stay = near_duplicates(docs, key, text, **options).filter("representative").select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__t")).distinct()
    boxed = docs.select(F.struct("*").alias("__row"), F.col(key).alias("__key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__text_key"))
    rows = boxed.join(written(stay, "near-stay"), (F.col("__text_key") == F.col("__t")) & F.col("__key").eqNullSafe(F.col("__d")), "left_semi")
    return rows.select(*(F.col("__row")[c].alias(c) for c in docs.columns))

"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; then the
names of adjacent blocks are paired, the distinct pairs are sorted and numbered, and so on until one name is left of
each text. Two texts of the same number of blocks have the same last name exactly when they are equal byte by byte:
names are given to contents, not to hash values. A hash only routes a block to its name; where one hash value stands
for several contents, the contents themselves are joined.

Only DataFrame functions; the text is shuffled once, after equal blocks of a task have been combined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquill.llm.common import row_key, written

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _blocks(norm: Column, block_bytes: int) -> Column:
    raw = norm.cast("binary")
    count = F.greatest(F.ceil(F.octet_length(norm) / F.lit(block_bytes)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw, i * F.lit(block_bytes) + F.lit(1), F.lit(block_bytes)))


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Names for distinct rows: they are sorted within their partition and numbered in that order, so a repeated task gives
    the same names; the table is written before it is used."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, n_points, text_sha256 and the identity (n_blocks, name) of its normalised text."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = source.withColumn("norm", normalised(F.col("text")))
    k1, k2 = row_key(F.col("key"), F.col("text"))
    rows = written(
        source.select(
            "key", k1.alias("k1"), k2.alias("k2"), F.length("text").cast("long").alias("n_points"),
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(F.col("norm"), block_bytes), lambda b: F.xxhash64(b)).alias("hashes"),
        ).withColumn("n_blocks", F.size("hashes")),
        "exact-rows",
    )

    blocks = source.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block")).withColumn("h", F.xxhash64("block"))
    contents = blocks.groupBy("h").agg(F.collect_set("block").alias("contents"))
    contents = contents.select("h", F.size("contents").alias("n"), F.explode("contents").alias("block"))
    names = written(
        _numbered(contents, "block").select("h", "name", F.when(F.col("n") > 1, F.col("block")).alias("block")), "exact-names"
    )

    handles = rows.groupBy("k1", "k2", "n_blocks").agg(F.first("hashes").alias("hashes"))  # repeated rows once
    hashes = handles.select("k1", "k2", "n_blocks", F.posexplode("hashes").alias("pos", "h"))
    alone = names.filter(F.col("block").isNull()).select("h", "name")
    level = hashes.join(alone, "h").select("k1", "k2", "n_blocks", "pos", "name")
    shared = names.filter(F.col("block").isNotNull())
    if not shared.isEmpty():  # one hash value for several contents: join the contents themselves
        exact = source.select(
            *(c.alias(n) for c, n in zip(row_key(F.col("key"), F.col("text")), ("k1", "k2"), strict=True)),
            F.posexplode(_blocks(F.col("norm"), block_bytes)).alias("pos", "block"),
        ).withColumn("h", F.xxhash64("block")).join(shared, ["h", "block"])
        exact = exact.join(handles.select("k1", "k2", "n_blocks"), ["k1", "k2"])
        level = level.unionByName(exact.select("k1", "k2", "n_blocks", "pos", "name").distinct())
    level = written(level, "exact-level")

    longest = rows.agg(F.max("n_blocks")).first()[0] or 1
    done = level.filter(F.col("n_blocks") == 1).select("k1", "k2", "n_blocks", "name")
    for depth in range(1, math.ceil(math.log2(longest)) + 1 if longest > 1 else 1):
        open_rows = level.filter(F.col("n_blocks") > 2 ** (depth - 1))
        even = F.col("pos") % 2 == 0
        pairs = open_rows.groupBy("k1", "k2", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = written(pairs, f"exact-pairs{depth}")
        pair_names = written(_numbered(pairs.select("a", "b").distinct(), "a", "b"), f"exact-pair-names{depth}")
        level = written(pairs.join(pair_names, ["a", "b"]).select("k1", "k2", "n_blocks", "pos", "name"), f"exact-level{depth}")
        ended = (F.col("n_blocks") > 2 ** (depth - 1)) & (F.col("n_blocks") <= 2**depth)
        done = done.unionByName(level.filter(ended).select("k1", "k2", "n_blocks", "name"))
    return rows.drop("hashes").join(done, ["k1", "k2", "n_blocks"])


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Group rows whose texts are equal without the white space of [\\x20\\x09-\\x0D].

    Returns one row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), the
    identity (n_blocks, name), the row key (k1, k2) and representative, which is true for the rows of one text of each group. Of a group, the row with the most code points stays, then the smallest id; a null id is the
    largest. A null text is empty, and all empty texts are one group. Rows that repeat an id within a group count in
    group_size and are kept or dropped together. Other columns of ``docs`` are not read, so their names cannot clash.
    An empty table gives an empty result. ``name`` differs between runs; whether two names are equal does not.
    """
    named = written(identities(docs, key, text, block_bytes), "exact-named")
    groups = named.groupBy("n_blocks", "name").agg(
        F.min(F.struct(-F.col("n_points"), F.col("key").isNull(), F.col("key"), F.col("k1"), F.col("k2"))).alias("best"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups.select("n_blocks", "name", "group_size", F.col("best.key").alias("keep_id"), F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2")), "exact-groups")
    return named.join(groups, ["n_blocks", "name"]).select(
        F.col("key").alias("doc_id"), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", "n_blocks", "name", "k1", "k2", ((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))).alias("representative"),
    )


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each group of :func:`exact_duplicates`, all columns as they are; of rows equal in id and text, one."""
    stay = exact_duplicates(docs, key, text, **options).filter("representative").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = row_key(F.col(key), F.coalesce(F.col(text), F.lit("")))
    boxed = docs.select(F.struct("*").alias("__row"), k1.alias("__k1"), k2.alias("__k2"))
    rows = boxed.join(written(stay, "exact-stay"), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return rows.select(*(F.col("__row")[c].alias(c) for c in docs.columns))

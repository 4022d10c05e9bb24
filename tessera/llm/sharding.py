"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every document gets a global row number (its place in a fixed hash order), the number is
permuted, and shard and slot follow from the permuted number by arithmetic alone, so a
reader can compute where any row went, or which row a slot holds, without an index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, written

#: Buckets of the two-step row numbers: a fixed bound, so their counts may be broadcast.
BUCKETS = 1 << 14
ROUNDS = 6
#: Equal rows that one row is made into at once.
STRETCH = 1 << 16


def sides(total: int) -> tuple[int, int]:
    """a * b >= total, and fewer than a numbers lie outside the range."""
    a = max(1, math.isqrt(max(total, 1)))
    return a, -(-max(total, 1) // a)


def _round(left: Column, right: Column, number: int, seed: int, modulus: int) -> Column:
    return F.pmod(left + F.pmod(F.xxhash64(F.lit(seed * 64 + number), right), F.lit(modulus)), F.lit(modulus))


def _once(row: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network on the pair (row div b, row mod b), as a column."""
    state = F.struct(F.floor(row / F.lit(b)).cast("long").alias("l"), F.pmod(row, F.lit(b)).alias("r"))
    for number in range(ROUNDS):
        # a one-element array binds the state, so that the rounds are not expanded into each other
        state = F.get(
            F.transform(
                F.array(state),
                (lambda s, n=number: F.struct(_round(s["l"], s["r"], n, seed, a).alias("l"), s["r"].alias("r")))
                if number % 2 == 0
                else (lambda s, n=number: F.struct(s["l"].alias("l"), _round(s["r"], s["l"], n, seed, b).alias("r"))),
            ),
            F.lit(0),
        )
    return F.get(F.transform(F.array(state), lambda s: s["l"] * F.lit(b) + s["r"]), F.lit(0))


def permuted(row: Column, total: int, seed: int) -> Column:
    """The row's image: a permutation of 0 .. total - 1.

    The network permutes 0 .. a*b - 1. A number that leaves the range walks on along its
    cycle; fewer than a numbers lie outside, so at most a*b - total further passes bring it
    back. Only about one row in sqrt(total) walks at all.
    """
    a, b = sides(total)
    outside = a * b - total
    first = _once(row, a, b, seed)
    if not outside:
        return first
    walk = lambda x: F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)), x, lambda at, _: F.when(at < total, at).otherwise(_once(at, a, b, seed))
    )
    return F.get(F.transform(F.array(first), lambda x: F.when(x < total, x).otherwise(walk(x))), F.lit(0))


def row_numbers(groups: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Groups of equal rows (bucket, n and the columns of ``order``) made into rows with ``row`` (0, 1, ...) in the order of bucket
    and ``order``, and the row count.

    Counts per bucket are combined map-side and summed over the fixed number of buckets; groups are then numbered inside
    their bucket. A group is one row until it is made into its rows, stretch by stretch, so no task sees more than the different
    rows of a bucket.
    """
    counts = written(groups.groupBy("bucket").agg(F.sum("n").alias("rows")), "bucket-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = groups.withColumn("first", inside).join(F.broadcast(offsets), "bucket").withColumn("first", F.col("offset") + F.col("first"))
    large = F.col("n") > STRETCH
    starts = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(STRETCH).cast("long"))).alias("start")
    rows = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + STRETCH, F.col("first") + F.col("n")) - 1)).alias("row")
    small = first.where(~large).select(*order, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("row"))
    # the stretches of a large group are dealt over the tasks
    parts = first.where(large).select(*order, "first", "n", starts).repartition("start")
    return small.unionByName(parts.select(*order, rows)), total


def shard(docs: DataFrame, shards: int = 40, seed: int = 20) -> DataFrame:
    """Deal all documents into ``shards`` shards under the law ``rows`` (counts at most one apart).

    Columns: doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32 (unsigned, of the
    UTF-8 bytes; null like empty: 0), law, shard, slot (gapless from 0 in each shard), grown_shard (null:
    the law is not ``key``), row (the global row number). Other columns of ``docs`` are not read. Rows that agree in id, size and
    checksum are interchangeable: they are counted before the shuffle and each gets a place of its own, so neither a repeated row nor a
    repeated id gathers in a task. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    groups = slim.groupBy(*order).agg(F.count("*").alias("n"))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)))
    numbered, total = row_numbers(groups, order)
    place = permuted(F.col("row"), total, seed)
    return numbered.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), shards=40)


QUERIES = {"op3_sharding": query}
ORACLE_SQL: dict[str, str] = {}

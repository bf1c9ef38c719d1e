"""Reproducible shuffled shards: a Feistel permutation, with cycle walking, of global row numbers.

Rows are numbered in the order of a hash of their id, text checksum and size, by counts of hash buckets and row
numbers inside each, so no task orders all rows.  The permuted number p of a row gives its place at once:
shard = p mod shards and slot = p div shards.  Shard counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.rows import packed
from lodestone.plans.materialize import cut

BUCKET_BITS = 12
ROUNDS = 6
#: Walks after which a permuted number lies below n for certain (n up to 400) or with all but (2 / sqrt(n)) ** 48.
WALKS = 48


def feistel(x: Column, n: int, seed: int = 9) -> Column:
    """The image of x in a permutation of 0 .. n-1.

    The network permutes side * side numbers, side = ceil(sqrt(n)): one half is moved by a hash of the other,
    modulo side, in each round.  Fewer than 2 * sqrt(n) + 1 numbers lie outside 0 .. n-1; from these the walk goes
    on along its cycle, which returns below n.
    """
    side = max(1, math.isqrt(max(n, 1) - 1) + 1)
    turns = F.sequence(F.lit(1), F.lit(ROUNDS))

    def permuted(v: Column) -> Column:
        halves = F.struct(F.floor(v / side).cast("long").alias("l"), F.pmod(v, F.lit(side).cast("long")).alias("r"))
        moved = lambda s, i: F.struct(s.r.alias("l"), F.pmod(s.l + F.pmod(F.xxhash64(s.r, i, F.lit(seed)), F.lit(side).cast("long")), F.lit(side).cast("long")).alias("r"))
        return F.aggregate(turns, halves, moved, lambda s: s.l * F.lit(side).cast("long") + s.r)

    first = permuted(x.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda v, _: F.when(v < n, v).otherwise(permuted(v)))


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", keep: bool = True, seed: int = 9) -> DataFrame:
    """docs (all columns as one struct `row`, if keep) with size, text_crc32, shard and slot.

    The size is the text's UTF-8 bytes plus 16, a null text counting as empty.  Equal rows get neighbouring
    numbers, so they are interchangeable and a rerun gives the same table whatever the partitioning.  Null ids
    take part like any other.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carried = [packed(docs)] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *carried)
    rows = rows.withColumn("h", F.xxhash64("id", "text_crc32", "size", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int"))
    if not keep:
        rows = cut(rows, "sharding-rows")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("c"))
    ahead = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("offset", F.coalesce(F.sum("c").over(ahead), F.lit(0))), "sharding-counts")  # 4096 rows at most
    n = counts.agg(F.sum("c")).first()[0] or 0
    inside = Window.partitionBy("bucket").orderBy("h", "id", "text_crc32", "size")
    numbered = rows.withColumn("i", F.row_number().over(inside) - 1).join(F.broadcast(counts.select("bucket", "offset")), "bucket")
    placed = numbered.withColumn("p", feistel(F.col("i") + F.col("offset"), n, seed))
    out = placed.withColumn("shard", (F.col("p") % shards).cast("int")).withColumn("slot", F.floor(F.col("p") / shards).cast("long"))
    return out.select("id", *(["row"] if keep else []), "size", "text_crc32", "shard", "slot")


def op9_feistel_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard and slot of each document among 40 shards."""
    placed = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=False)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Sharding by weighted rendezvous hashing.

Each (record key, shard) pair draws a cost from an exponential distribution whose rate is the shard's weight;
the shard of least cost takes the record. A shard gets records in proportion to its weight, and one more
shard takes records only into itself, since no other cost changes. No table of records is kept anywhere.

Nulls: a null key is a key like any other. Equal keys always share a shard. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Groups of a shard within which slots are numbered; their counts, at most shards * SLOT_GROUPS rows, are broadcast.
SLOT_GROUPS = 1024


def _draw(keys: Sequence[str], shard: int, weight: float) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.ln(uniform) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))


def rendezvous(keys: Sequence[str], weights: Sequence[float]) -> Column:
    """The shard, from 0, of the record with these key columns; weights has one positive number a shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    draws = [_draw(keys, i, w) for i, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def numbered(df: DataFrame, shard: str, keys: Sequence[str], order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Adds gapless slots from 0 within each shard without bringing a whole shard to one task.

    Rows are grouped by shard and key hash; each group starts where the counts of the groups before it end.
    """
    grouped = df.withColumn("_group", F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(SLOT_GROUPS)))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        grouped.groupBy(shard, "_group")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(shard, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy(shard, "_group").orderBy(*order)
    placed = grouped.withColumn("_at", F.row_number().over(within).cast("long") - 1)
    return (
        placed.join(F.broadcast(starts), [shard, "_group"])
        .withColumn(slot, F.col("_start") + F.col("_at"))
        .drop("_group", "_start", "_at")
    )


def sharded(df: DataFrame, keys: Sequence[str], weights: Sequence[float], added: float | None = None) -> DataFrame:
    """df with shard, and with grown_shard if added, the weight of one more shard, is given. df must have neither column."""
    out = df.withColumn("shard", rendezvous(keys, weights))
    return out if added is None else out.withColumn("grown_shard", rendezvous(keys, [*weights, added]))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight, and over 25."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    out = numbered(sharded(docs, ["doc_id"], [1.0] * 24, 1.0), "shard", ["doc_id"], ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Every source shuffles its documents by a hash of their key. A document's virtual finish time is the running sum of
its source's sizes, itself included, divided by the source's target; its k-th repeat comes k whole sources later.
All items are sorted by finish time, globally by range, and taken up to the total budget. Sources advance at rates in
proportion to their targets, so each source ends within one document of its target.

Nulls: a null source is a source, the last one; a null text has size 0 and takes nothing. Rows equal in key and
source are items of their own; ties in finish time go by source, then by shuffled order. With a budget of 0, as if all
texts are empty, or no rows, nothing is taken. A very long text is one item, so a source may end short of its target by
as much. Only the named columns are read; the stage carries all others through whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, matched, packed, parallelism, row_key, staged, table, unpacked

#: Weights of the sources in order of their names, repeating, and the most times a document is taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Leading hexadecimal digits of the shuffle key that group a source's documents for running sums.
DIGITS = 3
#: Items that a range of the global sort has at most, about.
RANGE_ITEMS = 1_000_000
#: Sources up to which their table is broadcast, a few dozen bytes each.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: the sum of all sizes shared by weight, no source above most times its size.

    The share that each unit of weight gets is the largest of the levels that result if the k sources with the
    smallest caps per weight are at their caps; all sources' rows are few.
    """
    by_name, n = Window.orderBy(F.col("source").asc_nulls_last()), len(weights)
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    s = s.withColumn("_weight", weight).withColumn("_cap", (F.col("source_size") * most).cast("double"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("_weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("_level", F.max((F.sum("source_size").over(everything) - F.col("_capped")) / F.col("_rest")).over(everything))
    return s.select("source", "source_size", F.least("_cap", F.col("_level") * F.col("_weight")).alias("target"))


def _cut(items: DataFrame, budget: int) -> tuple | None:
    """The first (finish, source, order) left out if items, sorted so, are taken while the sum of their sizes is at most budget.

    The items are sorted globally by range; the ranges' sums, few, tell in which the budget ends, and a running sum there tells where.
    """
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("order")]
    n = max(parallelism(items.sparkSession), -(-items.count() // RANGE_ITEMS))
    ranged = items.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("n"))
    run = sums.withColumn("upto", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)))
    over = run.where(F.col("upto") > budget).orderBy("range").first()
    if over is None:
        return None
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = ranged.where(F.col("range") == over["range"]).withColumn("upto", F.sum("size").over(inside) + (over["upto"] - over["n"]))
    first_out = last.where(F.col("upto") > budget).orderBy(*order).first()
    return None if first_out is None else (first_out["finish"], first_out["source"], first_out["order"])


def mixed(docs: DataFrame, size: Column, keys: Sequence[str], weights: Sequence[float] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """keys, size, source, source_size, target, copies and taken (copies * size) of every row of docs, which has a source column.

    keys name the columns that identify a document; with seed they decide its place in its source's shuffled order.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys)))
    sizes = staged(docs.select(*keys, "source", size.cast("long").alias("size"), order.alias("order")), "sizes")
    targets = staged(source_targets(sizes, weights, most), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    budget = int(sizes.agg(F.sum("size")).first()[0] or 0)

    sizes = sizes.withColumn("_group", F.substring("order", 1, DIGITS))
    earlier = Window.partitionBy("source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.groupBy("source", "_group").agg(F.sum("size").alias("_n"))
    starts = starts.select("source", "_group", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    upto = Window.partitionBy("source", "_group").orderBy("order", "size", *keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("_within", F.sum("size").over(upto))
    placed = matched(placed, starts, ["source", "_group"]).withColumn("upto", F.col("_start") + F.col("_within"))
    placed = matched(placed, F.broadcast(targets) if few else targets, ["source"])
    placed = staged(placed.select(*keys, "source", "size", "order", "source_size", "target", "upto"), "queue")

    finish = [F.try_divide((F.col("source_size") * k + F.col("upto")).cast("double"), F.col("target")) for k in range(most)]
    items = placed.where("size > 0").select("source", "order", "size", F.explode(F.array(*finish)).alias("finish")).where("finish < 2.0")
    cut = _cut(items, budget) if budget else None

    def taken(at: Column) -> Column:
        if cut is None:
            return (at < 2.0) & F.lit(budget > 0)
        f, s, o = cut
        source = F.col("source")
        earlier_source = (source < F.lit(s)) if s is not None else source.isNotNull()
        earlier_source = F.coalesce(earlier_source, F.lit(False))
        return (at < f) | ((at == f) & (earlier_source | (source.eqNullSafe(F.lit(s)) & (F.col("order") < F.lit(o)))))

    copies = sum((F.when(taken(at), 1).otherwise(0) for at in finish[1:]), F.when(taken(finish[0]), 1).otherwise(0))
    out = placed.withColumn("copies", copies)
    return out.select(*keys, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1, each taken three times at most, within the size of all."""
    return mixed(table(spark, sf_dir, "documents"), words_of("text"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Documents that are equal in id and text are taken equally often."""
    needed = ("doc_id", "text", "source")
    keyed = packed(docs, *needed).withColumn("_key", row_key("doc_id", "text"))
    copies = mixed(keyed, words_of("text"), ["doc_id", "_key"]).groupBy("doc_id", "_key").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    out = matched(keyed, copies, ["doc_id", "_key"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*unpacked(docs.columns, *needed))


_WORDS_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
ORACLE_OP5 = rf"""
WITH sizes AS (SELECT doc_id, source, CAST({_WORDS_SQL} AS BIGINT) AS size,
                      md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS weight,
             CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max((tot - capped) / rest) FROM l, (SELECT sum(source_size) AS tot FROM s))) AS target FROM l),
q AS (SELECT z.*, t.source_size, t.target,
             CAST(sum(size) OVER (PARTITION BY z.source ORDER BY ord, size, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
items AS (SELECT doc_id, size, source, ord, CAST(source_size * k + upto AS DOUBLE) / target AS finish
          FROM q, range(3) r(k) WHERE size > 0),
taken AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, ord ROWS UNBOUNDED PRECEDING) AS run FROM items),
n AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM taken WHERE run <= (SELECT sum(size) FROM sizes) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(n.taken, 0) AS taken FROM q LEFT JOIN n USING (doc_id)
"""

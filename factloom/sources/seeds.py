"""Seeds: files of assertions that name one another by refs, loaded in the order of their supersessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.writes import Store
from .tables import joined, looked_up

ASSERTION = "ref string, supersedes_ref string, scope string, subject string, predicate string, value double, kind string, confidence string, source string, human string, why string, reopen_if string, verification_id long, derived_from array<long>, valid_from timestamp_ntz, valid_to timestamp_ntz, is_verifier boolean"
SEED = f"assertions array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in ASSERTION.split(', '))}>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The assertions of a seed file (one JSON object), with place, their order in it. Those that name no class are unverified."""
    rows = spark.read.schema(SEED).option("multiLine", "true").json(path).select(F.posexplode("assertions").alias("place", "a")).select("place", "a.*")
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit("unverified"))).withColumn("is_verifier", F.coalesce("is_verifier", F.lit(False)))


class Cycle(ValueError):
    """Rows that supersede one another in a circle."""


def layered(rows: DataFrame) -> DataFrame:
    """rows (ref, supersedes_ref, place) with layer: how many rows of the seed come before in their chain; and orphan, the ref on it that no row has.

    Of rows with one ref the last counts. Chains are followed by doubling, in log2 of the longest; what still has a way
    to go after so many rounds that all rows would be passed goes in a circle, and its refs are told.
    """
    last = Window.partitionBy("ref").orderBy(F.desc("place"))
    own = F.coalesce(F.col("supersedes_ref") == F.col("ref"), F.lit(False))  # a row cannot supersede itself
    up = F.when(~own, F.col("supersedes_ref"))
    named = rows.where("ref IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("ref", "place", up.alias("up"))
    step = named.select(F.col("ref").alias("next"), F.col("up").alias("_up"), F.lit(1).cast("long").alias("_hops"))
    p = rows.select("place", up.alias("next"), F.lit(0).cast("long").alias("layer"), F.when(own, F.col("ref")).alias("orphan")).checkpoint()
    n, rounds = p.count(), 0
    while not p.where("next IS NOT NULL").isEmpty():
        if 1 << rounds > 2 * n:
            circle = [r["next"] for r in p.where("next IS NOT NULL").select("next").distinct().orderBy("next").limit(20).collect()]
            raise Cycle(f"seed has a supersession cycle at refs {circle}")
        q = looked_up(p, step, "next")
        met = F.col("_hops").isNotNull()
        p = q.select("place", F.when(met, F.col("_up")).alias("next"), (F.col("layer") + F.coalesce("_hops", F.lit(0))).alias("layer"), F.when(F.col("next").isNotNull() & ~met, F.col("next")).otherwise(F.col("orphan")).alias("orphan")).checkpoint()
        on = step.select(F.col("next").alias("_up"), F.col("_up").alias("_up2"), F.col("_hops").alias("_hops2"))
        step = looked_up(step, on, "_up").select("next", F.when(F.col("_hops2").isNull(), F.col("_up")).otherwise(F.col("_up2")).alias("_up"), (F.col("_hops") + F.coalesce("_hops2", F.lit(0))).alias("_hops")).checkpoint()
        rounds += 1
    return joined(rows, p.select("place", "layer", "orphan"), "place")


@dataclass
class Report:
    """rows: place, ref, subject, predicate, kind, confidence, id and reason (null: loaded) of every row."""

    rows: DataFrame

    def loaded(self) -> int:
        return self.rows.where("reason IS NULL").count()

    def skipped(self) -> DataFrame:
        return self.rows.where("reason IS NOT NULL").select("subject", "predicate", "reason")

    def by(self, column: str) -> DataFrame:
        return self.rows.where("reason IS NULL").groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def load(store: Store, rows: DataFrame, name: str, first_id: int) -> Report:
    """Loads a seed's rows, layer after layer, each a batch of the store named by name and layer, so a load that broke off goes on where it was.

    A row's id is first_id + place. A row that is on record already counts as loaded, and its successors supersede the
    row on record. A row whose ref was not loaded is skipped and says so; what the store refuses is skipped for its reason.
    """
    rows = layered(rows).withColumn("id", F.col("place").cast("long") + first_id).checkpoint()
    depth = rows.agg(F.max("layer")).first()[0]
    done = None
    for layer in range((depth if depth is not None else -1) + 1):  # the longest chain of supersessions in the file
        mine = rows.where(F.col("layer") == layer)
        if done is None:
            mine = mine.withColumn("supersedes", F.lit(None).cast("long"))
        else:
            last = Window.partitionBy("ref").orderBy(F.desc("place"))
            known = done.where("reason IS NULL AND ref IS NOT NULL").withColumn("_n", F.row_number().over(last)).where("_n = 1").select(F.col("ref").alias("supersedes_ref"), F.col("loaded_id").alias("supersedes"))
            mine = joined(mine, known, "supersedes_ref", "left").checkpoint()
        missing = F.col("supersedes_ref").isNotNull() & F.col("supersedes").isNull()
        lost = mine.where(missing).withColumn("reason", F.concat(F.lit('supersedes_ref "'), "supersedes_ref", F.lit('" was not loaded'))).withColumn("loaded_id", F.lit(None).cast("long"))
        batch = mine.where(~missing)
        said = store.append(batch.drop("layer", "orphan", "ref", "supersedes_ref", "place"), f"{name}-{layer}")
        told = joined(batch, said.select("id", "reason", F.coalesce("existing", "id").alias("loaded_id")), "id")
        keep = ["place", "ref", "subject", "predicate", "kind", "confidence", "loaded_id", "reason"]
        both = told.select(*keep).unionByName(lost.select(*keep))
        done = (both if done is None else done.unionByName(both)).checkpoint()
    if done is None:
        done = rows.select("place", "ref", "subject", "predicate", "kind", "confidence", F.col("id").alias("loaded_id"), F.lit(None).cast("string").alias("reason"))
    return Report(done.withColumnRenamed("loaded_id", "id"))

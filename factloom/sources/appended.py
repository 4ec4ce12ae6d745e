"""Append-only tables whose batches land once, by name: verifications, preferences, activity, missions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .log import Conflict, Log


class Appended:
    """A table of Parquet folders that a log of commits names. A batch is written first and then committed, so readers see all of it or nothing."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.log, self.schema = spark, Log(spark, folder), schema

    def _read(self, commits: list[dict]) -> DataFrame:
        paths = [c["folder"] for c in commits]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        return self._read(self.log.commits())

    def batch(self, name: str) -> DataFrame | None:
        """The rows of a batch, None if there is no such batch."""
        mine = [c for c in self.log.commits() if c["batch"] == name]
        return self._read(mine) if mine else None

    def append(self, rows: DataFrame | Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
        """Appends a batch and returns its rows. One whose name is there already comes back as it was stored.

        rows: the batch, or how it follows from the table as it is. If another writer commits first, the batch is made
        anew from what is there then.
        """
        while True:
            log = self.log.commits()
            if any(c["batch"] == name for c in log):
                return self.batch(name)
            new, folder = rows(self._read(log)) if callable(rows) else rows, self.log.new_folder()
            fields = self.spark.createDataFrame([], self.schema).schema.fields
            new.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.parquet(folder)
            try:
                self.log.commit({"version": len(log) + 1, "batch": name, "folder": folder})
            except Conflict:
                self.log.remove(folder)


def in_force(rows: DataFrame) -> DataFrame:
    """rows (id, supersedes) that no other row supersedes."""
    return rows.join(rows.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")), "id", "left_anti")


def numbered(rows: DataFrame, order: str, column: str, first: int) -> DataFrame:
    """rows with column, the numbers from first on in the order of a column without ties, null in no row.

    Ranges of the order are numbered each for itself; only their sizes, one a range, meet in one task.
    """
    parts = rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return parts.withColumn("_place", place).join(F.broadcast(starts), "_part").withColumn(column, (F.col("_before") + F.col("_place") - 1 + first).cast("long")).drop("_part", "_place", "_before")

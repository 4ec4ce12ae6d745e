"""Prose files as a source: found below folders, chosen within a budget of bytes, read as lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions of prose.
EXTENSIONS = (".md", ".markdown", ".mdx", ".txt", ".rst")
#: Files that a range of the choice holds about.
RANGE = 100_000


def found(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """path and size of the prose files below roots (folders, or files), each once however many roots reach it. No content is read."""
    out = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
        out = files if out is None else out.unionByName(files)
    ends = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    return out.where(ends.isin(*extensions)).dropDuplicates(["path"])


def chosen(files: DataFrame, budget: int, each: int = RANGE) -> DataFrame:
    """The files (path, size) that a walk in the order of path takes: each that fits in what is left of budget bytes; one that does not is passed over and the walk goes on, until nothing is left.

    What a walk does to a range of paths hangs on the bytes left where it comes in, one number. Files are dealt to
    ranges of paths; a range is walked in one task, and its number goes to the next. Ranges that cannot take anything
    (all files larger than what is left) are not walked.
    """
    spark = files.sparkSession
    n = files.count()
    if not n or budget <= 0:
        return files.limit(0)
    ranges = files.repartitionByRange(-(-n // each), "path").withColumn("_range", F.spark_partition_id()).checkpoint()
    least = {r["_range"]: r["least"] for r in ranges.groupBy("_range").agg(F.min("size").alias("least")).collect()}  # a number a range
    fields = [f for f in files.schema.fieldNames()]

    def walk(left: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = left
            for batch in batches:
                keep = []
                for size in batch["size"].to_pylist():
                    fits = rest > 0 and size is not None and size <= rest
                    rest -= size if fits else 0
                    keep.append(fits)
                yield pa.RecordBatch.from_arrays(batch.columns, batch.schema.names).filter(pa.array(keep, pa.bool_()))

        return run

    out = spark.createDataFrame([], files.schema)
    for k in sorted(least):
        if budget <= 0:
            break
        if least[k] is None or least[k] > budget:
            continue
        mine = ranges.where(F.col("_range") == k).drop("_range").coalesce(1).sortWithinPartitions("path")
        taken = mine.select(*fields).mapInArrow(walk(budget), files.schema).checkpoint()
        budget -= taken.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        out = out.unionByName(taken)
    return out


def lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path, line (from 1) and text of the lines of files (path), split at line ends of either kind. Only these files are opened, each by one task; what is no UTF-8 is passed over."""
    paths = [r["path"] for r in files.select("path").collect()]  # as many as the budget took
    if not paths:
        return spark.createDataFrame([], "path string, line long, text string")
    rows = spark.read.format("binaryFile").load(paths).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text IS NOT NULL")
    return rows.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).select("path", (F.col("line") + 1).cast("long").alias("line"), "text")

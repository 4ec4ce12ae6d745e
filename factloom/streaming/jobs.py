"""The polling jobs of a fact store as Structured Streaming jobs over appended files.

A job has a name. It runs what has arrived since its last run (availableNow) and keeps its progress and its result in
the shared checkpoint folder under that name, so a second run delivers only what is new. Each batch is a folder of the
result, which a batch that is run again replaces.
"""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a local one is set in a local session, for tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not context.getCheckpointDir():
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = folder or tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(folder)
    return folder


def job_name(kind: str, path: str) -> str:
    """The name of the job of a kind over a path."""
    return f"{kind}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def appended(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the rows of Parquet files: a folder's, or one file's; files: how many a batch takes at most."""
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    folder, _, name = path.rpartition("/")
    one = there.inputFiles()[0].split("/")[-1] == name
    return reader.option("pathGlobFilter", name if one else "*.parquet").parquet(folder if one else path)


def _run(stream: DataFrame, job: str, schema: str, each=None, mode: str = "append") -> DataFrame:
    """Runs a job on what is new; each turns a batch and the result so far into what the batch adds. The result of all runs."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/jobs/{job}"

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if each is not None:
            before = own.read.schema(f"{schema}, batch long").option("basePath", f"{out}/rows").parquet(f"{out}/rows").where(F.col("batch") < number) if number else own.createDataFrame([], f"{schema}, batch long")
            batch = each(batch, before.drop("batch"))
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/progress").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{out}/rows").parquet(f"{out}/rows")


def outbox(spark: SparkSession, path: str, job: str | None = None, files: int | None = None) -> DataFrame:
    """A message (seq, topic, scope) for every appended assertion, delivered once over all runs."""
    rows = appended(spark, path, files).select(F.col("event_id").alias("seq"), F.lit("assertion.created").alias("topic"), (F.col("user_id") % 3).alias("scope"))
    return _run(rows, job or job_name("outbox", path), "seq long, topic string, scope long").drop("batch")


def unconsumed(messages: DataFrame, consumed: DataFrame) -> DataFrame:
    """Messages without an acknowledgement (seq)."""
    return messages.join(consumed.select("seq"), "seq", "left_anti")


def once_per_occasion(spark: SparkSession, path: str, job: str | None = None) -> DataFrame:
    """Feedback (actor, signature, occasion), each once for ever, however late or often it arrives: keys are kept as a table and each batch adds those that it lacks."""
    key = ["actor", "signature", "occasion"]
    rows = appended(spark, path).select(F.col("user_id").alias("actor"), F.col("event_type").alias("signature"), F.to_date("ts").alias("occasion"))
    return _run(rows, job or job_name("feedback", path), "actor long, signature string, occasion date", lambda batch, before: batch.dropDuplicates(key).join(before, key, "left_anti")).drop("batch")


def tallies(spark: SparkSession, path: str, job: str | None = None) -> DataFrame:
    """Per signature the feedback events and people so far. Batches add their counts a person; what is read sums them up."""
    rows = appended(spark, path).select(F.col("event_type").alias("signature"), F.col("user_id").alias("actor"))
    each = lambda batch, _: batch.groupBy("signature", "actor").agg(F.count(F.lit(1)).alias("n"))
    parts = _run(rows, job or job_name("tallies", path), "signature string, actor long, n long", each)
    return parts.groupBy("signature").agg(F.sum("n").alias("events"), F.countDistinct("actor").alias("humans"))


def attempts(spark: SparkSession, path: str, span: int = 900, step: int = 300, job: str | None = None) -> DataFrame:
    """Attempts of each user in sliding windows of span seconds that begin every step seconds. However late a row arrives, it counts: batches add their counts a window and what is read sums them up."""
    rows = appended(spark, path).select("user_id", "ts")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    last = at - at % step
    starts = F.transform(F.sequence(F.lit(0), F.lit(span // step - 1)), lambda k: F.timestamp_seconds(last - k * step).cast("timestamp_ntz"))
    each = lambda batch, _: batch.select("user_id", F.explode(starts).alias("start")).groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"))
    parts = _run(rows, job or job_name("attempts", path), "user_id long, start timestamp_ntz, n long", each)
    return parts.groupBy("user_id", "start").agg(F.sum("n").alias("n"))

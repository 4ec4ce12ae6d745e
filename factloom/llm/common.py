"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as Java and RE2 regular expressions read them.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one in a local session, as in tests; on a cluster an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: its lineage ends there, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str | Column) -> Column:
    """A 64-bit key of a row's contents; never null. Equal rows share it. Rows are joined on it together with their id."""
    return F.xxhash64(*columns)


def wide_key(*columns: str | Column) -> Column:
    """A 128-bit key of a row's contents, of two hashes from different seeds; never null. Equal rows share it."""
    return F.struct(F.xxhash64(*columns).alias("h"), F.xxhash64(F.lit(1), *columns).alias("g"))


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys among which null equals null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys]
    out = left.join(right, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_r_{k}" for k in keys))


#: Rows of a few numbers each that a task of a table of known length has at least.
TASK_ROWS = 200_000


def sized(df: DataFrame, n: int) -> DataFrame:
    """df of about n narrow rows in as many tasks as these need, the cluster's cores at least, where it would have more."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held(df: DataFrame, *columns: str) -> DataFrame:
    """df, its columns named here computed once: filters above do not move below, where they would repeat the work."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_held")).select(*rest, *(F.col("_held")[c].alias(c) for c in columns))


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns of df, and all others in one, so that no name of theirs meets a name used inside an operator."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in needed]
    return df.select(*needed, F.struct(*rest).alias("_others") if rest else F.lit(None).cast("string").alias("_others"))


def unpacked(columns: list[str], *needed: str) -> list[Column]:
    """The columns of the frame that was packed, in their order."""
    return [F.col(c) if c in needed else F.col("_others")[c].alias(c) for c in columns]


def counted(docs: DataFrame, columns: list[Column]) -> list[Column]:
    """columns, those of docs in order, with n_chars as the length of the text."""
    length = F.char_length("text")
    return [length.cast(f.dataType).alias(f.name) if f.name == "n_chars" else c for f, c in zip(docs.schema.fields, columns, strict=True)]


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and arrays of many sizes leave them holding what they no longer use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)

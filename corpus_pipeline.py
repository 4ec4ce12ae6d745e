"""A corpus pipeline of five stages over documents; each stage's result is written as Parquet and read as the next one's docs.

Each stage is a function of (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import staged, table
from factloom.llm.jaccard import jaccard_stage
from factloom.llm.mixing import mix_stage
from factloom.llm.pieces import pieces_stage
from factloom.llm.quality import quality_stage
from factloom.llm.secrets import secrets_stage

STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mix_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]

#: The segmentation of the last stage has no SQL; tests/llm hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage{i}")
    return docs

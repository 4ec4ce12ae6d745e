"""Connected components of a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, staged


def _settled(links: DataFrame, n: int) -> bool:
    """Whether links are stars: each u has one v, and no v is a u itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out")).union(links.select("v", F.lit(0)))
    return sized(ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least")), n).where("out > 1 OR (out = 1 AND least = 0)").isEmpty()


#: Links that a task joins at once before any travel.
LOCAL = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each LOCAL links of a task: every node and the smallest one that these links join it to."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([h[c].to_numpy() for h in held]) for c in ("a", "b"))
        nodes, label = np.unique(np.concatenate((a, b)), return_inverse=True)
        x, y, least = label[: len(a)], label[len(a) :], np.arange(len(nodes))
        while True:  # nodes are in order, so the least label is the smallest node
            new = least.copy()
            np.minimum.at(new, x, least[y])
            np.minimum.at(new, y, least[x])
            np.minimum.at(new, least[x], new[y])
            np.minimum.at(new, least[y], new[x])
            new = new[new]
            if (new == least).all():
                break
            least = new
        moved = np.flatnonzero(least < np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[least[moved]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= LOCAL:
            yield stars(held)
            held, n = [], 0
    if held:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (columns a, b, long); nulls and loops link nothing.

    Links are joined within each task first. Each further step keeps connectivity and is a join on a node and its smallest neighbour; the steps end when every node
    links to its component's smallest one. Lineage is cut at a written table each time, and the tasks follow the number of links.
    """
    n = edges.count()
    links = sized(edges.where("a <> b").select("a", "b"), n).mapInArrow(_joined, "a long, b long").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = staged(sized(links, n), "links")
    while not _settled(links, n):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sized(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n)
        # large star: larger neighbours link to the smallest one
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = sized(large.groupBy("u").agg(F.min("v").alias("m")), n)
        # small star: smaller neighbours and the node itself link to the smallest one
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = staged(sized(small.union(least.select("u", F.col("m").alias("v"))).distinct(), n), "links")
    roots = sized(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct(), n)
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)

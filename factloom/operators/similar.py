"""Word similarity by trigrams: how near a text comes to holding a needle that it does not hold."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.45


def trigrams_of(text: str) -> list[str]:
    """The trigrams of a text in order: of each word of letters and digits, in lower case, with two spaces before and one behind."""
    return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for i in range(len(w) + 1)]


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: str) -> Column:
    words = words_of(text)
    each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.call_function("substring", F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.flatten(F.transform(words, each))


def similarity(needle: set[str], grams: list[str], least: float) -> float:
    """The largest Jaccard coefficient of needle and the trigrams of a stretch of grams, 0 if none reaches least.

    A best stretch begins and ends with one of needle's. One with more distinct trigrams than needle's through least
    cannot reach it, nor can longer ones, so each beginning looks at a bounded stretch, repetitions aside.
    """
    best, most = 0.0, math.floor(len(needle) / least)
    places = [i for i, g in enumerate(grams) if g in needle]
    for at, i in enumerate(places):
        seen, shared, begin = set(), set(), i
        for j in places[at:]:
            seen.update(grams[begin : j + 1])
            begin = j + 1
            if len(seen) > most:
                break
            shared.add(grams[j])
            best = max(best, len(shared) / (len(needle) + len(seen) - len(shared)))
    return best if best >= least else 0.0


def similar(rows: DataFrame, needle: str, least: float = THRESHOLD) -> DataFrame:
    """rows (text, ...) with similarity in place of text, those that reach least.

    First the texts that hold enough of needle's trigrams anywhere, counted by array functions: a coefficient of least
    needs least of needle's. Stretches are looked at in these alone. A worker of Python gets their words, a text's worth
    and not several times that, and holds the trigrams of one text at a time.
    """
    want = set(trigrams_of(needle))
    if not want:
        return rows.drop("text").withColumn("similarity", F.lit(0.0)).limit(0)
    enough = math.ceil(least * len(want) - 1e-9)
    near = rows.where(F.size(F.array_intersect(F.array(*map(F.lit, sorted(want))), trigrams("text"))) >= enough)
    kept = [c for c in rows.columns if c != "text"]
    lean = near.select(*kept, F.array_join(words_of("text"), " ").alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [similarity(want, [f"  {w} "[i : i + 3] for w in x.as_py().split(" ") for i in range(len(w) + 1)], least) for x in batch["_w"]]
            out = pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(scores, pa.float64())], [*kept, "similarity"])
            yield out.filter(pa.array([s > 0 for s in scores], pa.bool_()))

    return lean.mapInArrow(run, rows.drop("text").withColumn("similarity", F.lit(0.0)).schema)

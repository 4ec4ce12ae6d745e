"""Periodic run detection: stretches of words that repeat themselves at least LEAST_TIMES times.

A lag is worth a look only if enough words equal the word so many places on: a run of period q has three times q such
matches, LEAST_WORDS - q at least. The matches of every lag of a text are counted exactly without a look at the lags:
a frequent (heavy) word by the autocorrelation of its places, as the squared spectrum of an FFT, all heavy words of a
text in one inverse transform; a rare (light) word by the differences of its places. Only lags with enough matches get
a scan for islands, the longest stretches of consecutive matches.

A run has at least four periods, so a stretch that has a period and a divisor of it is found at both lags with the same
ends; the smaller is kept. Words are compared as 64-bit hashes; every run found is compared as text, and a text in
which hashes deceived is done again with numbered words.

Nulls: a null text has no words. Texts shorter than LEAST_WORDS have no runs. Very long texts are worked on whole, in memory
that grows with their words. Ties between runs are left to the caller: all runs come, by start, then period. Equal rows
get equal results, each its own; an empty table gives an empty one. Columns of the input named runs, n_words or collapsed
are replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WORD, packed, table, unpacked
from .substrings import joined_words
from .words import Slice, slices

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Places that scans look at together; a longer text's scan goes alone.
TOGETHER = 1 << 20
#: Occurrences beyond which a word is heavy, in texts short enough that the square root below is less.
HEAVY_LEAST = 64


def _heavy(n: np.ndarray) -> np.ndarray:
    """Occurrences in a text of n words beyond which an FFT costs less than all differences: half their square against n log n."""
    return np.maximum(HEAVY_LEAST, np.sqrt(n * np.log2(np.maximum(n, 2)))).astype(np.int64)


def lag_counts(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end (bounds), how many words equal the word each lag on: counts, and where each text's begin, those of lag 0 first."""
    n = np.diff(bounds)
    most = n // LEAST_TIMES
    base = np.concatenate(([0], np.cumsum(most + 1)))
    counts = np.zeros(int(base[-1]), dtype=np.int64)
    if not len(words):
        return counts, base
    of = np.repeat(np.arange(len(n)), n)
    by = np.argsort(words, kind="stable")  # each word's places in order, so text by text
    w, d = words[by], of[by]
    first = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (d[1:] != d[:-1]))))
    size = np.diff(np.append(first, len(by)))
    heavy = size > _heavy(n[d[first]])
    often = np.flatnonzero(heavy)
    often = often[np.argsort(d[first[often]], kind="stable")]
    for mine in np.split(often, np.flatnonzero(np.diff(d[first[often]])) + 1) if len(often) else []:
        t = int(d[first[mine[0]]])
        length, lo = 1 << int(n[t] + most[t]).bit_length(), int(bounds[t])
        power = np.zeros(length // 2 + 1)
        for g in mine.tolist():
            here = np.zeros(length)
            here[by[first[g] : first[g] + size[g]] - lo] = 1
            spectrum = np.fft.rfft(here)
            power += spectrum.real**2 + spectrum.imag**2
        counts[base[t] : base[t + 1]] += np.rint(np.fft.irfft(power, length)[: most[t] + 1]).astype(np.int64)
    light = np.repeat(~heavy, size)
    last = np.repeat(first + size, size)
    at, step, held, n_held = np.flatnonzero(light), 0, [], 0
    while len(at):
        step += 1
        at = at[at + step < last[at]]
        lag = by[at + step] - by[at]
        near = lag <= most[d[at]]  # further places of the word are further away
        at = at[near]
        held.append(base[d[at]] + lag[near])
        n_held += len(at)
        if n_held > TOGETHER or not len(at):
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n_held = [], 0
    return counts, base


def islands(words: np.ndarray, start: np.ndarray, length: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts (start, length) each with a lag: which of them, where in it and how long, for each island that makes a run."""
    out = []
    n = length - lag
    upto = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TOGETHER, side="right")))
        m = n[lo:hi]
        edge = np.concatenate(([0], np.cumsum(m)))
        at = np.arange(edge[-1]) + np.repeat(start[lo:hi] - edge[:-1], m)
        same = words[at] == words[at + np.repeat(lag[lo:hi], m)]
        begin, end = same.copy(), same.copy()
        begin[1:] &= ~same[:-1]
        begin[edge[:-1]] = same[edge[:-1]]
        end[:-1] &= ~same[1:]
        end[edge[1:] - 1] = same[edge[1:] - 1]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        which = np.searchsorted(edge, a, side="right") - 1
        q = lag[lo:hi][which]
        enough = b - a >= np.maximum(LEAST_WORDS - q, (LEAST_TIMES - 1) * q)
        out.append((which[enough] + lo, a[enough] - edge[which[enough]], (b - a)[enough]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start, length and period of all runs, by text, start and period."""
    counts, base = lag_counts(words, bounds)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(base))
    lag = np.arange(len(counts)) - base[of]
    worth = np.flatnonzero((lag > 0) & (counts >= np.maximum(LEAST_WORDS - lag, (LEAST_TIMES - 1) * lag)))
    of, lag = of[worth], lag[worth]
    which, start, length = islands(words, bounds[of], np.diff(bounds)[of], lag)
    text, period = of[which], lag[which]
    length = length + period
    by = np.lexsort((period, length, start, text))
    text, start, length, period = text[by], start[by], length[by], period[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = text[new], start[new], length[new], period[new]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _exact(piece: Slice, joined: bytes, begin: np.ndarray, end: np.ndarray):
    """The runs of a slice, compared as text."""

    def true(found) -> bool:
        for t, s, m, q in zip(*(x.tolist() for x in found), strict=True):
            s += int(piece.word_bounds[t])
            if joined[begin[s] : end[s + m - q - 1]] != joined[begin[s + q] : end[s + m - 1]]:
                return False
        return True

    found = runs(piece.word_hashes(), piece.word_bounds)
    if true(found):
        return found
    numbers: dict[bytes, int] = {}
    words = [numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return runs(np.array(words, dtype=np.uint64), piece.word_bounds)


_RUN = StructType([StructField(c, LongType(), False) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with n_words, runs (start, length and period in words, by start, then period) and collapsed: the words but those that a run has after its first period, joined by single spaces."""
    own = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    rows = packed(docs.select(*own), "text")
    names = ["text", "_others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch["text"]):
                joined, begin, end = joined_words(piece)
                text, start, length, period = _exact(piece, joined, begin, end)
                upto = np.searchsorted(text, np.arange(piece.n_docs + 1))
                kept = []
                for t in range(piece.n_docs):
                    lo, hi = int(piece.word_bounds[t]), int(piece.word_bounds[t + 1])
                    a, b = int(upto[t]), int(upto[t + 1])
                    if a == b:
                        kept.append(joined[begin[lo] : end[hi - 1]] if hi > lo else b"")
                        continue
                    depth = np.zeros(hi - lo + 1, dtype=np.int64)
                    np.add.at(depth, start[a:b] + period[a:b], 1)
                    np.add.at(depth, start[a:b] + length[a:b], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
                    kept.append(b" ".join(joined[begin[lo + i] : end[lo + j - 1]] for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
                part = batch.slice(piece.first, piece.n_docs)
                each = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), each)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(piece.n_words.astype(np.int64)), lists, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "runs", "collapsed"])

    schema = StructType([*(rows.schema[c] for c in names), StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN, False)), StructField("collapsed", StringType())])
    return rows.select(*names).mapInArrow(run, schema).select(*unpacked(own, "text"), "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in which the end of one text in ten is made periodic, by the number that its id hashes to."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    rows = docs.withColumn("_h", h).withColumn("_w", F.when(F.col("_h") % 10 == 0, words)).withColumn("_n", F.size("_w"))
    g = F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_a", (g % F.nullif("_n", F.lit(0))).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    turned = F.expr("array_join(transform(_w, (x, i) -> if(i >= _a, _w[_a + (i - _a) % _p], x)), ' ')")
    return rows.withColumn("text", F.when((F.col("_h") % 10 == 0) & (F.col("_n") > 0), turned).otherwise(F.col("text"))).drop("_h", "_w", "_n", "_a", "_p")


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, one in ten of which is given some: the longest, and digests of all runs and of the words left."""
    out = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = out.withColumn("_top", top)
    length, start, period = F.col("_top.length"), -F.col("_top.start"), -F.col("_top.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

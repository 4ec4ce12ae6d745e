"""Substring deduplication by super-k-mers: windows of WINDOW words that also start in a document with a smaller id go.

A window's minimiser is the smallest hash among its grams of MINIMISER words. Consecutive windows of a document that
share one are a super-k-mer and travel to the minimiser's bucket as one packed string, its words joined by single
spaces. Equal windows have equal minimisers, so each bucket can sort its windows and tell exactly which are repeated:
windows are sorted by hash, and those that seem equal are compared as text. Super-k-mers that are equal within a task
travel once, that of the smallest id; the others are marked where they are found, so a passage in a third of all
documents sends one string a task.

Grams are counted first, and those that are met often are the minimiser only of windows that have no other gram. So
windows that hold one phrase among different words do not meet at the phrase, but at grams of these words.

Nulls: a null text has no words; a document with a null id loses nothing and takes nothing from others. Documents with
equal ids do not take from each other. Texts shorter than a window lose nothing. Very long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import packed, parallelism, row_key, staged, table, unpacked
from .words import _BASE, _INVERSE, Slice, _power, gram_hashes, mixed, slices

WINDOW, MINIMISER = 50, 8
#: Bytes of text for which there is a bucket, a partition of buckets, and a task that counts grams, at least.
BUCKET_BYTES, PART_BYTES, COUNT_BYTES = 4 << 20, 256 << 20, 128 << 20
#: Bytes of packed strings that a task gathers before it sends them.
GATHER = 12 << 20
#: A gram is hot if it is met HOT_LEAST times and more often than all grams through HOT_SHARE times the buckets; its windows, 43 a time at most, would be more than a bucket's part.
HOT_SHARE, HOT_LEAST = 64, 100
#: Hot grams at most, twice over: 8 bytes each reach every task.
HOT_MOST = 1 << 20
#: Grams at least that a task remembers as it counts; it loses none that is met more often than the task's grams through this.
COUNTED = 1 << 16


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive entries."""
    have, least = 1, x
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    rest = width - have
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def joined_words(piece: Slice) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a slice, each followed by a space; and where each begins and ends there."""
    lengths = piece.ends - piece.starts
    ends = np.cumsum(lengths + 1) - 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, dtype=np.uint8)
    if len(ends):
        inside = np.repeat(piece.starts - (ends - lengths), lengths)
        at = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
        out[at] = piece.data[at + inside]
    return out.tobytes(), ends - lengths, ends


def ranked(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The hashes in 63 bits, hot ones (sorted) beyond all others."""
    grams = grams >> np.uint64(1)
    if not len(hot):
        return grams
    return np.where(hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams, grams | np.uint64(1 << 63), grams)


def _heaviest(grams: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The grams, each once with its count; with more than most of them all counts less the one next to these, which is given too."""
    order = np.argsort(grams)
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate((grams[:1] == grams[:1], grams[1:] != grams[:-1])))
    grams, n = grams[first], np.add.reduceat(n, first) if len(first) else n
    if len(n) <= most:
        return grams, n, 0
    less = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])
    return grams[n > less], n[n > less] - less, less


def hot_grams(docs: DataFrame, minimiser: int = MINIMISER, buckets: int = 1, tasks: int | None = None) -> np.ndarray:
    """The hashes, in 63 bits and sorted, of all hot grams of docs, and maybe of some that are met half as often: 2 * HOT_SHARE * buckets or so at most.

    tasks: as many count at most, small partitions together, since in a task that sees few grams each is a large part of them.
    """
    docs = docs.select("text") if tasks is None else docs.select("text").coalesce(tasks)
    share = 2 * min(HOT_SHARE * buckets, HOT_MOST)
    remember = max(COUNTED, 4 * share)
    least = HOT_LEAST / (4 * tasks) if tasks else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, n, total, lost = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0, 0
        held, size = [], 0

        def merge():
            nonlocal grams, n, lost, held, size
            new = np.concatenate([np.zeros(0, dtype=np.uint64), *held])
            grams, n, less = _heaviest(np.concatenate((grams, new)), np.concatenate((n, np.ones(len(new), dtype=np.int64))), remember)
            lost, held, size = lost + less, [], 0

        for batch in batches:
            for piece in slices(batch[0]):
                of_word = piece.doc_of_word()
                inside = of_word[: max(0, len(of_word) - minimiser + 1)] == of_word[minimiser - 1 :]
                new = gram_hashes(piece.word_hashes(), minimiser)[inside] >> np.uint64(1)
                total += len(new)
                held.append(new)
                size += len(new)
                if size >= remember:
                    merge()
        merge()
        # no count is more than lost too small; -1 stands for all grams. What tasks do not send of a hot gram is less than half of it
        met = n + lost > max(total / (2 * share), least)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(grams[met].astype(np.int64), -1)), pa.array(np.append(n[met] + lost, total))], ["gram", "n"])

    counts = docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "grams")
    total = counts.where("gram < 0").agg(F.sum("n")).first()[0] or 0
    found = counts.where((F.col("gram") >= 0) & (F.col("n") > max(total / share, HOT_LEAST // 2))).collect()
    return np.array(sorted(r["gram"] for r in found), dtype=np.uint64)


def super_kmers(piece: Slice, window: int, minimiser: int, hot: np.ndarray = np.zeros(0, dtype=np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: the text, first word (in the slice), number of windows and minimiser of each super-k-mer."""
    of_word = piece.doc_of_word()
    n = len(of_word) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = _sliding_min(ranked(gram_hashes(piece.word_hashes(), minimiser), hot), window - minimiser + 1)
    at = np.flatnonzero(of_word[:n] == of_word[window - 1 :])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (of_word[at[1:]] != of_word[at[:-1]])
    first = np.flatnonzero(new)
    return of_word[at[first]], at[first], np.diff(np.append(first, len(at))), least[at[first]]


_PACKED = "part int, bucket int, ids binary, keys binary, first binary, windows binary, bytes binary, strings binary, done binary"


def _pack(window: int, minimiser: int, buckets: int, parts: int, hot: np.ndarray):
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, turn, done = 0, 0, []

        def out():
            nonlocal turn
            by: dict[int, list] = {}
            for s, entries in held.items():
                for bucket, i, k, f, w in entries:
                    by.setdefault(bucket, []).append((i, k, f, w, len(s), s))
            press = zstandard.ZstdCompressor(level=1)
            names, columns = [], [[], [], [], [], [], []]
            for bucket, rows in by.items():
                names.append(bucket)
                *numbers, strings = zip(*rows, strict=True)
                for c, x in zip(columns, numbers, strict=False):
                    c.append(np.array(x, dtype=np.int64).tobytes())
                columns[5].append(press.compress(b" ".join(strings)))
            marks = [b""] * len(names)
            if done:
                turn = (turn * 31 + len(done)) % buckets
                names.append(turn)
                for c in columns:
                    c.append(b"")
                marks.append(np.array(done, dtype=np.int64).tobytes())
            part = [b * parts // buckets for b in names]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(names, pa.int32()), *(pa.array(c, pa.binary()) for c in columns), pa.array(marks, pa.binary())], ["part", "bucket", "ids", "keys", "first", "windows", "bytes", "strings", "done"])

        for batch in batches:
            for piece in slices(batch["text"]):
                doc, first, windows, least = super_kmers(piece, window, minimiser, hot)
                if not len(doc):
                    continue
                text, begin, end = joined_words(piece)
                ids = batch["doc_id"].slice(piece.first, piece.n_docs)
                null = np.asarray(ids.is_null())
                id_of = ids.fill_null(0).to_numpy()[doc].tolist()
                key_of = batch["key"].slice(piece.first, piece.n_docs).to_numpy()[doc].tolist()
                use = ~null[doc]
                place = (first - piece.word_bounds[doc]).tolist()
                a, b = begin[first].tolist(), end[first + windows + window - 2].tolist()
                bucket = (mixed(least) % np.uint64(buckets)).astype(np.int64).tolist()
                windows = windows.tolist()
                for x in np.flatnonzero(use).tolist():
                    s = text[a[x] : b[x]]
                    mine = (bucket[x], id_of[x], key_of[x], place[x], windows[x])
                    there = held.get(s)
                    if there is None:
                        held[s] = [mine]
                        size += len(s) + 100
                    elif there[0][1] == mine[1]:
                        there.append(mine)
                        size += 100
                    else:
                        if there[0][1] > mine[1]:
                            gone, held[s] = there, [mine]
                        else:
                            gone = [mine]
                        done += [(i, k, f, f + w + window - 1) for _, i, k, f, w in gone]
                if size > GATHER or len(done) > 200_000:
                    yield out()
                    held, size, done = {}, 0, []
        if held or done:
            yield out()

    return run


def _sort(window: int):
    import zstandard

    def spans(doc_id, key, first, last):
        return pa.RecordBatch.from_arrays([pa.array(doc_id.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc_id", "key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bucket by bucket, as the sorted rows stream by."""
        unpress, bucket, texts, parts = zstandard.ZstdDecompressor(), None, [], []
        for batch in batches:
            for mine, ids, keys, first, windows, n_bytes, strings, done in zip(*(batch[c].to_pylist() for c in batch.schema.names[1:]), strict=True):
                if mine != bucket:
                    yield from repeated(texts, parts)
                    bucket, texts, parts = mine, [], []
                if done:
                    marks = np.frombuffer(done, dtype=np.int64).reshape(-1, 4)
                    yield spans(*marks.T)
                if not ids:
                    continue
                ids, keys, first, windows, n_bytes = (np.frombuffer(x, dtype=np.int64) for x in (ids, keys, first, windows, n_bytes))
                text = unpress.decompress(strings)
                data = np.frombuffer(text, dtype=np.uint8)
                piece = Slice(0, data, np.array([0, len(data)]))
                words = piece.word_hashes()
                # a window's hash from running sums; super-k-mers follow each other, with windows + window - 1 words each
                total = np.zeros(len(words) + 1, dtype=np.uint64)
                np.cumsum(words * _power(_BASE, len(words)), out=total[1:])
                lengths = windows + window - 1
                start = np.cumsum(lengths) - lengths
                at = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
                found = mixed((total[at + window] - total[at]) * _power(_INVERSE, len(words) + 1)[at])
                kmer = np.repeat(np.arange(len(ids)), windows)
                parts.append((found, ids[kmer], keys[kmer], first[kmer] + at - start[kmer], np.full(len(at), len(texts)), piece.starts[at], piece.ends[at + window - 1]))
                texts.append(text)
        yield from repeated(texts, parts)

    def repeated(texts: list[bytes], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The windows of a bucket that also start in a smaller id."""
        if not parts:
            return
        found, ids, key, word, text_of, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((ids, found))
        f = found[by]
        new = np.ones(len(f), dtype=bool)
        new[1:] = f[1:] != f[:-1]
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))]  # the window of the smallest id with that hash
        source = np.empty(len(f), dtype=np.int64)
        source[by] = head
        del by, f, new, head
        gone = np.flatnonzero(ids > ids[source])
        if not len(gone):
            return
        # runs of consecutive windows whose sources are consecutive too are compared as one string
        src = source[gone]
        apart = np.ones(len(gone), dtype=bool)
        apart[1:] = (gone[1:] != gone[:-1] + 1) | (src[1:] != src[:-1] + 1) | (key[gone[1:]] != key[gone[:-1]]) | (word[gone[1:]] != word[gone[:-1]] + 1) | (text_of[src[1:]] != text_of[src[:-1]]) | (key[src[1:]] != key[src[:-1]]) | (word[src[1:]] != word[src[:-1]] + 1)
        lo = np.flatnonzero(apart)
        hi = np.append(lo[1:], len(gone)) - 1
        same = np.zeros(len(lo), dtype=bool)
        g, h, p, q = gone[lo], gone[hi], src[lo], src[hi]
        for r, (tg, ga, gb, tp, pa_, pb) in enumerate(zip(text_of[g].tolist(), a[g].tolist(), b[h].tolist(), text_of[p].tolist(), a[p].tolist(), b[q].tolist(), strict=True)):
            same[r] = texts[tg][ga:gb] == texts[tp][pa_:pb]
        yield spans(ids[g][same], key[g][same], word[g][same], word[h][same] + window)
        for r in np.flatnonzero(~same).tolist():  # unequal windows with one hash: each against all others of that hash
            for x in gone[lo[r] : hi[r] + 1].tolist():
                mine = texts[text_of[x]][a[x] : b[x]]
                others = np.flatnonzero((found == found[x]) & (ids < ids[x])).tolist()
                if any(texts[text_of[o]][a[o] : b[o]] == mine for o in others):
                    yield spans(ids[[x]], key[[x]], word[[x]], word[[x]] + window)

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """doc_id, key, first, last: words (from 0, end exclusive) of the documents (doc_id, text, key) that repeated windows cover.

    Buckets follow the bytes of all texts, so a bucket's part does not grow with the data; a partition has many of them and
    takes them one by one, so partitions stay few enough to shuffle.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * parallelism(spark), -(-n_bytes // BUCKET_BYTES))
    hot = hot_grams(docs, minimiser, buckets, max(spark.sparkContext.defaultParallelism, -(-n_bytes // COUNT_BYTES)))
    parts = min(buckets, max(4 * parallelism(spark), -(-n_bytes // PART_BYTES)))
    sent = docs.select("doc_id", "text", "key").mapInArrow(_pack(window, minimiser, buckets, parts, hot), _PACKED)
    return sent.repartition(parts, "part").sortWithinPartitions("bucket").mapInArrow(_sort(window), "doc_id long, key long, first int, last int")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed and kept_text, the words left joined by single spaces, which replace columns of docs with these names."""
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text")]
    docs = docs.select(*own)
    rest = packed(docs, "doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    cuts = repeated_spans(rest.select("doc_id", "text", "key"), window).groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    rows = rest.join(cuts, ["doc_id", "key"], "left").drop("key")
    names = ["doc_id", "text", "_others"]

    def run(batches):
        for batch in batches:
            for piece in slices(batch["text"]):
                text, begin, end = joined_words(piece)
                removed, kept = [], []
                cuts = batch["cuts"].slice(piece.first, piece.n_docs).to_pylist()
                for d, spans in enumerate(cuts):
                    lo, hi = int(piece.word_bounds[d]), int(piece.word_bounds[d + 1])
                    if not spans:
                        removed.append(0)
                        kept.append(text[begin[lo] : end[hi - 1]] if hi > lo else b"")
                        continue
                    depth = np.zeros(hi - lo + 1, dtype=np.int64)
                    np.add.at(depth, [s["first"] for s in spans], 1)
                    np.add.at(depth, [s["last"] for s in spans], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    removed.append(int(gone.sum()))
                    edges = np.flatnonzero(np.diff(np.concatenate(([True], gone, [True])).astype(np.int8)))
                    runs = zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)
                    kept.append(b" ".join(text[begin[lo + i] : end[lo + j - 1]] for i, j in runs))
                part = batch.slice(piece.first, piece.n_docs)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array(piece.n_words.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept_text"])

    schema = StructType([*(rest.schema[c] for c in names), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    out = rows.select(*names, "cuts").mapInArrow(run, schema)
    return out.select(*unpacked(own, "doc_id", "text"), "n_words", "n_removed", "kept_text")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 50 words that also start in a document of smaller id."""
    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

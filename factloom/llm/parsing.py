"""Removal of byte strings that also start in a document with a smaller id, by prefix-free parsing.

A phrase begins where the rolling hash of GRAM bytes triggers, and at the start of a text; it ends LENGTH - 1 bytes
behind the start of the next, so that every string of LENGTH bytes lies in the one phrase in whose own part it begins,
and no order beyond the phrase is needed. The parse is the sequence of phrases of every text, each named by 128 bits.
Phrases that the parse has in several documents belong to the smallest id; every other occurrence goes as a whole, so
copies cost a name each. What is left is the dictionary: each phrase where it belongs.

The dictionary's suffixes of LENGTH bytes are sorted in buckets. A suffix goes to the bucket of the least hash among its
grams, consecutive ones of one bucket together as one packed string. In a bucket the suffixes that share a hash of
their LENGTH bytes are sorted as text, and by document, which is the corpus order of all that can be equal: the first
of equal ones keeps its string. The order of the parse (a phrase's documents) and that of the dictionary (equal
suffixes) together give every string's smallest document.

Grams are counted with the parse. Those met often rank behind all others, so a common string draws no crowd of
different surroundings; a suffix that has only such grams goes to the bucket of its own hash, once a task.

Nulls: a null text is empty; a document with a null id loses nothing and takes nothing. Documents with equal ids do not
take from each other. Texts shorter than LENGTH lose nothing. Very long texts are worked on whole. An empty table gives
an empty one. Columns of the input named n_bytes, n_removed, n_spans or kept are replaced; all others stay.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import give_back, packed, parallelism, staged, table, unpacked
from .substrings import _heaviest, _sliding_min, ranked
from .words import _BASE, _BYTES, _INVERSE, _power, mixed

#: Bytes of a string, of the grams whose hashes trigger and rank, and the share of grams that trigger.
LENGTH, GRAM, SPACING = 50, 12, 256
#: Bytes of text that are worked on at once, for which there is a bucket, a partition of buckets, and a task that parses.
SLICE, BUCKET_BYTES, PART_BYTES, COUNT_BYTES = 256 << 10, 1 << 20, 256 << 20, 256 << 20
#: Bytes of packed strings that a task gathers before it sends them.
GATHER = 12 << 20
#: A gram is hot if it is met HOT_LEAST times and more often than all grams through HOT_SHARE times the buckets.
HOT_SHARE, HOT_LEAST = 64, 100
#: Hot grams at most, twice over: 8 bytes each reach every task.
HOT_MOST = 1 << 20
#: Grams at least that a task remembers as it counts.
COUNTED = 1 << 16
#: Spans up to which they reach all tasks, about 40 bytes each with what each text takes; beyond, texts are shuffled to meet theirs.
FEW_SPANS = 1_000_000


def _slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts of a string column in slices of about limit bytes: the first's number, the bytes, and where each text begins in them."""
    column = pc.fill_null(column, "") if column.null_count else column
    _, where, data = column.buffers()
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    where = np.frombuffer(where, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = min(len(column), max(first + 1, int(np.searchsorted(where, where[first] + limit, side="right")) - 1))
        yield first, data[where[first] : where[last]], where[first : last + 1] - where[first]
        first = last


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums of a polynomial in the bytes, of which hashes of any stretch follow."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _power(_BASE, len(data)), out=total[1:])
    return total


def _hashes(total: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n bytes that begin at each place but the last n - 1."""
    m = max(0, len(total) - n)
    return mixed((total[n : n + m] - total[:m]) * _power(_INVERSE, m))


def phrases(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the text, begin, end of its own part, and end of each phrase."""
    at = np.flatnonzero((grams & np.uint64(SPACING - 1)) == 0)
    text = np.searchsorted(bounds, at, side="right") - 1
    at = at[at + GRAM <= bounds[text + 1]]  # not across two texts
    full = bounds[:-1][np.diff(bounds) > 0]
    begin = np.unique(np.concatenate((full, at)))
    text = np.searchsorted(bounds, begin, side="right") - 1
    own = np.append(begin[1:], bounds[-1]) if len(begin) else begin
    own = np.minimum(own, bounds[text + 1])
    return text, begin, own, np.minimum(own + LENGTH - 1, bounds[text + 1])


_PARSE = "kind int, p long, q long, doc_id long, key long, first int, last int, n long"


def _parse(share: int, least: float):
    """Rows of kind 0, an occurrence of a phrase; 1, a gram (p) that the task met often, and how often; 2, all grams it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember = max(COUNTED, 4 * share)
        grams, n, total, lost = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 0, 0
        held, size = [], 0

        def rows(kind, p, q, doc_id, key, first, last, n):
            columns = [np.full(len(p), kind), p, q, doc_id, key, first, last, n]
            types = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)).cast(t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _PARSE.split(", ")])

        def merge():
            nonlocal grams, n, lost, held, size
            grams, n, less = _heaviest(np.concatenate((grams, *(g for g, _ in held))), np.concatenate((n, *(c for _, c in held))), remember)
            lost, held, size = lost + less, [], 0

        for batch in batches:
            for number, data, bounds in _slices(batch["text"]):
                found = _hashes(_sums(data), GRAM)
                # counts: those met once in a slice are left out, and so are counted one too few a slice
                once = np.sort(found >> np.uint64(1))
                first = np.flatnonzero(np.concatenate((once[:1] == once[:1], once[1:] != once[:-1])))
                times = np.diff(np.append(first, len(once)))
                more = times > 1
                held.append((once[first[more]], times[more]))
                total, lost, size = total + len(once), lost + 1, size + int(more.sum())
                if size >= remember:
                    merge()
                text, begin, own, end = phrases(found, bounds)
                null = np.asarray(batch["doc_id"].slice(number, len(bounds) - 1).is_null())
                use = (end - begin >= LENGTH) & ~null[text]
                text, begin, end = text[use], begin[use], end[use]
                raw = data.tobytes()
                names = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True)), dtype=np.int64).reshape(-1, 2)
                ids = batch["doc_id"].slice(number, len(bounds) - 1).fill_null(0).to_numpy()[text]
                keys = batch["key"].slice(number, len(bounds) - 1).to_numpy()[text]
                yield rows(0, names[:, 0], names[:, 1], ids, keys, begin - bounds[text], end - bounds[text], np.zeros(len(text)))
        merge()
        met = n + lost > max(total / (2 * share), least)
        zero = np.zeros(int(met.sum()))
        yield rows(1, grams[met], zero, zero, zero, zero, zero, n[met] + lost)
        yield rows(2, [0], [0], [0], [0], [0], [0], [total])
        del grams, n, held, met, zero
        give_back()

    return run


_PACKED = "part int, bucket int, ids binary, keys binary, first binary, windows binary, strings binary, done binary"


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches, one after the other."""
    edge = np.cumsum(size) - size
    return data[np.arange(int(size.sum())) + np.repeat(begin - edge, size)]


def _united(doc_id: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of equal length, those of a text that touch or overlap as one."""
    by = np.lexsort((first, key, doc_id))
    doc_id, key, first, last = doc_id[by], key[by], first[by], last[by]
    apart = np.ones(len(by), dtype=bool)
    apart[1:] = (doc_id[1:] != doc_id[:-1]) | (key[1:] != key[:-1]) | (first[1:] > last[:-1])
    lo = np.flatnonzero(apart)
    hi = np.append(lo[1:], len(by))[: len(lo)] - 1
    return doc_id[lo], key[lo], first[lo], last[hi]


def _pack(buckets: int, parts: int, hot: np.ndarray):
    """The dictionary's suffixes: a row a bucket and gathering, of the strings that its suffixes begin in."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        pieces, size, crowd, done, turn = [], 0, {}, [], 0

        def out():
            """All gathered, by bucket."""
            nonlocal pieces, size, crowd, done, turn
            if crowd:
                some = [(b, *e, s) for s, entries in crowd.items() for b, *e in entries]
                bucket, ids, keys, first, strings = zip(*some, strict=True)
                pieces.append((np.array(bucket), np.array(ids), np.array(keys), np.array(first), np.ones(len(some), dtype=np.int64), np.frombuffer(b"".join(strings), dtype=np.uint8)))
            columns = [[], [], [], [], [], [], [], []]
            if pieces:
                bucket, ids, keys, first, windows, data = (np.concatenate(x) for x in zip(*pieces, strict=True))
                length = windows + LENGTH - 1
                place = np.cumsum(length) - length
                by = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) != 0)))
                for mine in np.split(by, at[1:]):
                    b = int(bucket[mine[0]])
                    strings = _gathered(data, place[mine], length[mine])
                    for c, x in zip(columns, (b * parts // buckets, b, np.diff(ids[mine], prepend=0), keys[mine], first[mine].astype(np.int32), windows[mine].astype(np.int32)), strict=False):
                        c.append(x if isinstance(x, int) else press.compress(x.tobytes()))
                    columns[6].append(press.compress(strings.tobytes()))
                    columns[7].append(b"")
            if done:
                turn = (turn * 31 + len(done)) % buckets
                marks = np.stack(_united(*np.array(done, dtype=np.int64).T), axis=1)
                for c, x in zip(columns, (turn * parts // buckets, turn, b"", b"", b"", b"", b"", marks.tobytes()), strict=True):
                    c.append(x)
            pieces, size, crowd, done = [], 0, {}, []
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _PACKED.split(", ")])

        for batch in batches:
            for number, data, bounds in _slices(batch["text"]):
                n_docs = len(bounds) - 1
                total = _sums(data)
                n = len(data) - LENGTH + 1
                if n <= 0:
                    continue
                text = np.repeat(np.arange(n_docs), np.diff(bounds))
                ids = batch["doc_id"].slice(number, n_docs)
                use = text[:n] == text[LENGTH - 1 :]
                use &= ~np.asarray(ids.is_null())[text[:n]]
                ids = ids.fill_null(0).to_numpy()
                keys = batch["key"].slice(number, n_docs).to_numpy()
                gone = batch["gone"].slice(number, n_docs)
                lists = gone.flatten()
                if len(lists):  # what belongs to a smaller id: all strings within its phrases
                    of = np.repeat(np.arange(n_docs), pc.fill_null(pc.list_value_length(gone), 0).to_numpy())
                    depth = np.zeros(len(data) + 1, dtype=np.int32)
                    lists = lists.to_numpy()
                    np.add.at(depth, bounds[of] + (lists >> 32), 1)
                    np.add.at(depth, bounds[of] + (lists & 0xFFFFFFFF) - LENGTH + 1, -1)
                    use &= np.cumsum(depth)[:n] == 0
                least = _sliding_min(ranked(_hashes(total, GRAM), hot), LENGTH - GRAM + 1)
                common = use & (least >> np.uint64(63) > 0)
                use &= ~common
                new = np.ones(n, dtype=bool)
                new[1:] = (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1]) | ~use[:-1]
                begin = np.flatnonzero(use & new)
                stop = np.append(np.flatnonzero(new | ~use), n)
                windows = stop[np.searchsorted(stop, begin, side="right")] - begin
                if len(begin):
                    t = text[begin]
                    strings = _gathered(data, begin, windows + LENGTH - 1)
                    pieces.append(((mixed(least[begin]) % np.uint64(buckets)).astype(np.int64), ids[t], keys[t], begin - bounds[t], windows, strings))
                    size += len(strings) + 28 * len(begin)
                at = np.flatnonzero(common)
                if len(at):  # each text's equal ones together; of several texts that of the smallest id travels
                    raw, t = data.tobytes(), text[at]
                    own = (mixed((total[at + LENGTH] - total[at]) * _power(_INVERSE, n)[at]) % np.uint64(buckets)).tolist()
                    for x, b, i, k, f in zip(at.tolist(), own, ids[t].tolist(), keys[t].tolist(), (at - bounds[t]).tolist(), strict=True):
                        s = raw[x : x + LENGTH]
                        there = crowd.get(s)
                        if there is None:
                            crowd[s] = [(b, i, k, f)]
                            size += 200
                        elif there[0][1] == i:
                            there.append((b, i, k, f))
                            size += 100
                        elif there[0][1] > i:
                            done += [(i2, k2, f2, f2 + LENGTH) for _, i2, k2, f2 in there]
                            crowd[s] = [(b, i, k, f)]
                        else:
                            done.append((i, k, f, f + LENGTH))
                if size > GATHER or len(done) > 200_000:
                    yield out()
                    give_back()
        if pieces or crowd or done:
            yield out()
        give_back()

    return run


def suffixes(data: np.ndarray, at: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at some places, sorted by their first LENGTH bytes and then by document; and which are the first of equal ones."""
    words = -(-LENGTH // 8)
    text = np.zeros((len(at), words * 8), dtype=np.uint8)
    if len(at):
        text[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at]
    columns = text.view(np.uint64)
    if sys.byteorder == "little":
        columns.byteswap(inplace=True)  # so that the order of numbers is that of bytes
    by = np.lexsort((doc_id, *columns.T[::-1]))
    new = np.zeros(len(by), dtype=bool)
    new[:1] = True
    for word in columns.T:
        word = word[by]
        new[1:] |= word[1:] != word[:-1]
    return by, new


def _bucket(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, key and first byte of the strings of a bucket that also start in a smaller id."""
    import zstandard

    unpress = zstandard.ZstdDecompressor().decompress
    ids = np.concatenate([np.cumsum(np.frombuffer(unpress(r[0]), dtype=np.int64)) for r in rows])
    keys = np.concatenate([np.frombuffer(unpress(r[1]), dtype=np.int64) for r in rows])
    first = np.concatenate([np.frombuffer(unpress(r[2]), dtype=np.int32) for r in rows])
    windows = np.concatenate([np.frombuffer(unpress(r[3]), dtype=np.int32) for r in rows]).astype(np.int64)
    data = np.frombuffer(b"".join(unpress(r[4]) for r in rows), dtype=np.uint8)
    length = windows + LENGTH - 1
    place = np.cumsum(length) - length
    before = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(windows), dtype=np.int32), windows)
    at = (np.arange(len(of)) + np.repeat(place - before, windows)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
    found, edge, lo = np.empty(len(of), dtype=np.uint64), np.append(place, len(data)), 0
    upto = np.cumsum(windows)
    while lo < len(windows):  # some strings at a time
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + SLICE, side="right")) - 1)
        mine, total = slice(int(before[lo]), int(upto[hi - 1])), _sums(data[edge[lo] : edge[hi]])
        x = at[mine] - edge[lo]
        found[mine] = mixed((total[x + LENGTH] - total[x]) * _power(_INVERSE, len(total))[x])
        lo = hi
    # the hash's upper bits above the place: one sort brings those together that may be equal, a few others among them
    bits = max(1, int(len(found)).bit_length())
    found &= np.uint64(((1 << 64) - 1) ^ ((1 << bits) - 1))
    found |= np.arange(len(found), dtype=np.uint64)
    found.sort()
    same = (found[1:] ^ found[:-1]) < np.uint64(1 << bits)
    twin = np.zeros(len(found), dtype=bool)
    twin[1:] = same
    twin[:-1] |= same
    some = (found[twin] & np.uint64((1 << bits) - 1)).astype(np.int64)
    del found, same, twin
    by, new = suffixes(data, at[some], ids[of[some]])
    some = some[by]
    doc = ids[of[some]]
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))] if len(some) else doc
    gone = some[doc > least]
    of = of[gone]
    return ids[of], keys[of], first[of] + at[gone] - place[of]


_SPANS = "doc_id long, key long, first int, last int"


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the strings that go, bucket by bucket as the sorted rows stream by."""

    def spans(doc_id, key, first, last):
        return pa.RecordBatch.from_arrays([pa.array(doc_id.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc_id", "key", "first", "last"])

    def ended(rows):
        doc_id, key, first = _bucket(rows)
        return spans(*_united(doc_id, key, first, first + LENGTH))

    held, rows = None, []
    for batch in batches:
        for bucket, *row, done in zip(*(batch[c].to_pylist() for c in batch.schema.names[1:]), strict=True):
            if bucket != held:
                if rows:
                    yield ended(rows)
                    give_back()
                held, rows = bucket, []
            if done:
                yield spans(*np.frombuffer(done, dtype=np.int64).reshape(-1, 4).T)
            else:
                rows.append(row)
    if rows:
        yield ended(rows)
        rows = []
    give_back()


def merged(spans: DataFrame, overlap: int | None = None) -> DataFrame:
    """Spans (doc_id, key, first, last) that touch or overlap as one; with overlap those alone that overlap by just so much."""
    mine = Window.partitionBy("doc_id", "key").orderBy("first")
    before = F.max("last").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    joins = F.col("first") <= before if overlap is None else F.col("first") == before - overlap
    apart = spans.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return apart.groupBy("doc_id", "key", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")


def _with_spans(docs: DataFrame, spans: DataFrame, name: str, few: int) -> DataFrame:
    """docs with their spans (doc_id, key, first, last; written, merged) as a list of first * 2^32 + last, null for none. The lists reach all tasks if there are few spans, counted first."""
    lists = spans.groupBy("doc_id", "key").agg(F.collect_list(F.shiftleft(F.col("first").cast("long"), 32) + F.col("last")).alias(name))
    return docs.join(F.broadcast(lists) if spans.count() <= few else lists, ["doc_id", "key"], "left")


def repeated_bytes(docs: DataFrame, few: int = FEW_SPANS) -> DataFrame:
    """doc_id, key, first, last: bytes (from 0, end exclusive) of docs (doc_id, text, key) that go."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * parallelism(spark), -(-n_bytes // BUCKET_BYTES))
    parts = min(buckets, max(4 * parallelism(spark), -(-n_bytes // PART_BYTES)))
    share = 2 * min(HOT_SHARE * buckets, HOT_MOST)
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_bytes // COUNT_BYTES))
    parse = staged(docs.select("doc_id", "text", "key").coalesce(tasks).mapInArrow(_parse(share, HOT_LEAST / (4 * tasks)), _PARSE), "parse")

    total = parse.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    often = parse.where("kind = 1").groupBy("p").agg(F.sum("n").alias("n")).where(F.col("n") > max(total / share, HOT_LEAST // 2))
    hot = np.array(sorted(r["p"] for r in often.select("p").collect()), dtype=np.uint64)  # 2 * HOT_MOST at most

    parsed = parse.where("kind = 0")
    owned = parsed.groupBy("p", "q").agg(F.min("doc_id").alias("_owner"), F.max("doc_id").alias("_last")).where("_owner < _last").drop("_last")
    # consecutive phrases overlap by just LENGTH - 1; with one of its own between two that go, a text keeps these apart
    gone = staged(merged(parsed.join(owned, ["p", "q"]).where("doc_id > _owner").select("doc_id", "key", "first", "last"), LENGTH - 1), "phrases")
    rows = _with_spans(docs.select("doc_id", "text", "key"), gone, "gone", few)
    sent = rows.mapInArrow(_pack(buckets, parts, hot), _PACKED)
    found = sent.repartition(parts, "part").sortWithinPartitions("bucket").mapInArrow(_sorted, _SPANS)
    return gone.union(found)


def without_repeats(docs: DataFrame, few: int = FEW_SPANS) -> DataFrame:
    """docs (doc_id, text, ...) with n_bytes, n_removed, n_spans (stretches of removed bytes) and kept, the bytes left."""
    own = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    rows = packed(docs.select(*own), "doc_id", "text")
    twice = not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    # the id alone tells rows apart where it does; a hash of eight bytes a string would be most of what is sent
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text") if twice else F.lit(0).cast("long"))
    cuts = staged(merged(repeated_bytes(rows, few)), "cuts")
    names = ["doc_id", "text", "_others"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes, removed, spans, kept = [], [], [], []
                for text, cut in zip(batch["text"], batch["cuts"].to_pylist(), strict=True):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    out, upto, n_spans, end = [], 0, 0, -1
                    for first, last in sorted((x >> 32, x & 0xFFFFFFFF) for x in cut or ()):
                        n_spans += first > end
                        end = max(end, last)
                        if first > upto:
                            out.append(data[upto:first])
                        upto = max(upto, last)
                    out.append(data[upto:])
                    left = b"".join(out)
                    sizes.append(len(data))
                    removed.append(len(data) - len(left))
                    spans.append(n_spans)
                    kept.append(left)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])
        give_back()

    schema = StructType([*(rows.schema[c] for c in names), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    out = _with_spans(rows, cuts, "cuts", few).select(*names, "cuts").mapInArrow(run, schema)
    return out.select(*unpacked(own, "doc_id", "text"), "n_bytes", "n_removed", "n_spans", "kept")


def op12_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 50 bytes that also start in a document of smaller id."""
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

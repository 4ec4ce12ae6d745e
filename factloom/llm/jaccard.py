"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence matrix with size bounds.

Exact over 63-bit hashes of word n-grams (two distinct n-grams of a corpus share one with negligible probability).

1. A pass finds frequent n-grams; they only set the order in which a document's n-grams are read: rarest first, by hash,
   the most frequent last. Any fixed order gives the same links.
2. A document of n n-grams can only link to one that shares an n-gram of its first n - ceil(t * n) + 1 (prefix bound),
   of size t * n to n / t. These matrix entries go in packed blocks, by column range, to tasks that read off which
   rows meet in a column. Documents with equal sets are one row.
3. Rows that meet are tried in stars first: each with the smallest that fits. Bitmaps of
   4 to 8 bits an n-gram bound each pair's overlap from above: a bit that only one row has set stands for an n-gram that
   only it has. Pairs whose bound is too small are discarded. A block of the product is a star's centre and up to BLOCK
   of the partners left, whose overlaps are accumulated and held against t / (1 + t) * (sum of sizes). Its links join
   rows to classes.
4. Columns whose smallest row is the same are taken as one. Where rows of several classes meet, the likeliest pairs that would join all classes are tried, and then
   all pairs across classes that their bitmaps allow. Pairs within a class need no trial, as they are connected.
   So no link between classes is lost, and a group of thousands of near copies need not make all its pairs.

Nulls: a null text has an empty set, which links with nothing; rows with a null id are linked, but do not name a class.
Repeated rows are copies of each other. Very long texts are read alone, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, packed, parallelism, row_key, sized, staged, table, unpacked
from .components import components
from .words import gram_hashes, mixed, slices

N, THRESHOLD = 5, Fraction(3, 4)
#: n-grams read last, at most, those first in frequency (8 bytes each reach every task); n-grams gathered before they are counted.
FREQUENT, GATHER = 262_144, 2_000_000
#: Partners in a block; pairs up to which their table, 24 bytes a pair, is broadcast to the texts.
BLOCK, BROADCAST_PAIRS = 256, 500_000
#: Rows of a meeting that are held against each other by bitmap in one go.
MEETING_BLOCK = 1024
_TOP = np.uint64(1 << 63)


def _ids(piece, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice: the text and 63-bit n-gram of each occurrence. Shorter texts with a word have one, of all their words."""
    words, of_word = piece.word_hashes(), piece.doc_of_word()
    grams = gram_hashes(words, n)
    fits = of_word[: len(grams)] == of_word[n - 1 :] if len(grams) else np.zeros(0, bool)
    doc, gram = of_word[: len(grams)][fits], grams[fits]
    short = np.flatnonzero((piece.n_words > 0) & (piece.n_words < n))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for i, d in enumerate(short):
            a, b = piece.word_bounds[d], piece.word_bounds[d + 1]
            whole[i] = gram_hashes(words[a:b], int(b - a))[0] + np.uint64(b - a)
        doc, gram = np.concatenate((doc, short)), np.concatenate((gram, mixed(whole)))
    return doc, gram >> np.uint64(1)


class _Order:
    """The order of n-grams: frequent ones, rarest first, after all others."""

    def __init__(self, frequent: np.ndarray):
        """frequent: ids by rising frequency."""
        self.rank = np.argsort(frequent, kind="stable").astype(np.uint64)
        self.ids = frequent[self.rank.astype(np.int64)]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.ids & np.uint64((1 << 20) - 1)] = True

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out = ids.copy()
        if len(self.ids):
            at = np.flatnonzero(self.maybe[ids & np.uint64((1 << 20) - 1)])
            place = np.minimum(np.searchsorted(self.ids, ids[at]), len(self.ids) - 1)
            same = self.ids[place] == ids[at]
            out[at[same]] = _TOP | self.rank[place[same]]
        return out


def _sets(piece, n: int, order: _Order) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: all texts' n-gram sets in order, one after another; the bounds of each; and a 63-bit name of each set."""
    doc, gram = _ids(piece, n)
    gram = order(gram)
    by = np.lexsort((gram, doc))
    doc, gram = doc[by], gram[by]
    if len(doc):
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        doc, gram = doc[new], gram[new]
    bounds = np.searchsorted(doc, np.arange(piece.n_docs + 1))
    total = np.zeros(len(gram) + 1, dtype=np.uint64)
    np.cumsum(mixed(gram + np.uint64(0x51ED270B)), out=total[1:])
    names = mixed(total[bounds[1:]] - total[bounds[:-1]] + mixed(np.diff(bounds).astype(np.uint64))) >> np.uint64(1)
    return gram, bounds, names


def _bits(size: int) -> int:
    """Bits of the bitmap of a set of that size."""
    return 1 << max(6, (4 * size - 1).bit_length())


def _bitmaps(gram: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    scattered, out = mixed(gram), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        bits = np.zeros(_bits(int(b - a)), dtype=bool)
        bits[(scattered[a:b] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def most_shared(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """What the intersection of two sets has at most, by their bitmaps and sizes."""
    p, q, m = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    while p >> m:
        p = (p & ((1 << m) - 1)) | (p >> m)
    while q >> m:
        q = (q & ((1 << m) - 1)) | (q >> m)
    both = (p & q).bit_count()
    return min(n_x - p.bit_count(), n_y - q.bit_count()) + both


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for piece in slices(batch["text"], lower=True):
            yield batch.slice(piece.first, piece.n_docs), piece


def _split(bucket: np.ndarray, columns: list[np.ndarray], sign: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    by = np.argsort(bucket, kind="stable")
    bucket = bucket[by]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(bucket)]))
    columns = [c[by] for c in columns]
    for a, b in zip(starts, ends, strict=True):
        if b > a:
            yield sign * int(bucket[a]), [c[a:b].tobytes() for c in columns]


def frequent_grams(docs: DataFrame, n: int, buckets: int, most: int) -> np.ndarray:
    """The most frequent n-grams by rising frequency, at most most, of those that come twice or more to a task."""

    def local(batches):
        held, size = [], 0

        def out():
            ids, counts = np.unique(np.concatenate(held), return_counts=True)
            ids, counts = ids[counts > 1], counts[counts > 1]
            got = list(_split((ids % np.uint64(buckets)).astype(np.int64), [ids, counts.astype(np.int64)]))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int32()), pa.array([v[0] for _, v in got], pa.binary()), pa.array([v[1] for _, v in got], pa.binary())], ["bucket", "ids", "counts"])

        for _, piece in _text_slices(batches):
            ids = _ids(piece, n)[1]
            held.append(ids)
            size += len(ids)
            if size >= GATHER:
                yield out()
                held, size = [], 0
        if size:
            yield out()
        del held
        give_back()

    def total(batches):
        ids, counts = [], []
        for b in batches:
            ids += [np.frombuffer(x, dtype=np.uint64) for x in b["ids"].to_pylist()]
            counts += [np.frombuffer(x, dtype=np.int64) for x in b["counts"].to_pylist()]
        if ids:
            ids, at = np.unique(np.concatenate(ids), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            if len(ids) > most:
                top = np.argpartition(-sums, most - 1)[:most]
                ids, sums = ids[top], sums[top]
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(sums)], ["id", "n"])
        del ids, counts
        give_back()

    sums = docs.mapInArrow(local, "bucket int, ids binary, counts binary").repartition("bucket").mapInArrow(total, "id long, n long")
    top = sums.where("n > 3").orderBy(F.desc("n"), "id").limit(most).toPandas()  # bounded by most
    return top["id"].to_numpy().astype(np.uint64)[::-1].copy()


def _entries(docs: DataFrame, n: int, t: Fraction, order: _Order, buckets: int) -> DataFrame:
    """Packed blocks of the matrix: for bucket >= 0 the column, row and row size of prefix entries; below 0, documents."""

    def run(batches):
        turn = 0
        for batch, piece in _text_slices(batches):
            gram, bounds, names = _sets(piece, n, order)
            sizes = np.diff(bounds)
            prefix = np.where(sizes > 0, sizes - -(-sizes * t.numerator // t.denominator) + 1, 0)
            first = np.unique(names, return_index=True)[1]  # copies within a slice are one row
            only = np.zeros(len(sizes), dtype=bool)
            only[first] = True
            prefix = np.where(only, prefix, 0)
            at = np.repeat(bounds[:-1] - np.cumsum(prefix) + prefix, prefix) + np.arange(prefix.sum())
            row = np.repeat(np.arange(len(sizes)), prefix)
            got = list(_split((mixed(gram[at]) % np.uint64(buckets)).astype(np.int64), [gram[at], names[row], sizes[row].astype(np.int32)]))
            ids, null = batch["doc_id"].fill_null(0).to_numpy(), np.asarray(batch["doc_id"].is_null())
            turn = (turn * 31 + len(sizes) + 7) % buckets
            got.append((-1 - turn, [ids.tobytes(), names.tobytes(), sizes.astype(np.int32).tobytes()]))
            last = lambda x: pa.array([b""] * (len(got) - 1) + [x], pa.binary())
            keys, flags, maps = last(batch["key"].to_numpy().tobytes()), last(null.tobytes()), last(b"".join(_bitmaps(gram, bounds)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in got], pa.int32()), *(pa.array([v[i] for _, v in got], pa.binary()) for i in range(3)), keys, flags, maps],
                ["bucket", "a", "b", "c", "key", "nulls", "maps"],
            )
        give_back()

    return docs.mapInArrow(run, "bucket int, a binary, b binary, c binary, key binary, nulls binary, maps binary")


_MET = "kind byte, a long, b long, c long, key long, map binary"


def _met(t: Fraction):
    """Reads off blocks which rows meet. kind 0: documents (id, row, size, key, bitmap); 1: pairs to try first; 2: rows that meet (the smallest of them, row, size)."""

    def rows(kind, a, b, c, key=None, null=None, maps=None):
        columns = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a.astype(np.int64), mask=null), pa.array(b.astype(np.int64)), pa.array(c.astype(np.int64))]
        columns += [pa.array(np.zeros(len(a), np.int64) if key is None else key), pa.nulls(len(a), pa.binary()) if maps is None else pa.array(maps, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["kind", "a", "b", "c", "key", "map"])

    def cut(maps, sizes):
        ends = np.cumsum([_bits(int(n)) // 8 for n in sizes])
        return [maps[e - _bits(int(n)) // 8 : e] for e, n in zip(ends, sizes, strict=True)]

    def run(batches):
        held = []
        for batch in batches:
            for k, a, b, c, key, null, maps in zip(*(batch[x].to_pylist() for x in ("bucket", "a", "b", "c", "key", "nulls", "maps")), strict=True):
                b, c = np.frombuffer(b, np.uint64), np.frombuffer(c, np.int32)
                if k < 0:
                    yield rows(0, np.frombuffer(a, np.int64), b, c, np.frombuffer(key, np.int64), np.frombuffer(null, bool), cut(maps, c))
                else:
                    held.append((np.frombuffer(a, np.uint64), b, c))
        if not held:
            return
        gram, row, size = (np.concatenate(x) for x in zip(*held, strict=True))
        del held
        # columns with one entry meet nothing; most are such
        by = np.argsort(gram, kind="stable")
        gram = gram[by]
        twin = np.zeros(len(gram), dtype=bool)
        twin[1:] = gram[1:] == gram[:-1]
        twin[:-1] |= twin[1:]
        gram, row, size = gram[twin], row[by][twin], size[by][twin]
        by = np.lexsort((row, size, gram))
        gram, row, size = gram[by], row[by], size[by]
        if len(gram):
            new = np.ones(len(gram), dtype=bool)
            new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])  # copies in other slices
            gram, row, size = gram[new], row[new], size[new]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(gram)) + 1, [len(gram)]))
        del gram, by
        seen, pairs, lists = set(), [], []
        many = np.flatnonzero(np.diff(cuts) > 1)
        for i in many:
            a, b = cuts[i], cuts[i + 1]
            r, s = row[a:b], size[a:b]
            name = int(mixed(mixed(r).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0])
            if name in seen:
                continue
            seen.add(name)
            least = -(-s.astype(np.int64) * t.numerator // t.denominator)
            lead = np.searchsorted(s, least)  # the smallest row that fits each
            other = np.flatnonzero(lead < np.arange(len(r)))
            if not len(other):
                continue
            pairs.append((r[lead[other]], r[other]))
            if len(r) > 2:
                lists.append(np.stack((np.full(len(r), r.min()), r, s.astype(np.uint64)), axis=1))
        if pairs:
            x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
            both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
            yield rows(1, both[:, 0], both[:, 1], np.zeros(len(both)))
        if lists:  # columns whose smallest row is the same meet as one
            gathered = np.unique(np.concatenate(lists), axis=0)
            yield rows(2, gathered[:, 0], gathered[:, 1], gathered[:, 2])
            del gathered
        del lists, pairs, seen, row, size
        give_back()

    return run


def likely(pairs: DataFrame, rows: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the overlap that a link needs."""
    side = lambda x: rows.select(F.col("row").alias(x), F.struct("map", "size").alias(f"{x}_is"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches):
        for batch in batches:
            x, y = batch["a_is"].to_pylist(), batch["b_is"].to_pylist()
            ok = [(t.numerator + t.denominator) * most_shared(p["map"], p["size"], q["map"], q["size"]) >= t.numerator * (p["size"] + q["size"]) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def product(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of two blocks of rows (sorted column ids each): i, j and the columns that row i of left and row j of right share, where they share any.

    The blocks' entries are joined on their columns once, and each joint entry adds one to the count of its pair of rows.
    """
    rows = [np.repeat(np.arange(len(x)), [len(c) for c in x]) for x in (left, right)]
    (l_col, r_col) = (np.concatenate(x) for x in (left, right))
    by = np.argsort(l_col, kind="stable")
    l_col, l_row = l_col[by], rows[0][by]
    first, last = np.searchsorted(l_col, r_col, side="left"), np.searchsorted(l_col, r_col, side="right")
    times = last - first
    at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    counts = np.bincount(l_row[at] * len(right) + np.repeat(rows[1], times), minlength=len(left) * len(right))
    met = np.flatnonzero(counts)
    return met // len(right), met % len(right), counts[met]


def linked(docs: DataFrame, pairs: DataFrame, rows: DataFrame, n: int, t: Fraction, order: _Order) -> DataFrame:
    """The pairs (a, b) of rows of the matrix that link. rows: row, and the key of a text that has its set."""
    rows = rows.select("row", "key")
    centre = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    partners = pairs.join(centre, "a").select(F.col("b").alias("row"), F.struct("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.lit(1).alias("role")).alias("to"))
    centres = centre.select(F.col("a").alias("row"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("row", F.struct(F.col("row").alias("a"), "block", F.lit(0).alias("role")).alias("to"))
    sent = partners.union(centres).groupBy("row").agg(F.collect_list("to").alias("to")).join(rows, "row").select("key", "to")
    n_pairs = pairs.count()
    few = n_pairs <= BROADCAST_PAIRS
    texts = docs.join(F.broadcast(sent) if few else sent, "key").select("text", "to")

    def send(batches):
        for batch, piece in _text_slices(batches):
            gram, bounds, names = _sets(piece, n, order)
            out, size = [], 0
            for d, to in enumerate(batch["to"].to_pylist()):
                data = gram[bounds[d] : bounds[d + 1]].tobytes()
                for x in to:
                    if x["role"] == 0 and int(names[d]) != x["a"]:
                        continue  # another text of the same hash
                    out.append((x["a"], x["block"], x["role"], int(names[d]), data))
                    size += len(data)
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)
        give_back()

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["a", "block", "role", "row", "set"])

    def accumulate(batches):
        # rows come sorted by centre, block and role: the centre, then its partners
        key, centre, names_, sets = None, None, [], []

        def out():
            i, j, shared = product([centre], sets)
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            ok = (t.numerator + t.denominator) * shared >= t.numerator * (len(centre) + sizes[j])
            return pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), key[0], np.int64)), pa.array(np.array(names_, dtype=np.int64)[j[ok]])], ["a", "b"])

        for batch in batches:
            for a, block, role, row, data in zip(*(batch[x].to_pylist() for x in ("a", "block", "role", "row", "set")), strict=True):
                if key != (a, block):
                    if sets:
                        yield out()
                    key, centre, names_, sets = (a, block), None, [], []
                x = np.frombuffer(data, dtype=np.uint64)
                if role == 0:
                    centre = x
                elif centre is not None and t.numerator * max(len(x), len(centre)) <= t.denominator * min(len(x), len(centre)):
                    names_.append(row)
                    sets.append(x)
        if sets:
            yield out()

    blocks = texts.mapInArrow(send, "a long, block int, role int, row long, set binary")
    found = blocks.repartition("a", "block").sortWithinPartitions("a", "block", "role").mapInArrow(accumulate, "a long, b long")
    return sized(found.distinct(), n_pairs)


def _wide(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of one length, or twice it, as rows of that many 64-bit words."""
    out = np.zeros((len(maps), words), dtype=np.uint64)
    for i, m in enumerate(maps):
        bits = np.frombuffer(m, dtype=np.uint64)
        out[i] = bits if len(bits) == words else bits[:words] | bits[words:]
    return out


def _forest(p: np.ndarray, q: np.ndarray, class_p: np.ndarray, class_q: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The places of pairs (p, q) that join all classes that pairs join, those of most spare first; about one a class."""
    _, label = np.unique(np.concatenate((class_p, class_q)), return_inverse=True)
    lp, lq = label[: len(p)], label[len(p) :]
    at, root, out = np.argsort(spare, kind="stable"), np.arange(int(label.max(initial=-1)) + 1), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    while len(at):
        best = np.full(len(root), -1)
        best[lp[at]] = at  # the last one written has the most spare
        best[lq[at]] = np.where(best[lq[at]] < 0, at, best[lq[at]])
        best[lq[at]] = np.where(spare[at] >= spare[best[lq[at]]], at, best[lq[at]])
        chosen = np.unique(best[best >= 0])
        out.append(chosen)
        for i in chosen.tolist():
            root[find(int(lp[i]))] = find(int(lq[i]))
        flat = np.array([find(i) for i in range(len(root))], dtype=np.int64)
        lp, lq = flat[lp], flat[lq]
        at = at[lp[at] != lq[at]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _block(left: list, right: list, same: bool, t: Fraction, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two blocks of a meeting (row, size, class, bitmap): the pairs across classes that may link, or the likeliest that would join all classes; and all rows in pairs that may link."""
    found: list[tuple] = []
    by_length: dict[int, tuple[list, list]] = {}
    for k, block in enumerate((left, right)):
        for x in block:
            by_length.setdefault(len(x[3]) // 8, ([], []))[k].append(x)
    for words, (xs, _) in by_length.items():
        for other in (words // 2, words, words * 2):
            ys = by_length.get(other, ([], []))[1]
            if not xs or not ys:
                continue
            w = min(words, other)
            x_map, y_map = _wide([x[3] for x in xs], w), _wide([y[3] for y in ys], w)
            x_r, x_n, x_c = (np.array([x[i] for x in xs]) for i in range(3))
            y_r, y_n, y_c = (np.array([y[i] for y in ys]) for i in range(3))
            x_p, y_p = (np.bitwise_count(z).sum(axis=1).astype(np.int64) for z in (x_map, y_map))
            step = max(1, (1 << 20) // (w * len(ys)))
            for at in range(0, len(xs), step):
                s = slice(at, at + step)
                shared = np.bitwise_count(x_map[s, None, :] & y_map[None, :, :]).sum(axis=2).astype(np.int64)
                most = np.minimum((x_n[s] - x_p[s])[:, None], (y_n - y_p)[None, :]) + shared
                spare = (t.numerator + t.denominator) * most - t.numerator * (x_n[s][:, None] + y_n[None, :])
                spare[x_c[s][:, None] == y_c[None, :]] = -1
                if same:  # each pair once
                    spare[x_r[s][:, None] >= y_r[None, :]] = -1
                i, j = np.nonzero(spare >= 0)
                found.append((x_r[s][i], y_r[j], x_c[s][i], y_c[j], spare[i, j]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    p, q, p_c, q_c, spare = (np.concatenate(z) for z in zip(*found, strict=True))
    able = np.unique(np.concatenate((p, q)))
    if not every:
        at = _forest(p, q, p_c, q_c, spare)
        p, q = p[at], q[at]
    return np.minimum(p, q), np.maximum(p, q), able


def _across(known: DataFrame, rows: DataFrame, t: Fraction, every: bool) -> DataFrame:
    """Of rows of several classes that meet: pairs (a, b) that may link, all or the likeliest that would join all classes, and, with no b, the rows a of each meeting that are in such pairs. known: meeting, n (its rows), row, class.

    A meeting is worked on in pairs of blocks of about MEETING_BLOCK rows; pairs that cannot link never leave their task.
    """
    blocks = F.ceil(F.col("n") / MEETING_BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("row"), blocks).cast("int")
    dealt = known.join(rows.select("row", "size", "map"), "row").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("meeting", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"), "row", "size", "class", "map")

    def run(batches):
        key, left, right = None, [], []

        def out():
            a, b, able = _block(left, right, False, t, every) if right else _block(left, left, True, t, every)
            columns = [np.full(len(a) + len(able), key[0], np.int64), np.concatenate((a, able)), np.concatenate((b, able))]
            single = np.arange(len(a) + len(able)) >= len(a)
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64(), mask=single)], ["meeting", "a", "b"])

        for batch in batches:
            for m, i, j, second, *x in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if key != (m, i, j):
                    if left or right:
                        yield out()
                    key, left, right = (m, i, j), [], []
                (right if second else left).append(x)
        if left or right:
            yield out()

    return dealt.repartition("meeting", "i", "j").sortWithinPartitions("meeting", "i", "j").mapInArrow(run, "meeting long, a long, b long")


def similar(docs: DataFrame, n: int = N, t: Fraction = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text, key, a hash of both): rows (doc_id, key, row, size), where equal sets share a row, and components (node, component) of linked rows."""
    spark = docs.sparkSession
    buckets = 4 * parallelism(spark)
    order = _Order(frequent_grams(docs.select("text"), n, buckets, FREQUENT))
    met = staged(_entries(docs, n, t, order, buckets).repartition("bucket").mapInArrow(_met(t), _MET), "met")
    rows = met.where("kind = 0").select(F.col("a").alias("doc_id"), "key", F.col("b").alias("row"), F.col("c").alias("size"))
    holders = met.where("kind = 0 AND c > 0").groupBy(F.col("b").alias("row")).agg(F.min(F.struct("key", "map", F.col("c").alias("size"))).alias("x")).select("row", "x.*")
    tried = staged(met.where("kind = 1").select("a", "b").distinct(), "tried")
    rowed = tried.select(F.col("a").alias("row")).union(tried.select("b")).distinct()  # rows in no pair fit no other in size
    holders = staged(holders.join(rowed, "row", "left_semi"), "holders")
    links = staged(linked(docs, staged(likely(tried, holders, t), "likely"), holders, n, t, order), "linked")
    classes = staged(components(links), "classes")

    meetings = met.where("kind = 2").select(F.col("a").alias("meeting"), F.col("b").alias("row")).distinct()
    for every in (False, True):
        known = meetings.join(classes.withColumnRenamed("node", "row"), "row", "left").withColumn("class", F.coalesce("component", "row")).drop("component")
        several = known.groupBy("meeting").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("meeting", "n")
        found = staged(_across(known.join(several, "meeting"), holders, t, every), "found")
        # classes only grow, so rows in no pair now are in none later
        meetings = found.where("b IS NULL").select("meeting", F.col("a").alias("row")).distinct()
        more = staged(found.where("b IS NOT NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            continue
        tried = tried.union(more)
        links = staged(links.union(linked(docs, more, holders, n, t, order)), "linked")
        classes = staged(components(links), "classes")
    return rows, classes


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("key", row_key("doc_id", "text"))


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, key, size and class of every document; class is null for empty sets."""
    rows, classes = similar(_keyed(docs))
    out = rows.join(classes.withColumnRenamed("node", "row"), "row", "left")
    return out.select("doc_id", "key", "size", F.when(F.col("size") > 0, F.coalesce("component", "row")).alias("class"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked at a similarity of 0.75 over 5-word shingles."""
    named = _named(table(spark, sf_dir, "documents"))
    least = named.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "class", "left")
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest id (among equal ids, of the smallest row hash); empty ones all stay."""
    named = staged(_named(docs), "named")
    first = named.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("f")).select(F.col("f.key").alias("key"))
    times = named.join(first, "key", "left_semi").groupBy("key").count()
    empty = named.where("class IS NULL").select("key").distinct()
    once = times.where("count = 1").select("key").union(empty)
    keyed = packed(docs, "doc_id", "text").withColumn("key", row_key("doc_id", "text"))
    out = keyed.join(once, "key", "left_semi")
    again = keyed.join(times.where("count > 1").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return out.union(again).select(*unpacked(docs.columns, "doc_id", "text"))


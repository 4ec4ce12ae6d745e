"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table rotates unit vectors by three rounds of random signs and a Hadamard transform and cuts the result into BLOCKS
blocks; a vector's bucket is the signed axis nearest to it in each block, and its range of lengths, as nearness is the
inner product and grows with length. Candidates are indexed once a table; a query looks into buckets in the order of
its projections on their axes times their mean length, until these hold a given share of all candidates and more than
k of them. So lists are never short, long vectors at wider angles are met, and a query far from a tight cluster still
reads that cluster's buckets. Found candidates are ranked by the exact inner product of the original vectors, in double
precision. Tables of every size are hashed and searched alike.

The share is fitted: FIT_QUERIES queries are answered exactly, in one pass over all rows, and the least share is taken
at which FIT_RECALL of their true neighbours lie in a bucket that is read. So vectors that cluster are found by reading
little, and those that do not, such as random ones, by reading as much as the recall asks for.

Equal vectors are searched once, and of a group of equal candidates only the first k + 1 ids are kept: no others can be
among the k nearest, ties going to smaller ids. Neighbouring buckets are put together in cells of about CELL_ROWS rows,
and a larger bucket is dealt by the id to several cells, so no task depends on how rows fall into buckets. A query goes
once to each cell in which it reads, with the buckets that it reads there.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part; shorter ones count as padded
with zeros. Rows with a null id take no part. Rows that repeat an id with equal vectors count once. An empty table has
no results. Other columns are not read, so their names are free.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Hash tables; blocks of a rotation that are hashed together, and coordinates of each at most.
TABLES, BLOCKS, BLOCK_WIDTH = 16, 2, 32
#: Queries that the share is fitted on, and the part of their neighbours that the buckets read must hold. Recall: README.
FIT_QUERIES, FIT_RECALL = 64, 0.96
#: Ranges of lengths at most; neighbouring ranges whose lengths differ by less than this factor are one.
RANGES, APART = 4, 1.05
#: Candidates that one cell holds about.
CELL_ROWS = 32_768


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(x: np.ndarray, t: int, seed: int) -> np.ndarray:
    """Table t's pseudo-random rotation: signs and Hadamard, three times."""
    signs = np.random.default_rng((seed, t)).choice((-1.0, 1.0), size=(3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


class Tables:
    """The hash tables: the bucket of each vector, and what each bucket promises a query. Axis i is i, its negative width + i."""

    def __init__(self, d: int, cuts: list[float], tables: int, seed: int):
        """d: components, a power of two; cuts: the lengths from which ranges but the first begin."""
        self.blocks = BLOCKS if d >= 4 * BLOCKS else 1
        self.width = min(d // self.blocks, BLOCK_WIDTH)
        self.n, self.seed, self.cuts = tables, seed, np.array(cuts)
        self.joint = (2 * self.width) ** self.blocks
        self.slots = self.joint * (len(cuts) + 1)

    def projections(self, unit: np.ndarray, t: int) -> list[np.ndarray]:
        """On the signed axes of each block."""
        y = rotated(unit, t, self.seed)
        parts = (y[:, b * (y.shape[1] // self.blocks) :][:, : self.width] for b in range(self.blocks))
        return [np.concatenate((p, -p), axis=1) for p in parts]

    def ranges(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.linalg.norm(x, axis=1)
        return size, np.searchsorted(self.cuts, size, side="right")

    def places(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Each vector's bucket in every table in turn."""
        size, band = self.ranges(x)
        unit = x / size[:, None]
        for t in range(self.n):
            at = np.zeros(len(x), dtype=np.int64)
            for p in self.projections(unit, t):
                at = at * 2 * self.width + np.argmax(p, axis=1)
            yield t * self.slots + band * self.joint + at

    def promises(self, unit: np.ndarray, t: int, lengths: np.ndarray) -> np.ndarray:
        """Of each query and each bucket of table t: the projection on its axes times the mean length of its range."""
        parts = self.projections(unit, t)
        y = parts[0]
        for p in parts[1:]:
            y = (y[:, :, None] + p[:, None, :]).reshape(len(unit), -1)
        return (lengths[None, :, None] * y[:, None, :]).reshape(len(unit), -1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows. Rows are summed alike in every task, so that a pair has one score wherever it is found."""
    return np.einsum("ij,kj->ik", q, c, optimize=False)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda e: e != 0)).select(F.col(id_col).alias("id"), v.alias("vec"))


def exact_lists(kept: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, list[int]]:
    """The k nearest of few queries among all rows, in one pass in which every task sends k + 1 rows a query at most."""
    d = x.shape[1]

    def run(batches):
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                scores, there = products(x, matrix(part["vec"], d)), part["id"].to_numpy()
                for i, s in enumerate(scores):
                    s, c = np.concatenate((best[i][0], s)), np.concatenate((best[i][1], there))
                    by = np.lexsort((c, -s))[: k + 1]
                    best[i] = s[by], c[by]
        for i, (s, c) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ids[i])), pa.array(c), pa.array(s)], ["query", "id", "score"])

    found: dict[int, list] = {}
    for r in kept.mapInArrow(run, "query long, id long, score double").collect():
        if r["id"] != r["query"]:
            found.setdefault(r["query"], []).append((-r["score"], r["id"]))
    return {q: [i for _, i in sorted(near)[:k]] for q, near in found.items()}


def fitted_share(kept: DataFrame, queries: DataFrame, tables: Tables, sizes: np.ndarray, lengths: np.ndarray, d: int, k: int, n: int) -> int:
    """Candidates that a query reads in each table at least, so that FIT_RECALL of the neighbours of a sample of queries are met."""
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(FIT_QUERIES).collect()  # bounded by FIT_QUERIES
    ids = np.array([r["id"] for r in sample], dtype=np.int64)
    x = np.zeros((len(ids), d))
    for i, r in enumerate(sample):
        x[i, : len(r["vec"])] = r["vec"]
    lists = exact_lists(kept, ids, x, k)
    wanted = kept.join(F.broadcast(kept.sparkSession.createDataFrame([(i,) for near in lists.values() for i in near], "id long").distinct()), "id").collect()  # FIT_QUERIES * k at most
    vector = {}
    for r in wanted:
        vector[r["id"]] = np.zeros(d)
        vector[r["id"]][: len(r["vec"])] = r["vec"]
    pairs = [(i, j) for i, q in enumerate(ids.tolist()) for j in lists.get(q, ())]
    if not pairs:
        return n
    row = np.array([i for i, _ in pairs])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    need = np.full(len(pairs), n, dtype=np.int64)
    for t, place in enumerate(tables.places(np.array([vector[j] for _, j in pairs]))):
        promise, held = tables.promises(unit, t, lengths), sizes[t * tables.slots : (t + 1) * tables.slots]
        at = place - t * tables.slots
        for i in range(len(ids)):
            mine = np.flatnonzero(row == i)
            if len(mine):
                order = np.argsort(-promise[i], kind="stable")
                read = np.empty(len(held), dtype=np.int64)
                read[order] = np.cumsum(held[order]) - held[order]
                need[mine] = np.minimum(need[mine], read[at[mine]])
    need.sort()
    return int(need[min(len(need) - 1, int(np.ceil(FIT_RECALL * len(need))) - 1)]) + 1


def nearest(df: DataFrame, id_col: str, vec_col: str, is_query, k: int = 20, tables: int = TABLES, seed: int = 1, facts: dict | None = None) -> DataFrame:
    """query_id, rank, id, score: the k nearest found of every row for which is_query (a function of the id column) holds, itself excluded.

    facts, if given, is told the rows, the share read of each table, and the candidates scored a query.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col)
    single = "array<float>" in df.select(vec_col).dtypes[0][1]
    firsts = Window.partitionBy("vec").orderBy("id")
    kept = rows.distinct().withColumn("n", F.row_number().over(firsts)).where(F.col("n") <= k + 1).select("id", "vec")
    kept = staged(kept, "vectors")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    shares = F.array(*(F.lit(i / RANGES) for i in range(RANGES)))
    n, width, edges = kept.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.percentile_approx(length, shares)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    d = 1 << max(1, (width - 1).bit_length())
    kind_of = np.float32 if single else np.float64  # what travels; scores are of doubles
    cuts = []  # lengths from which ranges but the first begin
    for low, high in zip(edges, edges[1:]):
        if high >= APART * (cuts[-1] if cuts else low):
            cuts.append(high)
    hashed = Tables(d, cuts, tables, seed)
    slots = hashed.slots

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = np.zeros(hashed.n * slots, dtype=np.int64), np.zeros(len(cuts) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch["vec"].slice(at, 4096), d)
                for where_ in hashed.places(x):
                    held += np.bincount(where_, minlength=len(held))
                size, band = hashed.ranges(x)
                total += np.bincount(band, size, len(total))
        met = np.flatnonzero(held)
        ids = np.concatenate((met, -1 - np.arange(len(total))))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(np.concatenate((held[met], total)))], ["bucket", "n"])

    # one count a bucket: tables * RANGES * (2 * BLOCK_WIDTH) ** BLOCKS at most
    sizes, lengths = np.zeros(hashed.n * slots, dtype=np.int64), np.zeros(len(cuts) + 1)
    for bucket, m in kept.mapInArrow(count, "bucket int, n double").groupBy("bucket").agg(F.sum("n")).collect():
        if bucket < 0:
            lengths[-1 - bucket] = m
        else:
            sizes[bucket] = int(m)
    lengths /= np.maximum(sizes[:slots].reshape(-1, hashed.joint).sum(axis=1), 1)
    queries = rows.where(is_query(F.col("id"))).distinct()
    each = queries.groupBy("vec").agg(F.min("id").alias("id"))  # equal queries are searched once
    each = staged(each, "queries")
    target = min(n, max(fitted_share(kept, each, hashed, sizes, lengths, d, k, n), 2 * (k + 1)))
    # cells: neighbouring buckets of a table, or parts of one
    cell_of = np.concatenate([t * slots + (np.cumsum(s) - s) // CELL_ROWS for t, s in enumerate(sizes.reshape(hashed.n, slots))])
    parts = np.maximum(1, -(-sizes // CELL_ROWS))
    if facts is not None:
        facts |= {"rows": n, "share": target / n, "most_scored": min(1.0, hashed.n * target / n)}
    where = "kind byte, cell int, part int, id long, bucket binary, vec binary"

    def probed(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of queries and the buckets they read, in every table."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for t in range(hashed.n):
            full = np.flatnonzero(sizes[t * slots : (t + 1) * slots])
            promise, held = hashed.promises(unit, t, lengths)[:, full], sizes[t * slots + full]
            most, row, at = min(len(full), 64 + int(2 * len(full) * target / n)), [], []
            todo = np.arange(len(x))
            while len(todo):  # the best buckets in order, more of them where they do not hold enough
                p = promise[todo]
                top = np.argpartition(-p, most - 1, axis=1)[:, :most] if most < len(full) else np.broadcast_to(np.arange(len(full)), p.shape)
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(p, top, axis=1), axis=1, kind="stable"), axis=1)
                upto = np.cumsum(held[top], axis=1)
                done = (upto[:, -1] >= target) | (most == len(full))
                r, c = np.nonzero((upto - held[top] < target) & done[:, None])
                row.append(todo[r])
                at.append(t * slots + full[top[r, c]])
                todo, most = todo[~done], min(len(full), 4 * most)
            yield np.concatenate(row), np.concatenate(at)

    def put(is_q: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256 if is_q else 4096):
                    b = batch.slice(at, 256 if is_q else 4096)
                    x = matrix(b["vec"], d)
                    ids = b["id"].to_numpy()
                    raw = pa.array([r.tobytes() for r in x.astype(kind_of)], pa.binary())
                    for take, bucket in probed(x) if is_q else ((np.arange(len(x)), w) for w in hashed.places(x)):
                        cell, part = cell_of[bucket], ids[take] % parts[bucket]
                        data = [v.tobytes() for v in bucket.astype(np.int32)] if not is_q else None
                        if is_q:  # every part of a bucket sees the query, and each cell once
                            times = parts[bucket]
                            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                            take, bucket, cell = (np.repeat(v, times) for v in (take, bucket, cell))
                            by = np.lexsort((bucket, part, cell, take))
                            take, bucket, cell, part = take[by], bucket[by].astype(np.int32), cell[by], part[by]
                            new = np.flatnonzero(np.concatenate(([True], (take[1:] != take[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))) if len(take) else np.zeros(0, np.int64)
                            data = [v.tobytes() for v in np.split(bucket, new[1:])] if len(new) else []
                            take, cell, part = take[new], cell[new], part[new]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(take), is_q, dtype=np.int8)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(ids[take]), pa.array(data, pa.binary()), raw.take(pa.array(take))],
                            ["kind", "cell", "part", "id", "bucket", "vec"],
                        )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(asked, ci, cb, cx):
            """asked: (id, buckets, vector) of queries; candidates of a cell, sorted by bucket."""
            ids, qx = np.array([a[0] for a in asked]), np.array([a[2] for a in asked])
            bucket = np.concatenate([a[1] for a in asked])
            of = np.repeat(np.arange(len(asked)), [len(a[1]) for a in asked])
            by = np.argsort(bucket, kind="stable")
            bucket, of = bucket[by], of[by]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            rows_, near, score = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lo, hi = np.searchsorted(cb, [bucket[a], bucket[a] + 1])
                if lo == hi:
                    continue
                for at in range(a, b, 256):
                    q = of[at : min(b, at + 256)]
                    s = products(qx[q], cx[lo:hi])
                    if hi - lo > 4 * k:  # of a large bucket only rows that can be among the nearest
                        i, j = np.nonzero(s >= np.partition(s, hi - lo - k - 1, axis=1)[:, [hi - lo - k - 1]])
                    else:
                        i, j = (z.ravel() for z in np.indices(s.shape))
                    rows_.append(q[i])
                    near.append(ci[lo + j])
                    score.append(s[i, j])
            if not rows_:
                return
            r, c, s = (np.concatenate(z) for z in (rows_, near, score))
            by = np.lexsort((c, -s, r))
            r, c, s = r[by], c[by], s[by]
            keep = np.arange(len(r)) - np.searchsorted(r, r) <= k
            r, c, s = r[keep], c[keep], s[keep]
            which, first = np.unique(r, return_index=True)
            offsets = pa.array(np.append(first, len(r)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.ListArray.from_arrays(offsets, pa.array(c)), pa.ListArray.from_arrays(offsets, pa.array(s))], ["query_id", "ids", "scores"])

        # rows come sorted by cell, part and kind: candidates, then queries
        held, candidates, index, asked, n_asked = None, [], None, [], 0

        def flush():
            nonlocal index, asked, n_asked
            if asked and candidates:
                if index is None:
                    ci, cb, cx = (np.concatenate(z) for z in zip(*candidates, strict=True))
                    by = np.argsort(cb, kind="stable")
                    index = ci[by], cb[by], cx[by]
                yield from answer(asked, *index)
            asked, n_asked = [], 0

        for batch in batches:
            key = np.stack((batch["cell"].to_numpy(), batch["part"].to_numpy()), axis=1)
            kind, ids = batch["kind"].to_numpy(), batch["id"].to_numpy()
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held != tuple(key[a]):
                    yield from flush()
                    held, candidates, index = tuple(key[a]), [], None
                vec = np.frombuffer(b"".join(batch["vec"].slice(a, b - a).to_pylist()), dtype=kind_of).reshape(-1, d).astype(float)
                data, q = batch["bucket"].slice(a, b - a).to_pylist(), kind[a:b] == 1
                if (~q).any():
                    own = np.flatnonzero(~q)
                    candidates.append((ids[a:b][own], np.frombuffer(b"".join(data[i] for i in own.tolist()), dtype=np.int32), vec[own]))
                for i in np.flatnonzero(q).tolist():
                    asked.append((ids[a + i], np.frombuffer(data[i], dtype=np.int32), vec[i]))
                    n_asked += 1
                    if n_asked >= 1024:
                        yield from flush()
        yield from flush()

    entries = kept.mapInArrow(put(False), where).union(each.mapInArrow(put(True), where))
    found = entries.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    found = found.mapInArrow(search, "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = pairs.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
    lists = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    # each query of a group of equal ones gets the group's list without itself; all lists have at most k + 1 entries
    asked = queries.join(each.select("vec", F.col("id").alias("query_id")), "vec").select("id", "query_id")
    own = asked.join(lists, "query_id").select(F.col("id").alias("query_id"), F.filter("near", lambda e: e["id"] != F.col("id")).alias("near"))
    own = own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    out = nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 20 == 0)
    return out.withColumnRenamed("id", "vec_id")

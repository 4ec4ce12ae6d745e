"""Fill-in-middle transformation: a text is cut at two random token boundaries and its middle goes to the end.

A token is a word with the separators before it, or separators at the end of the text. So a token ends where a word
byte meets a separator, a predicate on two adjacent bytes, and at the end of the text. Texts are decomposed into chunks
of CHUNK bytes that overlap by one, so each pair of adjacent bytes lies in exactly one. Chunks count their boundaries and
their code points independently of each other; sums over the chunks before give the number of tokens and route each of
the two cut ranks to the chunk that owns it; only owning chunks are scanned again for the place of the cut.

A text of one chunk is counted and cut where it lies. Chunks of longer texts are dealt out over all tasks, their counts
are summed by a window, and ranks join the chunks they were routed to; one very long text keeps no task waiting.

Nulls: a null text is empty; a null id hashes as an empty string. Equal rows get equal results, each its own. Empty
texts and texts with a marker are plain. Very long texts are worked on whole. An empty table gives an empty one. Columns
of the input named like those added are replaced; all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import packed, table, unpacked, wide_key

#: Bytes of a chunk, without the one that it shares with the next.
CHUNK = 16 << 10
MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ADDED = ("n_tokens", "form", "prefix_chars", "middle_chars", "output")


def boundaries(chunk: np.ndarray, last: bool) -> np.ndarray:
    """Where tokens end in a chunk of bytes, which has one byte of the next unless it is the last of its text."""
    black = ~((chunk == 32) | ((chunk >= 9) & (chunk <= 13)))
    ends = np.flatnonzero(black[:-1] & ~black[1:]) + 1
    return np.append(ends, len(chunk)) if last and len(chunk) else ends


def chars(data: np.ndarray) -> int:
    """Code points that begin in some bytes of UTF-8."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _bytes(column: pa.Array) -> Iterator[np.ndarray]:
    for x in column:
        yield np.frombuffer(x.as_buffer(), dtype=np.uint8)


def _whole(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: their tokens, and the bytes and code points before both cuts."""
    for batch in batches:
        out = []
        for data, x, y in zip(_bytes(batch["data"]), batch["h1"].to_pylist(), batch["h2"].to_pylist(), strict=True):
            at = np.append(0, boundaries(data, True))
            n = len(at) - 1
            a, b = (int(at[k]) for k in sorted((x % (n + 1), y % (n + 1))))
            out.append((n, a, b, chars(data[:a]), chars(data[:b])))
        columns = np.array(out, dtype=np.int64).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *map(pa.array, columns)], [*names, *_CUTS])


_CUTS = ("n", "a", "b", "a_chars", "b_chars")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(len(boundaries(x, last)), chars(x if last else x[:-1])) for x, last in zip(_bytes(batch["piece"]), batch["last"].to_pylist(), strict=True)]
        n, c = np.array(out, dtype=np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([*(batch[k] for k in ("key", "chunk", "h1", "h2", "plain")), pa.array(n), pa.array(c)], ["key", "chunk", "h1", "h2", "plain", "n", "chars"])


def _rescanned(size: int):
    """A routed rank's place: bytes and code points before it, from what lies before its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, last, chunk, rank, before in zip(_bytes(batch["piece"]), *(batch[c].to_pylist() for c in ("last", "chunk", "rank", "before")), strict=True):
                at = int(boundaries(data, last)[rank - 1])
                out.append((chunk * size + at, before + chars(data[:at])))
            at, c = np.array(out, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch["key"], batch["cut"], pa.array(at), pa.array(c)], ["key", "cut", "at", "chars"])

    return run


def _spread(docs: DataFrame, size: int) -> DataFrame:
    """The cuts (key and _CUTS) of texts of several chunks, each key once; of plain ones n alone."""
    n_chunks = F.ceil(F.octet_length("data") / size).cast("int")
    rows = docs.select("key", "h1", "h2", "plain", "data", n_chunks.alias("n_chunks"), F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"))
    pieces = rows.select("key", "chunk", "h1", "h2", "plain", (F.col("chunk") == F.col("n_chunks") - 1).alias("last"), F.substring("data", F.col("chunk") * size + 1, F.lit(size + 1)).alias("piece"))
    pieces = pieces.repartition("key", "chunk")
    kind = docs.schema["key"].dataType.simpleString()
    counts = pieces.mapInArrow(_counted, f"key {kind}, chunk int, h1 long, h2 long, plain boolean, n long, chars long").dropDuplicates(["key", "chunk"])  # equal rows
    whole, upto = Window.partitionBy("key"), Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.select("*", F.sum("n").over(whole).alias("total"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n_before"), F.coalesce(F.sum("chars").over(upto), F.lit(0)).alias("before"))
    x, y = F.col("h1") % (F.col("total") + 1), F.col("h2") % (F.col("total") + 1)
    ranked = summed.withColumns({"ranks": F.array(F.least(x, y), F.greatest(x, y))})
    routed = ranked.where("NOT plain").select("key", "chunk", "before", "n_before", "n", F.posexplode("ranks").alias("cut", "rank"))
    routed = routed.where((F.col("rank") > F.col("n_before")) & (F.col("rank") <= F.col("n_before") + F.col("n")))
    routed = routed.select("key", "chunk", "cut", "before", (F.col("rank") - F.col("n_before")).alias("rank"))
    found = pieces.join(routed, ["key", "chunk"]).select("key", "chunk", "cut", "rank", "before", "last", "piece").mapInArrow(_rescanned(size), f"key {kind}, cut int, at long, chars long")
    zero, no = F.lit(0).cast("long"), F.lit(None).cast("long")
    both = summed.select("key", F.col("total").alias("n"), no.alias("a"), no.alias("b"), no.alias("a_chars"), no.alias("b_chars")).union(
        found.select("key", no, *(F.when(F.col("cut") == k, F.col(c)) for c in ("at", "chars") for k in (0, 1)))
    )
    # rank 0 is the start of the text and no chunk's
    return both.groupBy("key").agg(F.max("n").alias("n"), *(F.coalesce(F.max(c), zero).alias(c) for c in _CUTS[1:]))


def drawn(key: Column, i: int) -> Column:
    """The i-th of eight numbers of 32 bits that hang on a key alone."""
    return F.conv(F.substring(F.sha2(key, 256), 8 * i - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text, ...) with n_tokens, form, prefix_chars, middle_chars and output.

    rate percent of the texts are transformed, spm percent of these with the suffix first. All draws hang on seed and doc_id.
    """
    own = [c for c in docs.columns if c not in ADDED]
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for m in MARKERS.values():
        marked = marked | F.contains(text, F.lit(m))
    plain = (text == "") | marked | (drawn(key, 3) % 100 >= rate)
    rows = packed(docs.select(*own), "doc_id", "text").select("doc_id", "text", "_others", text.cast("binary").alias("data"), drawn(key, 1).alias("h1"), drawn(key, 2).alias("h2"), plain.alias("plain"), (drawn(key, 4) % 100 < spm).alias("spm"))
    names = rows.columns
    short = rows.where(F.octet_length("data") <= chunk)
    long = rows.where(F.octet_length("data") > chunk).withColumn("key", wide_key("doc_id", "text"))
    short = short.mapInArrow(lambda batches: _whole(names, batches), StructType([*rows.schema, *(StructField(c, LongType()) for c in _CUTS)]))
    both = short.unionByName(long.join(_spread(long, chunk), "key").drop("key"))
    data, a, b = F.col("data"), F.col("a").cast("int"), F.col("b").cast("int")
    prefix, middle, suffix = F.substring(data, F.lit(1), a), F.substring(data, a + 1, b - a), F.substring(data, b + 1, F.octet_length(data))
    mark = {k: F.lit(v).cast("binary") for k, v in MARKERS.items()}
    moved = F.when(F.col("spm"), F.concat(mark["suffix"], suffix, mark["prefix"], prefix, mark["middle"], middle)).otherwise(F.concat(mark["prefix"], prefix, mark["suffix"], suffix, mark["middle"], middle))
    form = F.when(F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm")
    return both.select(
        *unpacked(own, "doc_id", "text"), F.col("n").alias("n_tokens"), form.alias("form"),
        F.when(~F.col("plain"), F.col("a_chars")).alias("prefix_chars"), F.when(~F.col("plain"), F.col("b_chars") - F.col("a_chars")).alias("middle_chars"),
        F.when(F.col("plain"), data).otherwise(moved).cast("string").alias("output"),
    )


def restored(output: str, form: str) -> Column:
    """The text that an output of a form was made of. Markers begin and end with characters of their own, so none arises where parts meet."""
    parts = F.split(output, "<[PSM]>")
    get = lambda *order: F.concat(*(parts[i] for i in order))
    return F.when(F.col(form) == "psm", get(1, 3, 2)).when(F.col(form) == "spm", get(2, 3, 1)).otherwise(F.col(output))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, with hashes of the outputs and of the texts restored from them."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = F.sha2(restored("output", "form"), 256)
    return out.select("doc_id", F.col("n_tokens").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


ORACLE_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, len(ts) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(ts) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(ts) + 1) AS y,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(ts[1:least(x, y)], '') AS p, array_to_string(ts[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(ts[greatest(x, y) + 1:], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""

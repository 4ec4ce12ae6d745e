r"""Quality rules: counts of each document, and cross-document line frequency. DataFrame operations only.

Base: a document of fewer than MIN_WORDS words, or with over a fifth of its words in 5-word windows that repeat in it,
fails. Line frequency: lines are normalised (white space to single spaces, lower case) and hashed; a line that is in
more than LINE_SHARE of a host's documents, and in more than LINE_DOCS of them, is boilerplate there and is removed;
a document with fewer than LEFT_WORDS words, or LEFT_SHARE of its words, left is depleted and rejected.

Nulls: a null text is empty and fails the base rules; a null host is a host of its own. Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, counted, held, packed, staged, table, unpacked

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
LINE_DOCS, LINE_SHARE = 20, 0.05
LEFT_WORDS, LEFT_SHARE = 10, 0.1
#: Frequent lines up to which their table, 8 bytes a line and a name a host, is broadcast.
BROADCAST_LINES = 200_000


def _shifted(a: str) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def normal_lines(text: str | Column) -> Column:
    """The normalised lines of a text that have a word."""
    clean = F.transform(F.split(text, "\n"), lambda x: F.lower(F.btrim(F.regexp_replace(x, SEPARATORS, " "))))
    return F.filter(clean, lambda x: x != "")


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """_host and _frequent, the hashes of its lines above the limits. A host has at most (lines of its average document) / line_share of them."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(_host(host).alias("_host"), F.explode(F.array_distinct(F.transform(normal_lines(text_of), lambda x: F.xxhash64(x)))).alias("_line"))
    counts = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > line_docs)
    hosts = docs.select(_host(host).alias("_host")).groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    over = counts.join(hosts, "_host").where(F.col("_n") > F.col("_docs") * line_share)
    return over.groupBy("_host").agg(F.array_sort(F.collect_list("_line")).alias("_frequent"))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts and _lines, the hash and number of words of each normalised line; text must not be null."""
    c = F.col
    df = df.withColumns(
        {
            "_words": F.filter(F.split(text, SEPARATORS), lambda x: x != ""),
            "_raw": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_lines": F.transform(normal_lines(text), lambda x: F.struct(F.xxhash64(x).alias("h"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "))) + 1).alias("n"))),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    starts = F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1))
    grams = F.transform(starts, lambda i: F.xxhash64(*(F.element_at("_words", i + k) for k in range(WINDOW))))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_dup_lines": (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long"),
            "_grams": F.when(F.size("_words") >= WINDOW, grams),
        }
    ).drop("_words", "_raw")
    some = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumn("_sorted", F.when(some, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_grams")
    same = F.zip_with("_sorted", _shifted("_sorted"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))).drop("_sorted")
    # each repeated window covers the words up to the next one, or all of its own
    covered = F.zip_with("_at", _shifted("_at"), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(_total(covered), F.lit(0).cast("long"))).drop("_at")
    failed = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > REPEAT_PERCENT * c("n_words"))
    return df.withColumn("base_failed", failed)


def judged(docs: DataFrame, text: str = "text", host: str = "source", carry: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """Of every row of docs: the columns of carry, the base counts, base_failed, n_removed_words, kept and _frequent."""
    frequent = staged(frequent_lines(docs, text, host, **limits), "lines")
    few = (frequent.agg(F.sum(F.size("_frequent"))).first()[0] or 0) <= BROADCAST_LINES
    rows = docs.select(*carry, _host(host).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = held(features(rows, "_text"), "_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    if "text" not in carry:
        rows = rows.drop("_text")
    rows = rows.join(F.broadcast(frequent) if few else frequent, "_host", "left")
    removed = F.when(
        F.col("_frequent").isNotNull(),
        _total(F.transform(F.filter("_lines", lambda x: F.array_contains("_frequent", x["h"])), lambda x: x["n"].cast("long"))),
    ).otherwise(0)
    rows = rows.withColumn("n_removed_words", F.coalesce(removed, F.lit(0)).cast("long")).drop("_lines", "_host")
    left = F.col("n_words") - F.col("n_removed_words")
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= LEFT_WORDS) & (left >= F.col("n_words") * LEFT_SHARE))


def without_frequent(text: str, frequent: str) -> Column:
    """The text without its frequent lines."""
    normal = lambda x: F.xxhash64(F.lower(F.btrim(F.regexp_replace(x, SEPARATORS, " "))))
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(frequent, normal(x)))
    return F.when(F.col(frequent).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; the source is the host."""
    out = judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, without the lines above the limits."""
    out = judged(packed(docs, "text", "source"), carry=("text", "source", "_others")).where("kept")
    out = out.withColumn("text", without_frequent("text", "_frequent"))
    return out.select(*counted(docs, unpacked(docs.columns, "text", "source")))


def oracle(source: str = "documents") -> str:
    """CTEs of DuckDB SQL that end in verdicts(rid, doc_id, ..., kept) and frequent(host, line), over a table with a column rid."""
    norm = r"lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))"
    return rf"""
d AS (SELECT rid, doc_id, source, coalesce(text, '') AS text FROM {source}),
f AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS raw,
             list_filter(list_transform(string_split(text, chr(10)), lambda x: {norm}), lambda x: x <> '') AS lines,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM f),
h AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM g),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM h) WHERE n > 1),
c AS (SELECT rid, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
      FROM (SELECT *, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
frequent AS (SELECT e.source AS host, line FROM (SELECT source, line, count(*) AS n FROM (SELECT d.source, unnest(list_distinct(lines)) AS line FROM f JOIN d USING (rid)) GROUP BY ALL) e
             JOIN hosts ON e.source IS NOT DISTINCT FROM hosts.source WHERE n > {LINE_DOCS} AND n > docs * CAST({LINE_SHARE} AS DOUBLE)),
m AS (SELECT rid, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS n_removed_words
      FROM (SELECT f.rid, d.source, unnest(lines) AS line FROM f JOIN d USING (rid)) x
      WHERE EXISTS (SELECT 1 FROM frequent q WHERE q.host IS NOT DISTINCT FROM x.source AND q.line = x.line) GROUP BY rid),
b AS (SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(raw) - len(list_distinct(raw)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
      FROM d JOIN f USING (rid) LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)),
verdicts AS (SELECT *, NOT base_failed AND n_words - n_removed_words >= {LEFT_WORDS} AND n_words - n_removed_words >= n_words * CAST({LEFT_SHARE} AS DOUBLE) AS kept
             FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM b))"""


ORACLE_OP3 = f"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, * FROM documents), {oracle("rows_")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words FROM verdicts
"""

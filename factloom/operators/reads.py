"""Reads of the ledger: scope chains, nearest-scope resolution, as-of, lineage, full text, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chain(modes: DataFrame, scope: str, as_of: int | None = None) -> list[str]:
    """The scopes that answer for scope, nearest first; the nearest one in isolated mode is the last. modes: scope, mode, asserted_at."""
    parts = scope.split("/")
    paths = ["/".join(parts[:i]) for i in range(len(parts), 0, -1)]
    rows = modes.where(F.col("scope").isin(paths))
    if as_of is not None:
        rows = rows.where(F.col("asserted_at") <= as_of)
    last = {r["scope"]: r["mode"] for r in rows.groupBy("scope").agg(F.max_by("mode", "asserted_at").alias("mode")).collect()}  # one a path
    nearest = next((p for p in paths if p in last), None)
    return paths[: paths.index(nearest) + 1] if nearest and last[nearest] == "isolated" else paths


def live(ledger: DataFrame, as_of: int | None = None) -> DataFrame:
    """Rows that nothing supersedes, now or when the sequence stood at as_of."""
    if as_of is None:
        return ledger.where("superseded_by IS NULL")
    return ledger.where((F.col("asserted_at") <= as_of) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > as_of)))


def with_chain(rows: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Rows of the scopes of a chain, with ord, their place in it from 1."""
    place = F.create_map(*(F.lit(x) for i, s in enumerate(scopes) for x in (s, i + 1)))
    return rows.where(F.col("scope").isin(list(scopes))).withColumn("ord", place[F.col("scope")])


def take(ledger: DataFrame, scopes: Sequence[str], as_of: int | None = None, kind: str | None = None) -> DataFrame:
    """Of each subject and predicate the live rows of the nearest scope that has any; dead ones only if asked for. Ties stay.

    The nearest place is an aggregate joined back, so that a subject with very many rows is no large window.
    """
    rows = with_chain(live(ledger, as_of), scopes)
    rows = rows.where(F.col("kind") == kind) if kind else rows.where("kind <> 'dead'")
    nearest = rows.groupBy("subject", "predicate").agg(F.min("ord").alias("ord"))
    return rows.join(nearest, ["subject", "predicate", "ord"], "left_semi")


def contested(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows with contested: whether an open pair (a_id, b_id) names the row."""
    named = pairs.select(F.col("a_id").alias("id")).union(pairs.select(F.col("b_id").alias("id"))).distinct().withColumn("contested", F.lit(True))
    return rows.join(named, "id", "left").withColumn("contested", F.coalesce("contested", F.lit(False)))


def contested_few(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """contested for few rows: each is held against the live rows of its own key, and whether one speaks against it is all that comes back."""
    from .disputes import overlap

    key, c = ["scope", "subject", "predicate"], F.col
    few = rows.where("superseded_by IS NULL").select(*key, *(c(x).alias(f"_{x}") for x in ("id", "value", "valid_from", "valid_to")))
    others = live(ledger).select(*key, "id", "value", "valid_from", "valid_to").join(F.broadcast(few), key)  # a page of rows
    against = others.where((c("id") != c("_id")) & ~c("value").eqNullSafe(c("_value")) & overlap(c("_valid_from"), c("_valid_to"), c("valid_from"), c("valid_to")))
    named = against.select(c("_id").alias("id")).distinct().withColumn("contested", F.lit(True))
    return rows.join(F.broadcast(named), "id", "left").withColumn("contested", F.coalesce("contested", F.lit(False)))


def unresolvable_inputs(rows: DataFrame, ledger: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """rows with inputs_unresolvable: derived from an input that no scope of the chain has."""
    inputs = rows.where("confidence = 'derived'").select(F.col("id").alias("_row"), F.explode("derived_from").alias("id"))
    known = ledger.where(F.col("scope").isin(list(scopes))).select("id")
    missing = inputs.join(known, "id", "left_anti").select(F.col("_row").alias("id")).distinct().withColumn("inputs_unresolvable", F.lit(True))
    return rows.join(missing, "id", "left").withColumn("inputs_unresolvable", F.coalesce("inputs_unresolvable", F.lit(False)))


def chain_heads(ledger: DataFrame) -> DataFrame:
    """id, head and hops of every row: the end of its chain of supersession and how far it is. Rows know their chain and place; a chain's last is an aggregate."""
    last = ledger.groupBy("chain").agg(F.max_by(F.struct("id", "place"), F.struct("place", "id")).alias("_last"))
    return ledger.select("id", "chain", "place").join(last, "chain").select("id", F.col("_last.id").alias("head"), (F.col("_last.place") - F.col("place")).alias("hops"))


def search(ledger: DataFrame, text: Column, words: Sequence[str]) -> DataFrame:
    """Live rows whose text has a word of the query, with rank: distinct words found over all words of the text."""
    tokens = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")
    found = F.size(F.array_intersect(F.array(*map(F.lit, words)), tokens))
    return live(ledger).withColumn("rank", F.round(found / F.size(tokens), 6)).where(found > 0)


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows and the count of all of them."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def mode_of(modes: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """mode, in one row: the newest of the nearest scope of a chain that has any, else shared."""
    now = with_chain(newest(modes.select("scope", "mode", "asserted_at"), ["scope"], ["asserted_at"]), scopes)
    return now.agg(F.coalesce(F.min_by("mode", "ord"), F.lit("shared")).alias("mode"))


def flipped(modes: DataFrame, sequence: DataFrame) -> DataFrame:
    """Rows to append to modes (scope, mode, asserted_at) that turn every scope's mode into the other; sequence has one row, the last asserted_at, from which they go on in the order of scope."""
    now = newest(modes.select("scope", "mode", "asserted_at"), ["scope"], ["asserted_at"])
    other = F.when(F.col("mode") == "isolated", "shared").otherwise("isolated")
    place = F.row_number().over(Window.orderBy("scope"))  # scopes are few
    return now.crossJoin(F.broadcast(sequence.toDF("_last"))).select("scope", other.alias("mode"), (F.col("_last") + place).alias("asserted_at"))  # one row


def subtree(rows: DataFrame, root: str) -> DataFrame:
    return rows.where((F.col("scope") == root) | F.col("scope").startswith(f"{root}/"))


def scopes_in_use(registered: DataFrame, ledger: DataFrame) -> DataFrame:
    """Registered and used scopes, each with its count of live rows."""
    used = live(ledger).groupBy("scope").agg(F.count(F.lit(1)).alias("n_live"))
    known = registered.select("scope").distinct().withColumn("registered", F.lit(True))
    out = known.join(used, "scope", "full")
    return out.select("scope", F.coalesce("registered", F.lit(False)).alias("registered"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of the largest order of each key, as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*keys, "_top.*")


def keep_newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """df with doomed: beyond the n newest of its key."""
    return df.withColumn("doomed", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > n)


def empty_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "scope string, mode string, asserted_at long")


def answered(ledger: DataFrame, scopes: Sequence[str], subject: str | None = None, predicate: str | None = None, kind: str | None = None, as_of: int | None = None, limit: int = 50) -> DataFrame:
    """The whole read: of each subject and predicate the live rows of the nearest scope, with contested and inputs_unresolvable, deepest scope first, then the newest; limit at most.

    Filters come before the nearest scope is chosen. contested is as of now, also for reads of the past. The rows are
    cut to limit before they are flagged, so flags are looked up for few.
    """
    rows = ledger
    for c, v in (("subject", subject), ("predicate", predicate)):
        rows = rows if v is None else rows.where(F.col(c) == v)
    depth = F.size(F.split("scope", "/"))
    top = take(rows, scopes, as_of, kind).withColumn("depth", depth).orderBy(F.desc("depth"), F.desc("asserted_at"), F.desc("id")).limit(min(max(limit, 1), 500))
    flagged = unresolvable_inputs(contested_few(top, ledger), ledger, scopes)
    return flagged.orderBy(F.desc("depth"), F.desc("asserted_at"), F.desc("id"))


def walked(ledger: DataFrame, row: int) -> DataFrame:
    """The rows of the chain of supersession that a row is in, of any length, by the chain that rows know."""
    own = ledger.where(F.col("id") == row).select("chain")
    return ledger.join(F.broadcast(own), "chain", "left_semi")  # one row


def contradictions_of(ledger: DataFrame, row: int) -> DataFrame:
    """a_id and b_id of the open contradictions of a live row: its key's other live rows, held against it alone."""
    from .disputes import overlap

    one = live(ledger).where(F.col("id") == row).select("scope", "subject", "predicate", *(F.col(c).alias(f"_{c}") for c in ("id", "value", "valid_from", "valid_to")))
    others = live(ledger).join(F.broadcast(one), ["scope", "subject", "predicate"])  # one row
    c = F.col
    other = others.where((c("id") != c("_id")) & ~c("value").eqNullSafe(c("_value")) & overlap(c("_valid_from"), c("_valid_to"), c("valid_from"), c("valid_to")))
    return other.select(F.least("id", "_id").alias("a_id"), F.greatest("id", "_id").alias("b_id"))


def why(ledger: DataFrame, verifications: DataFrame, row: int) -> DataFrame:
    """A row with its last verification, the length of its chain, and the number of its contradictions. Each part is read by the row's own key or chain."""
    one = ledger.where(F.col("id") == row).select("id", "scope", "subject", "predicate", "confidence", "kind")
    last = verifications.where(F.col("target") == row).groupBy(F.col("target").alias("id")).agg(F.max_by("outcome", F.struct("checked_at", "id")).alias("outcome"))
    chain_ = walked(ledger, row).agg(F.count(F.lit(1)).alias("chain_length"))
    named = contradictions_of(ledger, row).agg(F.count(F.lit(1)).alias("contradictions"))
    return one.join(last, "id", "left").crossJoin(F.broadcast(chain_)).crossJoin(F.broadcast(named))  # one row each


def pairs_of(pairs: DataFrame, row: int) -> DataFrame:
    return pairs.where((F.col("a_id") == row) | (F.col("b_id") == row))


def found_on(ledger: DataFrame, scopes: Sequence[str], text: Column, words: Sequence[str], limit: int = 25, exclude_dead: bool = False) -> DataFrame:
    """search on the scopes of a chain, best rank first, then the newest; limit at most. Dead rows count unless excluded, and nearest scopes do not hide others."""
    rows = search(ledger.where(F.col("scope").isin(list(scopes))), text, words)
    rows = rows.where("kind <> 'dead'") if exclude_dead else rows
    return rows.orderBy(F.desc("rank"), F.desc("asserted_at"), F.desc("id")).limit(min(max(limit, 1), 200))


def state(ledger: DataFrame, pairs: DataFrame, evaluated: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """What stands on a chain, in one row: the sequence, live rows, those of each class, binding ones, open contradictions, gates reached, missed and awaiting evidence."""
    here = live(ledger).where(F.col("scope").isin(list(scopes)))
    n = lambda when: F.count_if(when)
    counts = here.agg(F.count(F.lit(1)).alias("n_live"), *(n(F.col("confidence") == c).alias(c.replace("-", "_")) for c in ("measured", "derived", "unverified", "confirmed-by-human")), n(F.col("binding")).alias("binding"))
    at = ledger.agg(F.max("asserted_at").alias("sequence"))
    disputes_ = pairs.where(F.col("scope").isin(list(scopes))).agg(F.count(F.lit(1)).alias("contradictions"))
    gates = evaluated.agg(n(F.col("reached")).alias("reached"), n(~F.col("reached")).alias("missed"), n(F.col("reached").isNull()).alias("awaiting"))
    return counts.crossJoin(at).crossJoin(disputes_).crossJoin(gates)  # one row each


def enforced_rules(ledger: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Rules and constraints that a chain answers with, binding ones first, then the deepest, the newest, the subject."""
    both = take(ledger, scopes, kind="rule").unionByName(take(ledger, scopes, kind="constraint"))
    return both.orderBy(F.desc("binding"), F.desc(F.size(F.split("scope", "/"))), F.desc("asserted_at"), "subject", "id")


def packed_lines(lines: DataFrame, budget: int) -> DataFrame:
    """Lines (place, text, mandatory) within a budget of bytes: mandatory ones all, others in order of place while they and what comes before fit. A line takes its bytes and a line end.

    Lines are few, the answer to one question, so one window sums them.
    """
    size = F.octet_length("text") + 1
    must = lines.where("mandatory").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_must"))
    run = Window.partitionBy("mandatory").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("_upto", F.sum(size).over(run)).crossJoin(F.broadcast(must))  # one row
    return out.where(F.col("mandatory") | (F.col("_must") + F.col("_upto") <= budget)).drop("_upto", "_must")

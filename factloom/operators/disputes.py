"""Contradictions by overlap of periods, and machine-checkable gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reads import live, with_chain

KEY = ("scope", "subject", "predicate")


def overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Half-open periods; a null end never ends."""
    return (b_to.isNull() | (a_from < b_to)) & (a_to.isNull() | (b_from < a_to))


def open_pairs(ledger: DataFrame) -> DataFrame:
    """Pairs of live rows of one key whose periods overlap and whose values differ. A key has few live rows, so this is an equality join."""
    rows = live(ledger)
    a = rows.select(*KEY, *(F.col(c).alias(f"a_{c}") for c in ("id", "confidence", "value", "valid_from", "valid_to")))
    b = rows.select(*KEY, *(F.col(c).alias(f"b_{c}") for c in ("id", "confidence", "value", "valid_from", "valid_to")))
    pairs = a.join(b, list(KEY)).where("a_id < b_id").where(~F.col("a_value").eqNullSafe(F.col("b_value")))
    pairs = pairs.where(overlap(F.col("a_valid_from"), F.col("a_valid_to"), F.col("b_valid_from"), F.col("b_valid_to")))
    return pairs.select(*KEY, "a_id", "b_id", "a_confidence", "b_confidence", F.concat_ws("|", "a_id", "b_id").alias("pair_key"))


def history(ledger: DataFrame, tiers: Sequence[str]) -> DataFrame:
    """Every pair that was a contradiction when its later row came, and whether it still is one.

    A tier has one live row of a key at a time, its last, so each row is held against the last row of every other tier:
    one window instead of a join of all rows of a key.
    """
    before = Window.partitionBy(*KEY).orderBy("asserted_at").rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct("id", "tier", "value", "valid_from", "valid_to", "superseded_by")
    lasts = F.array(*(F.last(F.when(F.col("tier") == t, row), ignorenulls=True).over(before) for t in tiers))
    pairs = ledger.withColumn("_lasts", lasts).withColumn("a", F.explode("_lasts")).where("a IS NOT NULL AND a.tier <> tier")
    pairs = pairs.where(~F.col("a.value").eqNullSafe(F.col("value"))).where(overlap(F.col("a.valid_from"), F.col("a.valid_to"), F.col("valid_from"), F.col("valid_to")))
    closed = F.col("a.superseded_by").isNotNull() | F.col("superseded_by").isNotNull()
    return pairs.select(*KEY, F.col("a.id").alias("a_id"), F.col("id").alias("b_id"), F.when(closed, "superseded").otherwise("open").alias("status"))


def evaluate(gates: DataFrame, ledger: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """gates (mission, gate, subject, predicate, op, target, requires_confidence) with reached, actual, unit, evidence, resolved_scope and why_null.

    Numbers are compared as such; of other values, text in target or value, = and != compare the text and order is null. The evidence is the live measured row of exactly the class asked for, of the nearest scope, the newest first; without it
    reached is null. All gates are answered by one join with an aggregate.
    """
    rows = with_chain(live(ledger), scopes).where("kind = 'measured'")
    unit = F.col("unit") if "unit" in ledger.columns else F.lit(None).cast("string")
    rows = rows.withColumn("unit", unit)
    best = rows.groupBy("subject", "predicate", F.col("confidence").alias("requires_confidence")).agg(F.min_by(F.struct("value", "unit", "id", "scope"), F.struct("ord", -F.col("asserted_at"))).alias("_e"))
    x, y = F.col("_e.value"), F.col("target")
    p, q = number(x), number(y)
    # as decimals where both are such, so that long numbers are told apart
    m, n = (F.when(v.isNotNull(), c.try_cast("decimal(38,18)")) for v, c in ((p, x), (q, y)))
    plain = F.when(F.col("op") == "=", x.cast("string") == y.cast("string")).when(F.col("op") == "!=", ~x.cast("string").eqNullSafe(y.cast("string")))
    reached = F.when(m.isNotNull() & n.isNotNull(), _compared(m, n)).when(p.isNotNull() & q.isNotNull(), _compared(p, q)).otherwise(plain)
    reached = F.when(F.col("_e.id").isNotNull(), reached)
    out = gates.join(best, ["subject", "predicate", "requires_confidence"], "left")
    why = F.when(F.col("_e.id").isNull(), "no live assertion of the required confidence class in scope")
    return out.select(*gates.columns, reached.alias("reached"), x.alias("actual"), F.col("_e.unit").alias("unit"), F.col("_e.id").alias("evidence"), F.col("_e.scope").alias("resolved_scope"), why.alias("why_null"))


def number(c: Column) -> Column:
    """A value or text as a number; null where it is none."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def _compared(x: Column, y: Column) -> Column:
    return F.when(F.col("op") == ">=", x >= y).when(F.col("op") == "<=", x <= y).when(F.col("op") == ">", x > y).when(F.col("op") == "<", x < y).when(F.col("op") == "=", x == y).when(F.col("op") == "!=", x != y)


def missions(evaluated: DataFrame) -> DataFrame:
    """Per mission: gates, those reached, not reached, and without evidence."""
    return evaluated.groupBy("mission").agg(
        F.count(F.lit(1)).alias("gates"),
        F.count_if(F.col("reached")).alias("reached"),
        F.count_if(~F.col("reached")).alias("missed"),
        F.count_if(F.col("reached").isNull()).alias("awaiting"),
    )


def live_scopes(rows: DataFrame) -> DataFrame:
    """The scopes of missions (id, scope, supersedes) that none supersedes: where a reader of all scopes has to look."""
    later = rows.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"))
    return rows.join(later, "id", "left_anti").select("scope").distinct()


def duplicates(rows: DataFrame, keys: Sequence[str], order: str, row: str) -> DataFrame:
    """Rows of a key beyond the first, with the first one's id."""
    first = rows.groupBy(*keys).agg(F.min_by(row, F.struct(order, row)).alias("keeps"))
    return rows.join(first, list(keys)).where(F.col(row) != F.col("keeps"))


def on_chain(missions_: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """Live missions of a chain, the nearest scope first, then the oldest."""
    return with_chain(missions_.where("superseded_by IS NULL"), scopes).orderBy("ord", "asserted_at", "id")


def listed(pairs: DataFrame, resolutions: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """Contradictions with their status, open unless a resolution (pair_key, status, resolved_by, at) closes them, the last one counting; those of a status, newest first."""
    last = resolutions.where(F.col("resolved_by").isNotNull()).groupBy("pair_key").agg(F.max_by(F.struct("status", "resolved_by"), F.struct("at", "status")).alias("r"))
    out = pairs.join(last, "pair_key", "left").withColumn("status", F.coalesce("r.status", F.lit("open"))).withColumn("resolved_by", F.col("r.resolved_by")).drop("r")
    return out.where(F.col("status") == status).orderBy(F.desc(F.greatest("a_id", "b_id")), "pair_key").limit(min(max(limit, 1), 500))


def contradiction_id(pair_key: str) -> Column:
    """An id that a pair always has."""
    return F.concat(F.lit("c_"), F.substring(F.sha2(pair_key, 256), 1, 26))

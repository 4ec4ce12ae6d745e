"""Admission of assertions: a batch splits into accepted rows and rows with the first reason that refuses them."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("measured", "target", "rule", "constraint", "state", "untried", "failed", "dead")
CLASSES = ("measured", "confirmed-by-human", "derived", "unverified")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def rules() -> list[tuple[str, Column]]:
    """The reasons, in order of precedence, and when each applies."""
    c = F.col
    return [
        ("confidence_is_earned", c("confidence").isin("measured", "derived") & ~c("is_verifier")),
        ("confidence_known", c("confidence").isNull() | ~c("confidence").isin(*CLASSES)),
        ("derived_requires_inputs", (c("confidence") == "derived") & (F.coalesce(F.size("derived_from"), F.lit(0)) < 1)),
        ("episode_evidence_is_never_measured", c("confidence").isin("measured", "derived") & c("source").startswith("episode:")),
        ("evidence_required", _blank("source")),
        ("failed_requires_reopen_if", (c("kind") == "failed") & _blank("reopen_if")),
        ("failure_requires_why", c("kind").isin("failed", "dead") & _blank("why")),
        ("human_evidence_names_a_human", (c("confidence") == "confirmed-by-human") & _blank("human")),
        ("kind_known", c("kind").isNull() | ~c("kind").isin(*KINDS)),
        ("measured_requires_verification", (c("confidence") == "measured") & c("verification_id").isNull()),
        ("predicate_present", _blank("predicate")),
        ("scope_shape", c("scope").isNull() | ~c("scope").rlike("^[A-Za-z0-9_.-]+(/[A-Za-z0-9_.-]+)*$")),
        ("subject_present", _blank("subject")),
        ("valid_period_ordered", c("valid_to").isNotNull() & (c("valid_to") <= c("valid_from"))),
    ]


def reasons(rows: DataFrame, without: str | None = None) -> DataFrame:
    """rows with reason, null where none refuses them. without leaves one rule out."""
    return rows.withColumn("reason", F.coalesce(*(F.when(when, F.lit(name)) for name, when in rules() if name != without)))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    judged = reasons(rows)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


class Periods:
    """The periods of one key that no other overlaps: [a, b) of each row that holds one."""

    def __init__(self):
        self.starts, self.ends, self.of = [], [], {}

    def put(self, row: int, a: int, b: int) -> bool:
        """Whether the period is free; then row holds it."""
        at = bisect.bisect_left(self.starts, b)
        if at and self.ends[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        self.of[row] = (a, b)
        return True

    def free(self, row: int) -> tuple[int, int] | None:
        """Takes back what row holds."""
        period = self.of.pop(row, None)
        if period:
            at = bisect.bisect_left(self.starts, period[0])
            del self.starts[at], self.ends[at]
        return period


FOREVER = 1 << 62
_FOLDED = "key string, turn long, event int, id long, own string, hash string, known long, machine boolean, a long, b long, target long, near boolean, standing string, taken_by long"


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a row-by-row insert says of the rows of each key: id, reason, existing and holder (who has the target already).

    Rows come sorted by key and turn. event 0: a live row of the ledger holds its period. 1: a row asks for admission.
    2: a row of another key supersedes the target, which is this key's. near: the target is of the row's own key, so the
    fold knows its fate; else standing and taken_by say what is known of it. A task holds the live periods of one key
    and the ids and hashes it accepted.
    """
    held, periods, accepted, hashes, taken = None, Periods(), set(), {}, {}
    for batch in batches:
        out = []
        for key, _, event, i, own, digest, known, machine, a, b, target, near, standing, taken_by in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
            if key != held:
                held, periods, accepted, hashes, taken = key, Periods(), set(), {}, {}
            if event == 0:
                periods.put(i, a, b)
                continue
            if event == 2:
                if target not in taken:
                    taken[target] = i
                    periods.free(target)
                continue
            reason, existing, holder = None, None, None
            if target is not None:
                holder = taken.get(target) if near else taken_by if taken_by is not None and taken_by < i else None
                there = standing == "head" or near and target in accepted
                if standing == "superseded" or there and holder is not None:
                    reason = "supersedes_target_already_superseded"
                elif not there:
                    reason = "supersedes_target_not_found"
            reason = reason or own
            if reason is None:
                existing = known if known is not None or digest is None else hashes.get(digest)
            if reason is None and existing is None:
                freed = periods.free(target) if near else None
                if machine and not periods.put(i, a, b):
                    reason = "no_two_live_contradictions"
                    if freed:
                        periods.put(target, *freed)
                else:
                    accepted.add(i)
                    hashes.setdefault(digest, i)
                    if near:
                        taken[target] = i
            out.append((i, reason, existing, holder))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["id", "reason", "existing", "holder"])


def key_of() -> Column:
    return F.concat_ws("\u0001", "scope", "subject", "predicate")


def _rows(rows: DataFrame, event: int, **columns: Column) -> DataFrame:
    """rows as fold reads them, ledger rows before all others of their key."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    have = {
        "key": key_of(), "turn": F.lit(None) if event == 0 else F.col("id"), "event": F.lit(event), "id": F.col("id"), "machine": F.coalesce(F.col("confidence").isin("measured", "derived"), F.lit(False)),
        "a": micros("valid_from"), "b": F.coalesce(micros("valid_to"), F.lit(FOREVER)),
    }
    have |= columns
    return rows.select(*(have.get(n, F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in _FOLDED.split(", "))))


def folded(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "event").mapInArrow(fold, "id long, reason string, existing long, holder long")


def exclusion(rows: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """id and accepted of machine-tier rows: a row is refused if its period overlaps that of a live row of its key, or of one accepted before it.

    A row that supersedes one of its key frees that one's period, if it is accepted. Rows come sorted by key, live ones
    first, and id, and are folded as they stream by.
    """
    machine = F.col("confidence").isin("measured", "derived")
    target = F.col("supersedes") if "supersedes" in rows.columns else F.lit(None)
    both = _rows(rows.where(machine), 1, target=target, near=target.isNotNull(), standing=F.when(target.isNotNull(), "head"))
    if live is not None:
        both = _rows(live.where(machine), 0).union(both)
    return folded(both).select("id", F.col("reason").isNull().alias("accepted"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with hash, of their contents as JSON with sorted keys; null fields stay in."""
    return rows.withColumn("hash", F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256))


def unseen(rows: DataFrame, ledger: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key that the ledger lacks."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first")).select(*keys, "_first.*")
    return first.join(ledger.select(*keys).distinct(), keys, "left_anti")

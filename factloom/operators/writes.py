"""The ledger's write path: batches of assertions are decided as a whole and committed at once; nothing is ever changed.

A decision is what a row-by-row insert in the order of id would say: supersession first (the target exists, in the ledger
or among the rows accepted before, and is a head), then the row's own checks, then a hash that the ledger or an accepted
row has, and last the exclusion of overlapping periods. A row that falls leaves its target as it was.

A store is a folder with a log of commits. A commit is a small file named by its version, which exactly one writer can
put there; it names a batch and the folder of what the batch decided and added, written before. Readers see the batches
of the log alone, so all tables of a batch appear together, and a writer that fails leaves nothing to be seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import Conflict, Log
from ..sources.tables import joined, looked_up, with_supersession
from . import admission

#: The fields whose contents are an assertion's identity.
IDENTITY = ("scope", "subject", "predicate", "value", "kind", "confidence", "source", "why", "reopen_if", "valid_from", "valid_to", "supersedes")


def _hashed(batch: DataFrame) -> DataFrame:
    return admission.content_hash(batch, [c for c in IDENTITY if c in batch.columns])


def _standing(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """batch (supersedes) with standing of the target in the ledger (head, superseded, null if it is not there), the key that the target has there or in the batch, and holder, the row of the ledger that supersedes it."""
    there = ledger.select(F.col("id").alias("supersedes"), admission.key_of().alias("_there"), F.col("superseded_by").alias("_by"))
    mine = batch.select(F.col("id").alias("supersedes"), admission.key_of().alias("_mine"))
    asked = batch.where("supersedes IS NOT NULL").select("supersedes").distinct()
    known = joined(joined(asked, there, "supersedes", "left"), mine.dropDuplicates(["supersedes"]), "supersedes", "left")
    known = known.select("supersedes", F.when(F.col("_there").isNull(), None).when(F.col("_by").isNull(), "head").otherwise("superseded").alias("standing"), F.coalesce("_there", "_mine").alias("target_key"), F.col("_by").alias("ledger_holder"))
    return looked_up(batch, known, "supersedes")


def decided(batch: DataFrame, ledger: DataFrame, without: str | None = None) -> DataFrame:
    """batch with hash, reason (null: not refused), existing (the id of the row that an equal one already is) and holder (of a target already superseded).

    Ids are unique in a batch. Rows that ask for no target, hold no period and are nobody's target are decided by their checks and hashes alone. The others are
    folded by key, in order. What rows of other keys do to a key is taken from the round before, so rounds go on until no
    decision changes: a decision hangs on smaller ids only, so that is the one that a row-by-row insert gives. Mostly
    rows supersede rows of their own key, and the second round changes nothing.
    """
    rows = _hashed(admission.reasons(batch, without).withColumnRenamed("reason", "own"))
    known = ledger.select("hash", F.col("id").alias("known")).groupBy("hash").agg(F.min("known").alias("known")) if "hash" in ledger.columns else None
    rows = joined(rows, known, "hash", "left") if known is not None else rows.withColumn("known", F.lit(None).cast("long"))
    machine = F.coalesce(F.col("confidence").isin("measured", "derived"), F.lit(False))
    simple = F.col("supersedes").isNull() & (~machine | F.col("own").isNotNull())
    first = rows.where(simple & F.col("own").isNull()).groupBy("hash").agg(F.min("id").alias("_first"))
    asked = rows.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct().withColumn("_asked", F.lit(True))
    rows = joined(joined(rows, first, "hash", "left"), asked, "id", "left")
    rows = rows.withColumn("known", F.coalesce("known", F.when(F.col("_first") < F.col("id"), F.col("_first"))))
    serial = ~simple | F.coalesce("_asked", F.lit(False))
    rows = rows.withColumn("_serial", serial).drop("_first", "_asked").checkpoint()

    plain = rows.where("NOT _serial").withColumn("existing", F.when(F.col("own").isNull(), F.col("known")))
    plain = plain.withColumnRenamed("own", "reason").withColumn("holder", F.lit(None).cast("long"))

    asking = _standing(rows.where("_serial").drop("_serial"), ledger).withColumn("key", admission.key_of()).withColumn("near", F.coalesce(F.col("key") == F.col("target_key"), F.lit(False))).checkpoint()
    held = admission._rows(ledger.where(F.col("superseded_by").isNull() & F.col("confidence").isin("measured", "derived")), 0)
    held = joined(held, asking.select("key").distinct(), "key", "left_semi").select(held.columns).checkpoint()
    far = asking.where("supersedes IS NOT NULL AND NOT near")
    # of the round before: accepted rows of other keys, which of the targets they ask for are accepted rows of the batch, and their number and sum of hashes
    accepted, digest = None, None
    while True:
        taken = accepted.groupBy("supersedes").agg(F.min("id").alias("_taken")) if accepted is not None else None
        now = asking.withColumn("taken_by", F.lit(None).cast("long"))
        events = None
        if accepted is not None:
            mine = accepted.select(F.col("id").alias("supersedes")).distinct().withColumn("_in", F.lit(True))
            now = looked_up(asking, joined(mine, taken, "supersedes", "full"), "supersedes")
            in_batch = F.col("standing").isNull() & F.coalesce(F.col("_in"), F.lit(False)) & (F.col("supersedes") < F.col("id"))
            now = now.withColumn("taken_by", F.col("_taken")).withColumn("standing", F.when(~F.col("near") & in_batch, "head").otherwise(F.col("standing")))
            others = joined(far, accepted.select("id"), "id", "left_semi")
            events = admission._rows(others, 2, key=F.col("target_key"), target=F.col("supersedes"))
        ask = admission._rows(now, 1, own=F.col("own"), hash=F.col("hash"), known=F.col("known"), target=F.col("supersedes"), near=F.col("near"), standing=F.col("standing"), taken_by=F.col("taken_by"))
        both = held.unionByName(ask) if events is None else held.unionByName(ask).unionByName(events)
        found = admission.folded(both).checkpoint()
        if far.isEmpty():
            break
        new = joined(asking.select("id", "supersedes"), found.where("reason IS NULL AND existing IS NULL").select("id"), "id", "left_semi").checkpoint()
        now_digest = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id").cast("decimal(38,0)"))).first()
        if now_digest == digest:
            break
        accepted, digest = new, now_digest
    hard = joined(asking.drop("key", "near", "standing", "target_key").withColumnRenamed("own", "_own"), found, "id").withColumn("holder", F.coalesce("holder", "ledger_holder")).drop("_own", "ledger_holder")
    columns = [*batch.columns, "hash", "reason", "existing", "holder"]
    hard = hard.withColumn("holder", F.when(F.col("reason") == "supersedes_target_already_superseded", F.col("holder")))
    return plain.select(*columns).unionByName(hard.select(*columns))


def admitted(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """decided rows; those whose id the ledger has already are refused if their contents are others, as a stored row is never rewritten, and else are the row that is there."""
    there = ledger.select("id", F.col("hash").alias("_hash"))
    again = joined(_hashed(batch), there, "id").withColumn("holder", F.lit(None).cast("long"))
    again = again.withColumn("reason", F.when(F.col("_hash") != F.col("hash"), "assertions_are_immutable")).withColumn("existing", F.when(F.col("_hash") == F.col("hash"), F.col("id")))
    new = decided(joined(batch, there.select("id"), "id", "left_anti").select(*batch.columns), ledger)
    return new.unionByName(again.select(*new.columns))


def chained(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """rows (id, supersedes) with chain, the id that their chain of supersession began with, and place, how many came before in it.

    Targets in the ledger have both already. Chains within rows are followed by doubling, in log2 of the longest.
    """
    there = ledger.select(F.col("id").alias("supersedes"), F.col("chain").alias("_chain"), F.col("place").alias("_place"))
    p = looked_up(rows.select("id", "supersedes"), there, "supersedes")
    root = F.when(F.col("supersedes").isNull(), F.col("id")).otherwise(F.col("_chain"))
    p = p.select("id", root.alias("chain"), F.when(F.col("supersedes").isNull(), 0).otherwise(F.col("_place") + 1).cast("long").alias("place"), F.when(root.isNull(), F.col("supersedes")).alias("next"), F.lit(1).cast("long").alias("hops")).checkpoint()
    while not p.where("next IS NOT NULL").isEmpty():
        on = p.select(F.col("id").alias("next"), F.col("chain").alias("_chain"), F.col("place").alias("_place"), F.col("next").alias("_next"), F.col("hops").alias("_hops"))
        q = looked_up(p, on, "next")
        p = q.select("id", F.coalesce("chain", "_chain").alias("chain"), F.coalesce("place", F.col("_place") + F.col("hops")).alias("place"), F.when(F.col("chain").isNull() & F.col("_chain").isNull(), F.col("_next")).alias("next"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")).checkpoint()
    return joined(rows, p.select("id", "chain", "place"), "id")


class Store:
    """The append-only tables below one folder: assertions, outbox, rejections, and the verdicts of every batch.

    spark.checkpoint.dir or any other folder that Hadoop's file systems reach. Versions count from 1.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        """schema: the columns of assertions, those that the store adds left out."""
        self.spark, self.log, self.schema = spark, Log(spark, folder), schema

    _OWN = {"outbox": "seq long, topic string, id long, scope string", "rejections": "id long, reason string, message string", "verdicts": "id long, reason string, existing long, holder long"}

    def commits(self) -> list[dict]:
        """The log in order: version, batch, folder, last (the sequence so far), rows and digest. A line a batch."""
        return self.log.commits()

    def _read(self, name: str, log: list[dict] | None = None) -> DataFrame:
        schema = self._OWN.get(name, f"{self.schema}, hash string, asserted_at long, chain long, place long")
        paths = [f"{c['folder']}/{name}" for c in (self.commits() if log is None else log)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def assertions(self, log: list[dict] | None = None) -> DataFrame:
        return with_supersession(self._read("assertions", log))

    def outbox(self) -> DataFrame:
        return self._read("outbox")

    def rejections(self) -> DataFrame:
        return self._read("rejections")

    def verdicts(self, batch: str | None = None) -> DataFrame:
        """What was said of the rows of a batch, or of all."""
        return self._read("verdicts", [c for c in self.commits() if batch is None or c["batch"] == batch])

    def append(self, batch: DataFrame, name: str | None = None) -> DataFrame:
        """Decides a batch and commits it: id, reason, existing and holder of every row.

        A batch whose name is committed already is not decided again: its stored verdicts come back. If another writer
        commits first, the batch is decided anew on what is there then. asserted_at goes on from the log's last, in the
        order of id, with which rows come in time: no global sort.
        """
        name = name or uuid.uuid4().hex
        while True:
            log = self.commits()
            if any(c["batch"] == name for c in log):
                return self.verdicts(name)
            try:
                self._append(batch, name, log)
            except Conflict:
                continue
            return self.verdicts(name)

    def _append(self, batch: DataFrame, name: str, log: list[dict]) -> None:
        folder, last = self.log.new_folder(), log[-1]["last"] if log else 0
        before = self.assertions(log)
        verdicts = admitted(batch, before).checkpoint()
        least, most = batch.agg(F.min("id"), F.max("id")).first()
        new = chained(verdicts.where("reason IS NULL AND existing IS NULL"), before)
        rows = new.withColumn("asserted_at", F.col("id") - F.lit(least or 0) + last + 1)
        columns = [c.split()[0] for c in self.schema.split(",")]
        rows.select(*columns, "hash", "asserted_at", "chain", "place").write.parquet(f"{folder}/assertions")
        self.spark.read.schema(f"{self.schema}, hash string, asserted_at long").parquet(f"{folder}/assertions").select(F.col("asserted_at").alias("seq"), F.lit("assertion.created").alias("topic"), "id", "scope").write.parquet(f"{folder}/outbox")
        refused = verdicts.where("reason IS NOT NULL")
        heads = before.where("superseded_by IS NULL").select(F.col("chain").alias("_chain"), F.col("id").alias("_head"))
        asked = looked_up(looked_up(refused, before.select(F.col("id").alias("supersedes"), F.col("chain").alias("_chain")), "supersedes"), heads, "_chain")
        head = F.when(F.col("reason") == "supersedes_target_already_superseded", F.concat(F.lit("head: "), F.coalesce("_head", "holder").cast("string")))
        asked.select("id", "reason", F.substring(F.concat_ws(" ", F.lit("refused:"), "reason", "scope", "subject", head), 1, 2000).alias("message")).write.parquet(f"{folder}/rejections")
        verdicts.select("id", "reason", "existing", "holder").write.parquet(f"{folder}/verdicts")
        n, digest = self._digest(self.spark.read.parquet(f"{folder}/assertions")).first()
        self.log.commit({"version": len(log) + 1, "batch": name, "folder": folder, "last": last + ((most - least + 1) if most is not None else 0), "rows": n, "digest": digest})

    @staticmethod
    def _digest(rows: DataFrame) -> DataFrame:
        """How many rows there are, and a number that any change of theirs changes."""
        return rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64("id", "hash", "asserted_at", "chain", "place").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))

    def tampered(self) -> list[tuple[str, str]]:
        """Batches whose assertions are no longer what was committed, with the rule that it breaks. One pass over ids and hashes."""
        log = self.commits()
        found = {}
        if log:
            rows = self._read("assertions", log).withColumn("_file", F.input_file_name())
            found = {r["folder"].rsplit("/", 1)[-1]: r for r in rows.groupBy(F.regexp_extract("_file", "/data/([0-9a-f]+)/", 1).alias("folder")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("id", "hash", "asserted_at", "chain", "place").cast("decimal(38,0)")).cast("string").alias("digest")).collect()}
        out = []
        for c in log:  # a line a batch
            r = found.get(c["folder"].rsplit("/", 1)[-1], {"rows": 0, "digest": "0"})
            if (r["rows"], r["digest"]) != (c["rows"], c["digest"]):
                out.append((c["batch"], "assertions_are_append_only" if r["rows"] < c["rows"] else "assertions_are_immutable"))
        return out


def versions(missions: DataFrame) -> DataFrame:
    """missions (id, supersedes) with version: one more than that of the mission superseded.

    Chains are followed by doubling, in log2 of the longest: a mission whose way on is open adds what the one that it
    has come to knows. A way that leads to no mission is dropped, as are those in a circle: when a round neither ends
    nor drops one, only these are left.
    """
    p = missions.select("id", F.col("supersedes").alias("up"), F.lit(1).alias("version")).checkpoint()
    done, open_ = p.where("up IS NULL"), p.where("up IS NOT NULL")
    before, left = None, open_.count()
    while left and left != before:
        on = done.union(open_).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("version").alias("_more"))
        p = joined(open_, on, "up").select("id", F.col("_up").alias("up"), (F.col("version") + F.col("_more")).alias("version")).checkpoint()
        done, open_ = done.union(p.where("up IS NULL")), p.where("up IS NOT NULL")
        before, left = left, open_.count()
    return joined(missions, done.select("id", "version"), "id")


def retractions(doomed: DataFrame, reason: str, columns: Sequence[str] = ("scope", "subject", "predicate")) -> DataFrame:
    """Rows to append that close the doomed ones: dead assertions that supersede them and say why."""
    return doomed.select(*columns, F.col("id").alias("supersedes"), F.lit("dead").alias("kind"), F.lit("unverified").alias("confidence"), F.lit(reason).alias("why"))

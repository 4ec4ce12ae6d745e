"""Preferences learned from repeated feedback, as a table that only grows: promotions and their assertions, and rejections.

A promotion is planned in a table of its own, with the id of the assertion that it will be, and then asserted under the
same name. It is in force once the ledger has taken the assertion, so both appear together; one that was stopped halfway
is finished when it is sent again.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.appended import Appended, in_force, numbered
from . import people, records
from .writes import Store

#: The subject and predicate under which preferences are asserted.
SUBJECT, PREDICATE = "preference:", "prefers"
PLANS = "id long, scope string, signature string, tier string, occasions long, humans long, binding boolean, first_seen timestamp_ntz, last_seen timestamp_ntz, latest string, human string, supersedes long"
DECISIONS = "preference_id long, status string, decided_at timestamp_ntz"


def plain(text: str) -> str:
    """text in NFKC and lower case, runs of white space as one space, none at its ends."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower()).strip()


def canonical(value) -> str:
    """A JSON value as text that neither the order of keys nor case nor spacing changes; the order of a list does."""
    if isinstance(value, str):
        return json.dumps(plain(value), ensure_ascii=False)
    if isinstance(value, dict):
        keys = sorted((plain(k), canonical(v)) for k, v in value.items())
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return json.dumps(int(value) if isinstance(value, float) and value.is_integer() else value)


def signature(subject: Column, predicate: Column, correction: Column) -> Column:
    """What makes two corrections (JSON) one: subject|predicate|sha256, all normalised, with | and \\ escaped in the first two. Null if any is null or the correction is no JSON.

    Normal forms have no built-in function, so this is an Arrow-batched one over short texts.
    """

    @F.pandas_udf("string")
    def signed(s: pd.Series, p: pd.Series, c: pd.Series) -> pd.Series:
        def one(subject, predicate, correction):
            try:
                digest = hashlib.sha256(canonical(json.loads(correction)).encode("utf-8", "surrogatepass")).hexdigest()
            except (TypeError, ValueError):
                return None
            fields = None if subject is None or predicate is None else [re.sub(r"[\\|]", lambda m: "\\" + m[0], plain(x)) for x in (subject, predicate)]
            return fields and "|".join([*fields, digest])

        return pd.Series([one(*x) for x in zip(s, p, c, strict=True)], dtype=object)

    return signed(subject, predicate, correction)


class Preferences:
    """The preferences of a ledger, in a folder."""

    def __init__(self, store: Store, folder: str):
        self.store = store
        self.plans, self.decisions = Appended(store.spark, f"{folder}/plans", PLANS), Appended(store.spark, f"{folder}/decisions", DECISIONS)

    def rows(self, plans: DataFrame | None = None) -> DataFrame:
        """The preferences whose assertion the ledger took and that none supersedes, with status: active, or what was decided last."""
        taken = self.store.verdicts().where("reason IS NULL").select("id")
        mine = (self.plans.rows() if plans is None else plans).join(taken, "id", "left_semi")
        return people.rejected(in_force(mine).withColumn("status", F.lit("active")), self.decisions.rows())

    def decide(self, decisions: DataFrame, name: str) -> DataFrame:
        """Records decisions (preference_id, status, decided_at); a rejected preference's signature is not promoted again in its scope."""
        return self.decisions.append(decisions, name)

    def promote(self, feedback: DataFrame, name: str, least: int = 2) -> DataFrame:
        """Promotes what feedback repeats (scope, signature, actor, value, created_at, id): the rows of this promotion, with refused, why the ledger took one not.

        Nothing is done for rejected signatures, unchanged counts and lower tiers. Each assertion supersedes that of the
        preference it follows, is binding if it is the organisation's, and names the first who said it: a list of all
        could be of any length.
        """
        key = ["scope", "signature"]

        def planned(had: DataFrame) -> DataFrame:
            found = people.preference_candidates(feedback, least)
            first = feedback.groupBy(*key).agg(F.min_by("actor", F.struct("created_at", "id")).cast("string").alias("human"))
            new = people.promotions(found, self.rows(had)).where(F.col("action").isin("create", "supersede"))
            new = new.join(found.select(*key, "first_seen", "last_seen", F.col("latest").cast("string").alias("latest")), key).join(first, key)
            last = max(x or 0 for x in (had.agg(F.max("id")).first()[0], self.store.assertions().agg(F.max("id")).first()[0]))
            return numbered(new.withColumn("_order", F.concat_ws("\u0001", *key)), "_order", "id", last + 1)

        plans = self.plans.append(planned, name)
        c = F.col
        said = plans.select(
            "id", "scope", F.concat(F.lit(SUBJECT), "signature").alias("subject"), F.lit(PREDICATE).alias("predicate"), c("occasions").cast("double").alias("value"), F.lit("rule").alias("kind"), F.lit("confirmed-by-human").alias("confidence"),
            F.concat(c("occasions").cast("string"), F.lit(" occasions, the last saying "), F.coalesce("latest", F.lit("nothing"))).alias("source"), "human", F.concat(c("occasions").cast("string"), F.lit(" occasions from "), c("humans").cast("string"), F.lit(" humans earned tier "), "tier").alias("why"), "supersedes",
        )
        verdicts = self.store.append(records.batch(said), name).select("id", F.col("reason").alias("refused"))
        return plans.join(verdicts, "id")

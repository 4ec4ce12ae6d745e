"""The verification pass: unverified rows are held against what repositories hold, and what comes of it is recorded.

A pass records a verification of every row it looked at, and appends to the ledger, as the verifier: a measured row that
supersedes each confirmed one, and the outcome, where it is another than before, as a row of its own that supersedes the
outcome before it. Verifications land first, under the pass's name; a pass that was stopped between the two goes on from
them when it is run again under that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.appended import Appended, numbered
from . import people, records
from .reads import live
from .writes import Store

#: The subject and predicate under which outcomes are asserted.
OUTCOME_SUBJECT, OUTCOME_PREDICATE = "assertion:", "verification_outcome"
#: The columns of verifications.
CHECKS = "id long, target long, outcome string, reason string, missing string, default_branch string, on_default_branch boolean, checked_at timestamp_ntz, last_outcome string"


def judged(rows: DataFrame, evidence: DataFrame, repos: DataFrame, commits: DataFrame) -> DataFrame:
    """rows (id and others) with outcome, reason, missing, default_branch and on_default_branch.

    evidence: id, repo, commit_sha, refs that it claims to be contained in (null: none). repos: repo, default_branch of
    those that could be read. commits: repo, commit_sha, contained_in, the refs that hold each. One of each a key.
    Only a repository that was read refutes anything: a claim without a commit, or of a repository that could not be
    read, is unresolvable, not false. A commit that is not there, or not where the evidence says, is refuted.
    """
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    e = evidence.select("id", trimmed("repo").alias("repo"), trimmed("commit_sha").alias("commit_sha"), "refs")
    seen = repos.select("repo", "default_branch", F.lit(True).alias("_read"))
    there = commits.select("repo", "commit_sha", F.coalesce("contained_in", F.array().cast("array<string>")).alias("_in"))
    out = rows.join(e, "id", "left").join(seen, "repo", "left").join(there, ["repo", "commit_sha"], "left")
    missing = F.array_sort(F.array_except(F.coalesce("refs", F.array().cast("array<string>")), F.col("_in")))
    reason = F.when(F.col("commit_sha").isNull(), "no_commit_in_evidence").when(F.col("_read").isNull(), "repository_unreadable").when(F.col("_in").isNull(), "commit_not_found").when(F.size(missing) > 0, "not_contained")
    outcome = F.when(reason.isin("no_commit_in_evidence", "repository_unreadable"), "unresolvable").when(reason.isNotNull(), "refuted").otherwise("confirmed")
    return out.select(*rows.columns, outcome.alias("outcome"), reason.alias("reason"), F.when(reason == "not_contained", F.array_join(missing, ",")).alias("missing"), "default_branch", F.array_contains("_in", F.col("default_branch")).alias("on_default_branch"))


def due(ledger: DataFrame, checks: DataFrame, before: Column, limit: int | None = None) -> DataFrame:
    """id, asserted_at and last_outcome of the rows to look at, the oldest limit of them if a limit is given."""
    rows = people.verification_candidates(ledger, checks, before)
    return rows.orderBy("asserted_at", "id").limit(limit) if limit else rows


def promoted(checks: DataFrame, ledger: DataFrame) -> DataFrame:
    """The measured rows that supersede the confirmed ones, with the id of their check. The source of one that is not on the default branch says so: it tells of a branch, not of the product."""
    own = checks.where("outcome = 'confirmed'").select(F.col("target").alias("_target"), F.col("id").alias("_check"), "default_branch", "on_default_branch")
    rows = ledger.join(own, F.col("id") == F.col("_target"))
    branch = F.when(F.col("on_default_branch") == F.lit(False), F.concat(F.lit(" (branch only, not on "), "default_branch", F.lit(")")))
    keep = [c for c in ("scope", "subject", "predicate", "value", "kind", "human", "why", "reopen_if", "valid_from", "valid_to") if c in ledger.columns]
    return rows.select(F.col("_check").alias("id"), *keep, F.concat("source", F.coalesce(branch, F.lit(""))).alias("source"), F.lit("measured").alias("confidence"), F.col("id").alias("supersedes"), F.col("_check").alias("verification_id"))


def outcomes(checks: DataFrame, ledger: DataFrame, places: int) -> DataFrame:
    """The outcomes that differ from the last ones as rows: measured states that supersede the live ones of their key. value: 1 confirmed, 0 refuted, null unresolvable."""
    new = checks.where(~F.col("outcome").eqNullSafe(F.col("last_outcome")))
    rows = new.join(ledger.select(F.col("id").alias("target"), "scope"), "target").withColumn("subject", F.concat(F.lit(OUTCOME_SUBJECT), F.col("target").cast("string")))
    prior = live(ledger).where(F.col("predicate") == OUTCOME_PREDICATE).groupBy("scope", "subject").agg(F.max_by("id", "asserted_at").alias("supersedes"))
    said = F.concat_ws(": ", F.col("outcome"), "reason", "missing")
    value = F.when(F.col("outcome") == "confirmed", 1.0).when(F.col("outcome") == "refuted", 0.0)
    rows = rows.join(prior, ["scope", "subject"], "left")
    return rows.select((F.col("id") + places).alias("id"), "scope", "subject", F.lit(OUTCOME_PREDICATE).alias("predicate"), value.alias("value"), F.lit("state").alias("kind"), F.lit("measured").alias("confidence"), F.concat(F.lit("verification:"), F.col("id").cast("string")).alias("source"), said.alias("why"), F.col("checked_at").alias("valid_from"), "supersedes", F.col("id").alias("verification_id"))


def run(store: Store, checks: Appended, evidence: DataFrame, repos: DataFrame, commits: DataFrame, name: str, now: Column, before: Column, limit: int | None = None) -> DataFrame:
    """One pass: target, outcome, reason, verification_id, promoted_to (the measured row, null unless one was taken) and refused, why the ledger did not take it.

    now: the time of the checks. before: rows checked before it are looked at again, unless they have no commit. Ids are
    dealt from the ledger's last on: first the checks and the rows they promote, then the outcomes. A pass whose name is
    there already returns what it said.
    """
    ledger = store.assertions()

    def looked(had: DataFrame) -> DataFrame:
        last = max(ledger.agg(F.max("id")).first()[0] or 0, had.agg(F.max("id")).first()[0] or 0)
        found = judged(due(ledger, had, before, limit), evidence, repos, commits).withColumnRenamed("id", "target")
        return numbered(found, "target", "id", last + 1).withColumn("checked_at", now)

    said = checks.append(looked, name)
    n, least, most = said.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    places = (most - least + 1) if n else 0
    batch = records.batch(promoted(said, ledger)).unionByName(records.batch(outcomes(said, ledger, places)), allowMissingColumns=True).withColumn("is_verifier", F.lit(True))
    verdicts = store.append(batch, name).select("id", F.when(F.col("reason").isNull(), F.coalesce("existing", "id")).alias("promoted_to"), F.col("reason").alias("refused"))
    rows = said.select("target", "outcome", "reason", F.col("id").alias("verification_id"))
    return rows.join(verdicts, rows["verification_id"] == verdicts["id"], "left").drop("id")

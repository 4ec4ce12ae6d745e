"""Preferences promoted from repeated feedback, the worker fleet, and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reads import live


def preference_candidates(feedback: DataFrame, least: int = 2) -> DataFrame:
    """Of each scope and signature with at least least events: occasions, people, tier, and the latest correction."""
    out = feedback.groupBy("scope", "signature").agg(
        F.count(F.lit(1)).alias("occasions"), F.countDistinct("actor").alias("humans"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.max_by("value", F.struct("created_at", "id")).alias("latest")
    )
    tier = F.when(F.col("humans") >= 3, "org").when(F.col("humans") == 2, "team").otherwise("personal")
    return out.where(F.col("occasions") >= least).withColumn("tier", tier)


def nearest_preference(candidates: DataFrame, scopes: list[str]) -> DataFrame:
    """Of each signature the candidate of the nearest scope of the chain."""
    place = F.create_map(*(F.lit(x) for i, s in enumerate(scopes) for x in (s, i)))
    rows = candidates.where(F.col("scope").isin(scopes)).withColumn("distance", place[F.col("scope")])
    return rows.groupBy("signature").agg(F.min_by(F.struct("scope", "tier", "occasions", "distance"), "distance").alias("x")).select("signature", "x.*")


def fleet(nodes: DataFrame, activity: DataFrame, claims: DataFrame, now: Column, stale_seconds: int = 300, scopes: list[str] | None = None) -> DataFrame:
    """Workers in service, of the scopes if given: alive or not (by the last time seen without a heartbeat; never seen is not), the latest activity, and the paths they hold, oldest claim first."""
    latest = activity.groupBy("node_id").agg(F.max_by(F.struct("statement", "occurred_at"), "seq").alias("a"))
    held = claims.where("NOT released").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("claimed_at", "path"))).alias("held"))
    nodes = nodes.where("NOT retired") if scopes is None else nodes.where("NOT retired").where(F.col("scope").isin(scopes))
    out = nodes.join(latest, "node_id", "left").join(held, "node_id", "left")
    seen = F.coalesce("heartbeat_at", "last_seen") if "last_seen" in nodes.columns else F.col("heartbeat_at")
    age = F.timestamp_diff("SECOND", seen, now)
    return out.select("node_id", "label", "scope", F.coalesce(age < stale_seconds, F.lit(False)).alias("live"), age.alias("seconds_ago"), F.col("a.statement").alias("activity"), F.col("a.occurred_at").alias("activity_at"), F.coalesce(F.array_join(F.transform("held", lambda x: x["path"]), ","), F.lit("")).alias("paths"))


def collisions(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths that several workers in service hold: how many, and since when. An aggregate, as pairs grow with the square."""
    held = claims.where("NOT released").join(nodes.where("NOT retired").select("node_id"), "node_id", "left_semi")
    return held.groupBy("path").agg(F.countDistinct("node_id").alias("holders"), F.min("claimed_at").alias("since")).where("holders > 1")


def contenders(claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each held claim of a path that others in service hold too, with others, their ids: a set a path, of which a claim's own holder is left out."""
    held = claims.where("NOT released").join(nodes.where("NOT retired").select("node_id"), "node_id", "left_semi")
    all_ = held.groupBy("path").agg(F.array_sort(F.collect_set("node_id")).alias("_all")).where(F.size("_all") > 1)
    return held.join(all_, "path").select("claim_id", "node_id", "path", F.array_remove("_all", F.col("node_id")).alias("others"))


def latest_verification(verifications: DataFrame) -> DataFrame:
    return verifications.groupBy("target").agg(F.max_by(F.struct("outcome", "reason", "checked_at"), F.struct("checked_at", "id")).alias("v")).select("target", "v.*")


def verification_candidates(ledger: DataFrame, verifications: DataFrame, before: Column) -> DataFrame:
    """Live unverified rows that were never checked, or last checked before the given time for a reason that may change."""
    rows = live(ledger).where("confidence = 'unverified'").select("id", "asserted_at")
    v = latest_verification(verifications)
    out = rows.join(v, rows["id"] == v["target"], "left")
    again = (~F.col("reason").eqNullSafe(F.lit("no_commit_in_evidence"))) & (F.col("checked_at") < before)
    return out.where(F.col("target").isNull() | again).select("id", "asserted_at", F.col("outcome").alias("last_outcome"))


def shadowed(ledger: DataFrame) -> DataFrame:
    """Live unverified rows whose key also has a live measured row."""
    key = ["scope", "subject", "predicate"]
    rows = live(ledger)
    return rows.where("confidence = 'unverified'").join(rows.where("confidence = 'measured'").select(*key), key, "left_semi")


def promotions(candidates: DataFrame, preferences: DataFrame) -> DataFrame:
    """What becomes of each candidate: create, supersede (with the live preference's id), or skip and why.

    preferences: id, scope, signature, tier, occasions, humans, status. Rejected signatures are never promoted again;
    nothing is recorded where nothing changed; a tier is never lowered. An org preference is binding.
    """
    key = ["scope", "signature"]
    dead = preferences.where("status = 'rejected'").select(*key).distinct().withColumn("_dead", F.lit(True))
    live = preferences.where("status = 'active'").select(*key, F.struct("id", "tier", "occasions", "humans").alias("_live"))
    rank = lambda c: F.when(c == "org", 3).when(c == "team", 2).otherwise(1)
    l, c = F.col("_live"), F.col  # noqa: E741
    same = (l["tier"] == c("tier")) & (l["occasions"] == c("occasions")) & (l["humans"] == c("humans"))
    action = F.when(c("_dead"), "skip_rejected").when(same, "skip_unchanged").when(rank(c("tier")) < rank(l["tier"]), "skip_lower_tier").when(l.isNotNull(), "supersede").otherwise("create")
    out = candidates.join(dead, key, "left").join(live, key, "left").withColumn("action", action)
    return out.select(*key, "tier", "occasions", "humans", "action", F.when(F.col("action") == "supersede", l["id"]).alias("supersedes"), (c("tier") == "org").alias("binding"))


def rejected(preferences: DataFrame, decisions: DataFrame) -> DataFrame:
    """preferences with the status that the last decision (preference_id, status, decided_at) gives; append-only."""
    last = decisions.groupBy(F.col("preference_id").alias("id")).agg(F.max_by("status", F.struct("decided_at", "status")).alias("_status"))
    return preferences.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def active(preferences: DataFrame, scopes: list[str]) -> DataFrame:
    """Of each signature the active preference of the nearest scope of the chain, nearest first, then binding, then the last seen."""
    place = F.create_map(*(F.lit(x) for i, s in enumerate(scopes) for x in (s, i)))
    rows = preferences.where(F.col("scope").isin(scopes) & (F.col("status") == "active")).withColumn("distance", place[F.col("scope")])
    best = rows.groupBy("signature").agg(F.min_by(F.struct("id", "scope", "tier", "binding", "last_seen", "distance"), F.struct("distance", "id")).alias("x")).select("signature", "x.*")
    return best.orderBy("distance", F.desc("binding"), F.desc("last_seen"), "id")


def cited(preferences: DataFrame, ledger: DataFrame) -> DataFrame:
    """preferences with the confidence and kind of the assertion that each cites, if any."""
    return preferences.join(ledger.select(F.col("id").alias("assertion_id"), F.col("confidence").alias("assertion_confidence"), F.col("kind").alias("assertion_kind")), "assertion_id", "left")


def feedback_counts(feedback: DataFrame, key: list[str]) -> DataFrame:
    return feedback.groupBy(*key).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("actor").alias("humans"), F.countDistinct("occasion").alias("days"))


def registered(events: DataFrame) -> DataFrame:
    """Nodes from a log (event, kind, scope, label, at): one a kind, scope and label, however often announced, until retired. A later announcement begins a new life."""
    key = ["kind", "scope", "label"]
    out = events.groupBy(*key).agg(
        F.max(F.when(F.col("event") == "announce", F.col("at"))).alias("announced_at"),
        F.max(F.when(F.col("event") != "retire", F.col("at"))).alias("heartbeat_at"),
        F.max(F.when(F.col("event") == "retire", F.col("at"))).alias("_retired"),
    )
    gone = F.col("_retired").isNotNull() & (F.col("announced_at").isNull() | (F.col("announced_at") <= F.col("_retired")))
    return out.where(F.col("announced_at").isNotNull() | F.col("heartbeat_at").isNotNull()).select(*key, "announced_at", "heartbeat_at", gone.alias("retired"))


def reported(nodes: DataFrame, activity: DataFrame) -> DataFrame:
    """nodes whose heartbeat_at is moved on by what they report (activity: node_id, occurred_at): who says what it does is alive. It never moves back."""
    said = activity.groupBy("node_id").agg(F.max("occurred_at").alias("_said"))
    return nodes.join(said, "node_id", "left").withColumn("heartbeat_at", F.greatest("heartbeat_at", "_said")).drop("_said").select(nodes.columns)


def held_paths(log: DataFrame) -> DataFrame:
    """Claims from a log (node_id, path, event: claim, release or retire, at): the live ones and since when. Claiming again changes nothing; retiring, whose path is null, releases all."""
    each = log.where("event <> 'retire'").groupBy("node_id", "path").agg(F.max(F.when(F.col("event") == "release", F.col("at"))).alias("_freed"), F.array_sort(F.collect_set(F.when(F.col("event") == "claim", F.col("at")))).alias("_claims"))
    gone = log.where("event = 'retire'").groupBy("node_id").agg(F.max("at").alias("_gone"))
    out = each.join(gone, "node_id", "left").withColumn("_end", F.greatest("_freed", "_gone"))
    since = F.array_min(F.filter("_claims", lambda t: F.col("_end").isNull() | (t > F.col("_end"))))
    return out.withColumn("claimed_at", since).where("claimed_at IS NOT NULL").select("node_id", "path", "claimed_at")


def verified(candidates: DataFrame, commits: DataFrame) -> DataFrame:
    """Verdicts on candidates (id, commit_sha): confirmed if the commit is an ancestor of its repository's head, refuted if it is known not to be, else unresolvable and why."""
    out = candidates.join(commits.select("commit_sha", "is_ancestor"), "commit_sha", "left")
    outcome = F.when(F.col("is_ancestor"), "confirmed").when(~F.col("is_ancestor"), "refuted").otherwise("unresolvable")
    reason = F.when(F.col("commit_sha").isNull(), "no_commit_in_evidence").when(F.col("is_ancestor").isNull(), "commit_unknown")
    return out.select("id", outcome.alias("outcome"), reason.alias("reason"))


def changed(verdicts: DataFrame, verifications: DataFrame) -> DataFrame:
    """Verdicts that differ from the last one recorded: only these are asserted."""
    last = latest_verification(verifications).select(F.col("target").alias("id"), F.col("outcome").alias("_last"))
    return verdicts.join(last, "id", "left").where(~F.col("outcome").eqNullSafe(F.col("_last"))).drop("_last")

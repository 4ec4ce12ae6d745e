"""Registered queries on the ledger's reads and writes and on what its tables refuse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import admission, checks, disputes, people, reads, writes
from ..sources import seeds
from ..sources import tables as t
from ..streaming import jobs
from . import talk
from .catalogue import _GATE_SQL, _OVERLAP, CHAIN, _gates, query
from .talk import _RESUME

_PAIRS = f"""pairs AS (SELECT scope, a.id AS a_id, b.id AS b_id, a.id || '|' || b.id AS pair_key, b.asserted_at AS at FROM live a JOIN live b USING (scope, subject, predicate)
 WHERE a.id < b.id AND a.value IS DISTINCT FROM b.value AND {_OVERLAP})"""


def _pairs(spark, d) -> DataFrame:
    return disputes.open_pairs(t.ledger(spark, d))


@query(f"""WITH {_PAIRS}, c AS (SELECT l.*, ord, min(ord) OVER (PARTITION BY subject, predicate) AS best FROM live l JOIN chain USING (scope) WHERE kind <> 'dead'),
top AS (SELECT *, len(string_split(scope, '/')) AS depth FROM c WHERE ord = best ORDER BY depth DESC, asserted_at DESC, id DESC LIMIT 50)
SELECT id, scope, subject, predicate, kind, confidence, value, CAST(depth AS INT) AS depth, id IN (SELECT a_id FROM pairs UNION ALL SELECT b_id FROM pairs) AS contested,
 confidence = 'derived' AND EXISTS (SELECT 1 FROM unnest(derived_from) u(x) WHERE x NOT IN (SELECT id FROM ledger JOIN chain USING (scope))) AS inputs_unresolvable FROM top""")
def take_api(spark: SparkSession, d: str) -> DataFrame:
    led = t.ledger(spark, d)
    return reads.answered(led, CHAIN).select("id", "scope", "subject", "predicate", "kind", "confidence", "value", "depth", "contested", "inputs_unresolvable")


@query(f"""WITH {_PAIRS}, back AS (SELECT id, supersedes FROM ledger WHERE id = 100 UNION SELECT l.id, l.supersedes FROM ledger l JOIN back b ON l.id = b.supersedes),
forth AS (SELECT id, superseded_by FROM ledger WHERE id = 100 UNION SELECT l.id, l.superseded_by FROM ledger l JOIN forth f ON l.id = f.superseded_by)
SELECT id, scope, subject, predicate, confidence, kind, (SELECT outcome FROM verifications WHERE target = 100 ORDER BY checked_at DESC, id DESC LIMIT 1) AS outcome,
 (SELECT count(*) FROM (SELECT id FROM back UNION SELECT id FROM forth)) AS chain_length, (SELECT count(*) FROM pairs WHERE a_id = 100 OR b_id = 100) AS contradictions FROM ledger WHERE id = 100""")
def why_bundle(spark, d):
    led = t.ledger(spark, d)
    return reads.why(led, t.verifications(spark, d), 100)


@query(r"""WITH w AS (SELECT live.*, list_filter(regexp_split_to_array(lower(subject || ' ' || predicate || ' ' || kind), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM live JOIN chain USING (scope))
SELECT id, kind, round(len(list_intersect(['purchase', 'state', '7'], ws)) / len(ws), 6) AS rank FROM w WHERE len(list_intersect(['purchase', 'state', '7'], ws)) > 0 ORDER BY rank DESC, asserted_at DESC LIMIT 25""")
def search_chain(spark, d):
    return reads.found_on(t.ledger(spark, d), CHAIN, F.concat_ws(" ", "subject", "predicate", "kind"), ["purchase", "state", "7"]).select("id", "kind", "rank")


@query("SELECT count(*) AS n FROM live JOIN chain USING (scope) WHERE binding")
def binding_count(spark, d):
    return reads.live(t.ledger(spark, d)).where(F.col("scope").isin(CHAIN) & F.col("binding")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PAIRS}, {_GATE_SQL}, h AS (SELECT * FROM live JOIN chain USING (scope))
SELECT (SELECT count(*) FROM h) AS n_live, (SELECT count(*) FROM h WHERE confidence = 'measured') AS measured, (SELECT count(*) FROM h WHERE confidence = 'derived') AS derived, (SELECT count(*) FROM h WHERE confidence = 'unverified') AS unverified,
 (SELECT count(*) FROM h WHERE confidence = 'confirmed-by-human') AS confirmed_by_human, (SELECT count(*) FROM h WHERE binding) AS binding, (SELECT max(asserted_at) FROM ledger) AS sequence,
 (SELECT count(*) FROM pairs JOIN chain USING (scope)) AS contradictions, (SELECT count(*) FROM evaluated WHERE reached) AS reached, (SELECT count(*) FROM evaluated WHERE NOT reached) AS missed, (SELECT count(*) FROM evaluated WHERE reached IS NULL) AS awaiting""")
def state_of_chain(spark, d):
    led = t.ledger(spark, d)
    return reads.state(led, disputes.open_pairs(led), _gates(spark, d), CHAIN)


@query(f"""WITH {_PAIRS}, {_GATE_SQL}, {_RESUME}, h AS (SELECT * FROM live JOIN chain USING (scope)), orders_ AS (SELECT o_orderkey AS id, o_orderstatus AS st, ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + o_custkey % 3] AS scope, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders)
SELECT (SELECT count(*) FROM h) AS n_live, (SELECT count(*) FROM h WHERE binding) AS binding, (SELECT max(asserted_at) FROM ledger) AS sequence, (SELECT count(*) FROM pairs JOIN chain USING (scope)) AS contradictions, (SELECT count(*) FROM evaluated WHERE reached) AS reached,
 (SELECT count(*) FROM orders_ JOIN chain USING (scope) WHERE nxt IS NULL AND st <> 'F') AS missions, coalesce((SELECT m.mode FROM modes m JOIN chain USING (scope) ORDER BY ord LIMIT 1), 'shared') AS mode, r.session, r.thread, r.questions, r.drift FROM resumed r""")
def state_bundle(spark, d):
    """All that a chain's state says, in one row: counts, gates, live missions, the mode that holds, and where the last session was left."""
    led = t.ledger(spark, d)
    counts = reads.state(led, disputes.open_pairs(led), _gates(spark, d), CHAIN).select("n_live", "binding", "sequence", "contradictions", "reached")
    missions = disputes.on_chain(t.missions(spark, d), CHAIN).where("state <> 'closed'").agg(F.count(F.lit(1)).alias("missions"))
    mode = reads.mode_of(t.modes(spark, d), CHAIN)
    resume = talk.resume_of(spark, d).select("session", "thread", "questions", "drift")
    return counts.crossJoin(missions).crossJoin(mode).crossJoin(resume)  # one row each


@query(f"WITH {_GATE_SQL} SELECT mission, gate, subject, predicate FROM evaluated WHERE evidence IS NULL")
def gate_no_evidence(spark, d):
    return _gates(spark, d).where("why_null IS NOT NULL").select("mission", "gate", "subject", "predicate")


@query(f"WITH {_GATE_SQL} SELECT mission, count(*) AS awaiting FROM evaluated WHERE requires_confidence = 'confirmed-by-human' AND reached IS DISTINCT FROM true GROUP BY mission")
def awaiting_human(spark, d):
    rows = _gates(spark, d).where("requires_confidence = 'confirmed-by-human'").where(~F.col("reached").eqNullSafe(F.lit(True)))
    return rows.groupBy("mission").agg(F.count(F.lit(1)).alias("awaiting"))


_TEXTS = ("20000000", "2.0e7", "1e-5", "green", "12345678901234567", "-0.0000000001", "5")
_OPS = (">=", "<=", ">", "<", "=", "!=")


@query(f"""WITH g AS (SELECT c_custkey AS gate, 'user:' || (c_custkey % 23) AS subject, ['purchase', 'click', 'view', 'error', 'signup'][1 + c_custkey % 5] AS predicate, {list(_OPS)}[1 + c_custkey % 6] AS op, {list(_TEXTS)}[1 + c_custkey % 7] AS target FROM customer),
v AS (SELECT *, CASE id % 8 WHEN 7 THEN '12345678901234568' ELSE {list(_TEXTS)}[1 + id % 8] END AS said FROM live JOIN chain USING (scope) WHERE kind = 'measured' AND confidence = 'measured'
 QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY ord, asserted_at DESC) = 1),
p AS (SELECT g.gate, op, target, said, TRY_CAST(said AS DOUBLE) IS NOT NULL AND TRY_CAST(target AS DOUBLE) IS NOT NULL AS numbers, TRY_CAST(said AS DECIMAL(38, 18)) AS a, TRY_CAST(target AS DECIMAL(38, 18)) AS b FROM g LEFT JOIN v USING (subject, predicate))
SELECT gate, said AS actual, CASE WHEN said IS NULL THEN NULL WHEN numbers THEN CASE op WHEN '>=' THEN a >= b WHEN '<=' THEN a <= b WHEN '>' THEN a > b WHEN '<' THEN a < b WHEN '=' THEN a = b ELSE a <> b END
 WHEN op = '=' THEN said = target WHEN op = '!=' THEN said <> target END AS reached FROM p""")
def gate_of_texts(spark, d):
    """Gates with text targets on a ledger of text values: numbers in any form, numbers beyond a double's digits, words."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    k, i = F.col("c_custkey"), F.col("id")
    gates = t.table(spark, d, "customer").select(F.lit("m").alias("mission"), k.alias("gate"), F.concat(F.lit("user:"), (k % 23).cast("string")).alias("subject"), pick(("purchase", "click", "view", "error", "signup"), k % 5).alias("predicate"), pick(_OPS, k % 6).alias("op"), pick(_TEXTS, k % 7).alias("target"), F.lit("measured").alias("requires_confidence"))
    led = t.ledger(spark, d).withColumn("value", F.when(i % 8 == 7, "12345678901234568").otherwise(pick(_TEXTS, F.least(i % 8, F.lit(6)))))
    return disputes.evaluate(gates, led, CHAIN).select("gate", "actual", "reached")


@query(f"""SELECT a.id AS a_id, b.id AS b_id FROM live a JOIN live b USING (scope, subject, predicate) WHERE a.id < b.id AND a.value IS DISTINCT FROM b.value AND {_OVERLAP} AND a.tier = 'machine'""")
def contradictions_pairs_overlap(spark, d):
    machine = F.col("a_confidence").isin("measured", "derived")
    return _pairs(spark, d).where(machine).select("a_id", "b_id")


@query(f"WITH {_PAIRS} SELECT a_id, b_id FROM pairs WHERE a_id = (SELECT max(id) FROM live WHERE tier = 'machine' AND valid_to IS NULL) OR b_id = (SELECT max(id) FROM live WHERE tier = 'machine' AND valid_to IS NULL)")
def contradictions_of_row(spark, d):
    led = t.ledger(spark, d)
    row = reads.live(led).where("tier = 'machine' AND valid_to IS NULL").agg(F.max("id")).first()[0]
    return reads.contradictions_of(led, row if row is not None else -1)


def _resolutions(pairs: DataFrame) -> DataFrame:
    by = F.when(F.col("a_id") % 6 != 0, "ada")
    return pairs.where("a_id % 3 = 0").select("pair_key", F.lit("resolved").alias("status"), by.alias("resolved_by"), F.col("b_id").alias("at"))


def _status(status: str) -> str:
    return f"""WITH {_PAIRS} SELECT a_id, b_id, '{status}' AS status, 'c_' || substr(sha256(pair_key), 1, 26) AS contradiction FROM pairs
WHERE (a_id % 3 = 0 AND a_id % 6 <> 0) = {str(status == "resolved").lower()} ORDER BY greatest(a_id, b_id) DESC, pair_key LIMIT 100"""


@query(_status("open"))
def contradictions_list(spark, d):
    pairs = _pairs(spark, d)
    return disputes.listed(pairs, _resolutions(pairs), "open").select("a_id", "b_id", "status", disputes.contradiction_id("pair_key").alias("contradiction"))


@query(_status("resolved"))
def contradictions_resolved(spark, d):
    pairs = _pairs(spark, d)
    return disputes.listed(pairs, _resolutions(pairs), "resolved").select("a_id", "b_id", "status", disputes.contradiction_id("pair_key").alias("contradiction"))


_BATCH = r"""c0 AS (SELECT event_id AS i, event_id + 1000000000 AS id, CASE WHEN event_id % 37 = 0 THEN 'bad scope!' ELSE ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + user_id % 3] END AS scope,
 CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'user:' || (user_id % 20) END AS subject, event_type AS predicate, ['measured', 'failed', 'dead', 'state', 'guess'][1 + event_id % 5] AS kind,
 ['measured', 'derived', 'unverified', 'confirmed-by-human'][1 + event_id % 4] AS confidence, ts AS valid_from, CASE WHEN event_id % 29 = 0 THEN ts - INTERVAL 1 DAY WHEN event_id % 2 = 0 THEN ts + INTERVAL 2 DAY END AS valid_to,
 CASE WHEN event_id % 35 = 3 THEN event_id + 200000000 WHEN event_id % 5 = 3 THEN event_id - event_id % 4 END AS target FROM events),
c1 AS (SELECT *, CASE WHEN confidence IN ('measured', 'derived') AND i % 19 = 0 THEN 'confidence_is_earned' WHEN confidence = 'derived' AND i % 17 = 1 THEN 'derived_requires_inputs' WHEN i % 11 = 0 THEN 'evidence_required'
 WHEN kind = 'failed' AND i % 9 = 1 THEN 'failed_requires_reopen_if' WHEN kind IN ('failed', 'dead') AND i % 4 = 2 THEN 'failure_requires_why' WHEN confidence = 'confirmed-by-human' AND i % 3 = 0 THEN 'human_evidence_names_a_human'
 WHEN kind = 'guess' THEN 'kind_known' WHEN confidence = 'measured' AND i % 13 = 0 THEN 'measured_requires_verification' WHEN i % 37 = 0 THEN 'scope_shape' WHEN i % 41 = 0 THEN 'subject_present' WHEN i % 29 = 0 THEN 'valid_period_ordered' END AS own FROM c0),
k1 AS (SELECT c1.*, c1.scope || chr(1) || c1.subject || chr(1) || c1.predicate AS k, c1.confidence IN ('measured', 'derived') AS machine, coalesce(c1.valid_to, TIMESTAMP '9999-01-01') AS ends, l.id IS NOT NULL AS there, l.superseded_by IS NOT NULL AS gone,
 CASE WHEN l.tier = 'machine' AND l.superseded_by IS NULL THEN l.scope || chr(1) || l.subject || chr(1) || l.predicate END AS tk, l.valid_from AS ta FROM c1 LEFT JOIN ledger l ON l.id = target),
todo AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM k1 WHERE target IS NOT NULL OR (machine AND own IS NULL)),
was AS (SELECT scope || chr(1) || subject || chr(1) || predicate AS k, list(struct_pack(a := valid_from, b := coalesce(valid_to, TIMESTAMP '9999-01-01'), id := id)) AS w FROM live WHERE tier = 'machine' GROUP BY 1),
steps AS (SELECT t.*, coalesce(w, []) AS w FROM todo t LEFT JOIN was USING (k)),
fold AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason, CAST([] AS BIGINT[]) AS taken, CAST([] AS STRUCT(k VARCHAR, a TIMESTAMP, b TIMESTAMP)[]) AS mine
 UNION ALL SELECT rn, id, reason, CASE WHEN reason IS NULL AND target IS NOT NULL THEN list_append(taken, target) ELSE taken END, CASE WHEN reason IS NULL AND machine THEN list_append(mine, struct_pack(k := k, a := valid_from, b := ends)) ELSE mine END FROM (
  SELECT s.*, f.taken, f.mine, CASE WHEN target IS NOT NULL AND NOT there THEN 'supersedes_target_not_found' WHEN target IS NOT NULL AND (gone OR list_contains(f.taken, target)) THEN 'supersedes_target_already_superseded' WHEN own IS NOT NULL THEN own
   WHEN machine AND (len(list_filter(w, lambda h: h.a < ends AND valid_from < h.b AND h.id IS DISTINCT FROM target AND NOT list_contains(f.taken, h.id))) > 0 OR len(list_filter(f.mine, lambda h: h.k = s.k AND h.a < ends AND valid_from < h.b)) > 0) THEN 'no_two_live_contradictions' END AS reason
  FROM fold f JOIN steps s ON s.rn = f.rn + 1))"""


@query(f"WITH {_BATCH} SELECT t.id, CASE WHEN starts_with(f.reason, 'supersedes') THEN f.reason END AS s_reason FROM todo t JOIN fold f USING (id) WHERE target IS NOT NULL")
def admit_supersede_head(spark, d):
    rows = writes.decided(t.batch(spark, d), t.ledger(spark, d)).where("supersedes IS NOT NULL")
    return rows.select("id", F.when(F.col("reason").startswith("supersedes"), F.col("reason")).alias("s_reason"))


@query(f"WITH {_BATCH} SELECT c1.id, CASE WHEN f.id IS NULL THEN own ELSE f.reason END AS reason FROM c1 LEFT JOIN fold f ON f.id = c1.id")
def admit_precedence(spark, d):
    return writes.decided(t.batch(spark, d), t.ledger(spark, d)).select("id", "reason")


@query("""WITH v AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders) SELECT id, CAST(version AS INT) AS version FROM v""")
def mission_versions(spark, d):
    return writes.versions(t.missions(spark, d)).select("id", "version")


@query("""SELECT id, scope, asserted_at FROM (SELECT o_orderkey AS id, o_orderkey AS asserted_at, ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + o_custkey % 3] AS scope, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) JOIN chain USING (scope) WHERE nxt IS NULL""")
def missions_on_chain(spark, d):
    return disputes.on_chain(t.missions(spark, d), CHAIN).select("id", "scope", "asserted_at")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 7 = 0 THEN 'active_needs_a_gate' WHEN o_orderkey % 7 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) THEN 'gates_are_machine_checkable'
 WHEN o_orderstatus NOT IN ('O', 'F') THEN 'state_known' WHEN o_orderkey % 17 = 0 THEN 'statement_present' END AS reason FROM orders""")
def check_missions(spark, d):
    return checks.refused(t.missions(spark, d), checks.missions()).select("id", "reason")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 23 = 4 THEN 'kind_known' WHEN p_partkey % 29 = 3 THEN 'lines_ordered' WHEN p_partkey % 31 = 2 THEN 'name_present' END AS reason FROM part""")
def check_symbols(spark, d):
    i = F.col("id")
    rows = t.code(spark, d).withColumn("kind", F.when(i % 23 == 4, "thing").otherwise(F.col("kind"))).withColumn("line_end", F.when(i % 29 == 3, 0).otherwise(F.col("line_end"))).withColumn("name", F.when(i % 31 != 2, F.col("name")))
    return checks.refused(rows, checks.symbols()).select("id", "reason")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN 'ambiguous_needs_candidates' WHEN l_linenumber = 5 THEN 'kind_known' WHEN l_linenumber = 2 AND l_orderkey % 3 = 0 THEN 'measured_resolves' END AS reason FROM lineitem""")
def check_edges(spark, d):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    rows = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 3, "ambiguous-name").otherwise("unique-name").alias("resolution"), F.when(o % 2 == 0, F.array(o)).otherwise(F.array(o, o + 1)).alias("candidates"), F.when(n == 5, "likes").otherwise("calls").alias("kind"), F.when(n == 2, "measured").otherwise("derived").alias("confidence"), F.when((n != 2) | (o % 3 != 0), o).alias("dst"))
    return checks.refused(rows, checks.edges()).select("l_orderkey", "l_linenumber", "reason")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'commit_shape' WHEN c_custkey % 7 = 1 THEN 'indexer_present' WHEN c_custkey % 11 = 1 THEN 'scope_shape' WHEN c_custkey % 13 = 1 THEN 'version_known' END AS reason FROM customer""")
def check_artifacts(spark, d):
    i = F.col("c_custkey")
    rows = t.table(spark, d, "customer").select(i.alias("id"), F.when(i % 5 == 1, "XYZ").otherwise("0123abc").alias("commit_sha"), F.when(i % 7 == 1, "").otherwise("ix").alias("indexer"), F.lit("r").alias("repo"), F.when(i % 11 == 1, "a//b").otherwise("a/b").alias("scope"), F.when(i % 13 != 1, 1).alias("version"))
    return checks.refused(rows, checks.artifacts()).select("id", "reason")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 1 AND c_custkey % 8 <> 1 THEN 'accepted_names_an_assertion' WHEN c_custkey % 5 = 2 THEN 'citation_required' WHEN c_custkey % 4 IN (1, 2) AND c_custkey % 3 = 0 THEN 'reviewed_names_a_reviewer' WHEN c_custkey % 4 = 3 THEN 'status_known' END AS reason FROM customer""")
def check_proposals(spark, d):
    i = F.col("c_custkey")
    status = F.when(i % 4 == 0, "pending").when(i % 4 == 1, "accepted").when(i % 4 == 2, "rejected").otherwise("odd")
    rows = t.table(spark, d, "customer").select(i.alias("id"), status.alias("status"), F.when(i % 8 == 1, i).alias("promoted_to"), F.when(i % 5 != 2, "x").alias("source"), F.when(i % 3 != 0, "ada").alias("reviewed_by"))
    return checks.refused(rows, checks.proposals()).select("id", "reason")


@query("""SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'actor_present' WHEN event_id % 10 = 0 THEN 'occasion_present' WHEN event_id % 11 = 0 THEN 'scope_shape' WHEN event_id % 13 = 0 THEN 'signature_present' END AS reason FROM events""")
def check_feedback(spark, d):
    i = F.col("event_id")
    rows = t.table(spark, d, "events").select(i.alias("id"), F.when(i % 9 != 0, "ada").alias("actor"), F.when(i % 10 != 0, F.to_date("ts")).alias("occasion"), F.when(i % 11 == 0, "/").otherwise("a").alias("scope"), F.when(i % 13 == 0, " ").otherwise("s").alias("signature"))
    return checks.refused(rows, checks.feedback()).select("id", "reason")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 < 2 THEN 'two_occasions' WHEN least(c_custkey % 4, 3) <> 1 + c_custkey % 3 THEN 'tier_matches_humans' END AS reason FROM customer""")
def check_preferences(spark, d):
    i = F.col("c_custkey")
    rows = t.table(spark, d, "customer").select(i.alias("id"), (i % 5).alias("occasions"), F.element_at(F.array(*map(F.lit, checks.TIERS)), (1 + i % 3).cast("int")).alias("tier"), (i % 4).alias("humans"))
    return checks.refused(rows, checks.preferences()).select("id", "reason")


@query("""SELECT conv_id, turn, CASE WHEN turn = 3 AND conv_id % 2 = 0 THEN 'role_known' WHEN conv_id % 9 = 4 THEN 'scope_shape' WHEN turn = 1 AND conv_id % 3 = 0 THEN 'seq_not_negative' WHEN turn = 2 AND conv_id % 5 = 0 THEN 'text_present' END AS reason FROM conversations""")
def check_episodes(spark, d):
    c, n = F.col("conv_id"), F.col("turn")
    rows = t.table(spark, d, "conversations").select("conv_id", "turn", F.when((n == 3) & (c % 2 == 0), "robot").otherwise("human").alias("role"), F.when(c % 9 == 4, "").otherwise("a").alias("scope"), F.when((n == 1) & (c % 3 == 0), -n).otherwise(n).alias("seq"), F.when((n == 2) & (c % 5 == 0), "  ").otherwise("x").alias("text"))
    return checks.refused(rows, checks.episodes()).select("conv_id", "turn", "reason")


@query("""SELECT event_id AS id, CASE WHEN event_id % 8 = 0 THEN 'path_present' WHEN event_id % 6 = 1 THEN 'release_follows_claim' END AS reason FROM events""")
def check_claims(spark, d):
    i = F.col("event_id")
    rows = t.table(spark, d, "events").select(i.alias("id"), F.when(i % 8 != 0, "p").alias("path"), F.col("ts").alias("claimed_at"), F.when(i % 6 == 1, F.col("ts") - F.expr("INTERVAL 1 HOUR")).when(i % 6 == 2, F.col("ts")).alias("released_at"), F.lit("a").alias("scope"))
    return checks.refused(rows, checks.claims()).select("id", "reason")


@query("""SELECT c_custkey AS id, (list_contains(p, 'admin') OR list_has_all(p, ['read', 'write'])) AND (s = 'org/a' OR starts_with(s, 'org/a/')) AS permitted
FROM (SELECT c_custkey, [['read'], ['read', 'write'], ['admin'], ['write', 'x', 'read']][1 + c_custkey % 4] AS p, ['org/a', 'org/a/b', 'org/ab'][1 + c_custkey % 3] AS s FROM customer)""")
def permissions(spark, d):
    i = F.col("c_custkey")
    granted = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in (["read"], ["read", "write"], ["admin"], ["write", "x", "read"]))), (1 + i % 4).cast("int"))
    scope = F.element_at(F.array(*map(F.lit, ("org/a", "org/a/b", "org/ab"))), (1 + i % 3).cast("int"))
    return t.table(spark, d, "customer").select(i.alias("id"), checks.permitted(granted, ["read", "write"], F.lit("org/a"), scope).alias("permitted"))


@query("""WITH r AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'rule' WHEN id % 3 = 1 THEN 'constraint' ELSE kind END AS k2 FROM live JOIN chain USING (scope)), b AS (SELECT *, min(ord) OVER (PARTITION BY subject, predicate, k2) AS best FROM r WHERE k2 IN ('rule', 'constraint'))
SELECT id, scope, k2 AS kind, binding FROM b WHERE ord = best""")
def rules_read(spark, d):
    i = F.col("id")
    led = t.ledger(spark, d).withColumn("kind", F.when(i % 3 == 0, "rule").when(i % 3 == 1, "constraint").otherwise(F.col("kind")))
    return reads.enforced_rules(led, CHAIN).select("id", "scope", "kind", "binding")


@query("""WITH w AS (SELECT c_custkey AS place, c_name AS text, octet_length(encode(c_name)) + 1 AS n, c_custkey % 1000 = 9 AS mandatory FROM customer),
u AS (SELECT *, sum(n) OVER (PARTITION BY mandatory ORDER BY place) AS upto, (SELECT sum(n) FROM w WHERE mandatory) AS must FROM w) SELECT place, text, mandatory FROM u WHERE mandatory OR must + upto <= 600""")
def byte_budget(spark, d):
    i = F.col("c_custkey")
    lines = t.table(spark, d, "customer").select(i.alias("place"), F.col("c_name").alias("text"), (i % 1000 == 9).alias("mandatory"))
    return reads.packed_lines(lines, 600)


@query("""SELECT u.id AS supersedes, u.scope, u.subject, u.predicate, 'dead' AS kind, 'unverified' AS confidence, 'shadowed by a measured row' AS why FROM live u WHERE confidence = 'unverified'
 AND EXISTS (SELECT 1 FROM live m WHERE m.confidence = 'measured' AND m.scope = u.scope AND m.subject = u.subject AND m.predicate = u.predicate)""")
def duplicates_retracted(spark, d):
    return writes.retractions(people.shadowed(t.ledger(spark, d)), "shadowed by a measured row")


@query("""SELECT event_id AS supersedes, user_id AS scope, event_type AS subject, CAST(ts AS DATE) AS predicate, 'dead' AS kind, 'unverified' AS confidence, 'repeats a mission' AS why
FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS keeps FROM events) WHERE event_id <> keeps""")
def missions_closed(spark, d):
    rows = t.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("scope"), F.col("event_type").alias("subject"), F.to_date("ts").alias("predicate"))
    return writes.retractions(disputes.duplicates(rows, ["scope", "subject", "predicate"], "id", "id"), "repeats a mission")


@query("SELECT scope, CASE mode WHEN 'isolated' THEN 'shared' ELSE 'isolated' END AS mode, (SELECT max(asserted_at) FROM ledger) + row_number() OVER (ORDER BY scope) AS asserted_at FROM modes")
def mode_flip(spark, d):
    """The modes that hold after every scope's was flipped."""
    was = t.modes(spark, d)
    new = reads.flipped(was, t.ledger(spark, d).agg(F.max("asserted_at")))
    return reads.newest(was.unionByName(new), ["scope"], ["asserted_at"]).select("scope", "mode", "asserted_at")


_STORE = "id long, scope string, subject string, predicate string, value double, kind string, confidence string, source string, valid_from timestamp_ntz, valid_to timestamp_ntz, supersedes long"


def stored(spark, d) -> writes.Store:
    """A ledger that two batches were appended to, the first of them again after the second."""
    store = writes.Store(spark, f"{jobs.shared_dir(spark)}/store-{uuid.uuid4().hex}", _STORE)
    rows = t.candidates(spark, d).withColumn("supersedes", F.lit(None).cast("long"))
    store.append(rows.where("id % 2 = 0"), "one")
    store.append(rows.where("id % 2 = 1"), "two")
    store.append(rows.where("id % 2 = 0"), "one")
    return store


#: Candidates in the order of their batches, and what a row-by-row insert says of each.
_STORED = _BATCH[: _BATCH.index("k1 AS (")] + """r AS (SELECT *, i % 2 AS batch, scope || chr(1) || subject || chr(1) || predicate AS k, coalesce(valid_to, TIMESTAMP '9999-01-01') AS ends FROM c1 WHERE own IS NULL AND confidence IN ('measured', 'derived')),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch, i) AS rn FROM r),
fold AS (SELECT k, rn, i, true AS ok, [struct_pack(a := valid_from, b := ends)] AS held FROM s WHERE rn = 1
 UNION ALL SELECT k, rn, i, NOT hit, CASE WHEN hit THEN held ELSE list_append(held, struct_pack(a := a, b := b)) END FROM (SELECT s.k, s.rn, s.i, s.valid_from AS a, s.ends AS b, held, len(list_filter(held, lambda h: h.a < s.ends AND s.valid_from < h.b)) > 0 AS hit FROM fold f JOIN s ON s.k = f.k AND s.rn = f.rn + 1)),
said AS (SELECT c1.*, i % 2 AS batch, coalesce(own, CASE WHEN NOT ok THEN 'no_two_live_contradictions' END) AS reason FROM c1 LEFT JOIN fold USING (i)),
b AS (SELECT min(i) FILTER (i % 2 = 0) AS least0, max(i) FILTER (i % 2 = 0) - min(i) FILTER (i % 2 = 0) + 1 AS last0, min(i) FILTER (i % 2 = 1) AS least1 FROM c1)"""


@query(f"WITH {_STORED} SELECT i AS id, scope, subject, predicate, CASE batch WHEN 0 THEN i - least0 + 1 ELSE i - least1 + 1 + last0 END AS asserted_at, i AS chain, 0 AS place, CAST(NULL AS BIGINT) AS superseded_by FROM said, b WHERE reason IS NULL")
def ledger_appended(spark, d):
    """What a ledger holds after three appends, one of which is a repetition."""
    return stored(spark, d).assertions().select("id", "scope", "subject", "predicate", "asserted_at", "chain", "place", "superseded_by")


@query(f"WITH {_STORED} SELECT i AS id, reason, 'refused: ' || reason || ' ' || scope || ' ' || subject AS message FROM said WHERE reason IS NOT NULL")
def ledger_rejections(spark, d):
    return stored(spark, d).rejections()


_SEED_SCHEMA = "id long, " + ", ".join(c for c in seeds.ASSERTION.split(", ") if "ref " not in c) + ", supersedes long"


def _seed(spark, d) -> DataFrame:
    """Chains of five parts each; some rows have no source, some name a ref that is not there."""
    i = F.col("p_partkey")
    up = F.when(i % 50 == 7, "nowhere").when(i % 5 != 0, F.concat(F.lit("r"), (i - 1).cast("string")))
    no = lambda kind: F.lit(None).cast(kind)
    return t.table(spark, d, "part").select(
        i.cast("int").alias("place"), F.concat(F.lit("r"), i.cast("string")).alias("ref"), up.alias("supersedes_ref"), F.lit("org/acme").alias("scope"), F.concat(F.lit("part:"), F.floor(i / 5).cast("string")).alias("subject"), F.lit("size").alias("predicate"), F.col("p_size").cast("double").alias("value"), F.lit("state").alias("kind"), F.lit("unverified").alias("confidence"),
        F.when(i % 11 == 3, " ").otherwise(F.concat(F.lit("part:"), i.cast("string"))).alias("source"), *(no("string").alias(c) for c in ("human", "why", "reopen_if")), no("long").alias("verification_id"), no("array<long>").alias("derived_from"), no("timestamp_ntz").alias("valid_from"), no("timestamp_ntz").alias("valid_to"), F.lit(False).alias("is_verifier"),
    )


@query("""WITH s AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 50 = 7 THEN 'nowhere' WHEN p_partkey % 5 <> 0 THEN 'r' || (p_partkey - 1) END AS up, p_partkey % 11 = 3 AS bad FROM part),
l AS (SELECT i, CASE WHEN bad THEN 'evidence_required' END AS reason, 0 AS step FROM s WHERE up IS NULL UNION ALL SELECT s.i, CASE WHEN l.reason IS NOT NULL THEN 'supersedes_ref "' || s.up || '" was not loaded' WHEN s.bad THEN 'evidence_required' END, step + 1 FROM s JOIN l ON s.up = 'r' || l.i)
SELECT i AS place, coalesce(l.reason, CASE WHEN l.i IS NULL THEN 'supersedes_ref "' || up || '" was not loaded' END) AS reason FROM s LEFT JOIN l USING (i)""")
def seed_loaded(spark, d):
    store = writes.Store(spark, f"{jobs.shared_dir(spark)}/seeds-{uuid.uuid4().hex}", _SEED_SCHEMA)
    return seeds.load(store, _seed(spark, d), "parts", 1).rows.select(F.col("place").cast("long").alias("place"), "reason")


@query("SELECT user_id, start, count(*) AS n FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * k) AS start FROM events, range(3) r(k)) GROUP BY ALL")
def attempts_stream(spark, d):
    return jobs.attempts(spark, f"{d}/events.parquet")


@query("SELECT event_type AS signature, CAST(count(*) AS BIGINT) AS events, count(DISTINCT user_id) AS humans FROM events GROUP BY event_type")
def preference_tallies(spark, d):
    return jobs.tallies(spark, f"{d}/events.parquet")

"""The registered queries over the engine's own tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import admission, disputes, episodes, graph, people, prose, reads
from ..sources import tables as t
from ..streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

CHAIN = ["org/acme/proj/a", "org/acme"]
TIERS = ("machine", "unverified", "confirmed-by-human")
TERMS = ("the", "data", "la", "der", "error", "le")
AS_OF = 700

#: The derived tables as DuckDB sees them.
BASE = """
led0 AS (SELECT event_id AS id, event_id AS asserted_at, ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + user_id % 3] AS scope,
  'user:' || (user_id % 20) AS subject, event_type AS predicate, value,
  CASE WHEN event_id % 23 = 0 THEN 'dead' WHEN event_id % 7 = 3 THEN 'state' ELSE 'measured' END AS kind,
  ['measured', 'derived', 'unverified', 'confirmed-by-human'][1 + event_id % 4] AS confidence, event_id % 6 = 0 AS binding, ts AS valid_from,
  CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 3 DAY END AS valid_to,
  CASE WHEN event_id % 4 = 1 THEN [event_id - 1, CASE WHEN event_id % 40 = 1 THEN event_id + 100000000 ELSE event_id END] END AS derived_from FROM events),
led1 AS (SELECT *, CASE WHEN confidence IN ('measured', 'derived') THEN 'machine' ELSE confidence END AS tier FROM led0),
ledger AS (SELECT *, lag(id) OVER w AS supersedes, lead(id) OVER w AS superseded_by, lead(asserted_at) OVER w AS superseded_at
  FROM led1 WINDOW w AS (PARTITION BY scope, subject, predicate, tier ORDER BY asserted_at)),
live AS (SELECT * FROM ledger WHERE superseded_by IS NULL),
modes AS (SELECT DISTINCT ON (scope) scope, CASE WHEN event_id % 2 = 0 THEN 'isolated' ELSE 'shared' END AS mode, event_id AS asserted_at FROM (SELECT event_id, ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + user_id % 3] AS scope FROM events WHERE event_id % 97 = 5) ORDER BY scope, event_id DESC),
chain AS (SELECT * FROM (VALUES ('org/acme/proj/a', 1), ('org/acme', 2)) v(scope, ord)),
episodes AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session, turn AS seq, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS role,
  TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS BIGINT)) + to_minutes(CAST(turn AS BIGINT)) AS occurred_at, coalesce(text, '') || CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN '?' ELSE '' END AS text,
  CASE WHEN conv_id % 7 <> 0 THEN 'branch-' || (conv_id % 4) END AS branch, conv_id % 5 AS actor FROM conversations),
fb AS (SELECT arg_min(struct_pack(id := event_id, scope := ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + user_id % 3], value := value, created_at := ts), event_id) AS e,
  user_id AS actor, event_type || ':' || (event_id % 50) AS signature, CAST(ts AS DATE) AS occasion FROM events GROUP BY 2, 3, 4),
feedback AS (SELECT actor, signature, occasion, e.id AS id, e.scope AS scope, e.value AS value, e.created_at AS created_at FROM fb),
nodes AS (SELECT user_id % 50 AS node_id, max(ts) AS heartbeat_at, 'worker-' || (user_id % 50) AS label, ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + user_id % 50 % 3] AS scope, user_id % 50 % 17 = 5 AS retired
  FROM events GROUP BY user_id % 50),
claims AS (SELECT event_id AS claim_id, user_id % 50 AS node_id, event_type || '/' || (event_id % 100) AS path, ts AS claimed_at, event_id % 3 = 0 AS released FROM events WHERE event_id % 20 = 3),
verifications AS (SELECT event_id AS id, event_id - event_id % 10 AS target, ['confirmed', 'refuted', 'unresolvable'][1 + event_id % 10 % 3] AS outcome,
  CASE WHEN event_id % 10 = 8 THEN 'no_commit_in_evidence' END AS reason, ts AS checked_at FROM events WHERE event_id % 3 = 2),
symbols AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS name, replace(p_brand, '#', '_') || '::' || replace(p_name, ' ', '_') AS fqn, p_type AS language, p_brand || '.py' AS path FROM part),
edges AS (SELECT DISTINCT l_partkey AS src, (l_partkey * 7 + l_suppkey + 1) % (SELECT max(p_partkey) + 1 FROM part) AS dst,
  ['calls', 'imports', 'tests', 'implements', 'uses', 'extends', 'instantiates'][1 + (l_linenumber - 1) % 7] AS kind,
  CASE l_returnflag WHEN 'A' THEN 'unverified' WHEN 'N' THEN 'derived' ELSE 'measured' END AS confidence FROM lineitem),
lines AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r?\\n') AS ls FROM documents)),
prose AS (SELECT * FROM lines WHERE trim(text, ' ') <> ''),
note AS (SELECT p_partkey AS doc_id, concat_ws(chr(10), '# ' || p_brand || CASE WHEN p_partkey % 9 = 4 THEN ' UNMEASURED_x, do not quote' ELSE '' END, replace(p_name, ' ', '_') || ': ' || p_size || ' mm', 'The ' || p_name || ' is now ' || p_size || ' kg.', 'widget_' || p_size || ' is a ' || lower(p_type) || ' part.',
  CASE WHEN p_partkey % 5 = 0 THEN 'this estimate is 3 mm.' ELSE 'You must never mix small parts with large ones.' END, CASE WHEN p_partkey % 3 = 0 THEN '```' || chr(10) || 'size: 4 mm' || chr(10) || '```' ELSE '> quoted: 5 mm' END,
  CASE WHEN p_partkey % 4 = 0 THEN 'const LIMIT: u32 = 1_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ';' ELSE 'static_assert(width % ' || p_size || ');' END) AS text FROM part),
noted AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS text FROM note),
code AS (SELECT p_partkey AS id, ['trait', 'type', 'method', 'method', 'method', 'method', 'function', 'function', 'test', 'const'][1 + p_partkey % 10] AS kind,
  CASE p_partkey % 10 WHEN 0 THEN 'Tr' || p_partkey WHEN 1 THEN 'T' || p_partkey ELSE 'm' || (p_size % 8) END AS name,
  CASE WHEN p_partkey % 10 = 0 THEN 'Tr' || p_partkey WHEN p_partkey // 10 % 4 = 3 THEN NULL WHEN p_partkey % 10 = 1 THEN 'T' || p_partkey ELSE 'T' || (p_partkey - p_partkey % 10 + 1) || '::m' || (p_size % 8) END AS fqn,
  'f' || (p_partkey // 10) || '.py' AS path, p_partkey % 10 * 10 + 1 AS line_start, p_partkey % 10 * 10 + 1 + CASE p_partkey % 10 WHEN 0 THEN 45 WHEN 1 THEN 60 ELSE 5 END AS line_end,
  CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'rust' END AS family, p_partkey % 3 = 0 AS is_declaration, p_partkey % 50 AS index_id FROM part),
cedges AS (SELECT src, dst, kind, confidence FROM edges WHERE kind <> 'implements' UNION ALL SELECT p_partkey, p_partkey // 10 % 5 * 10, 'implements', ['unverified', 'derived', 'measured'][1 + p_partkey // 10 % 3] FROM part WHERE p_partkey % 10 = 1)
"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that follows the base tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {BASE.strip()}" + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else sql)
        return f

    return add


_TAKE = """
SELECT c.id, scope, subject, predicate, kind, confidence, value, asserted_at FROM (SELECT l.*, ord, min(ord) OVER (PARTITION BY subject, predicate) AS best
 FROM {source} l JOIN chain USING (scope) WHERE {kind}) c WHERE ord = best"""
TAKEN = ["id", "scope", "subject", "predicate", "kind", "confidence", "value", "asserted_at"]
_ASOF = f"(SELECT * FROM ledger WHERE asserted_at <= {AS_OF} AND (superseded_at IS NULL OR superseded_at > {AS_OF}))"
_OVERLAP = "(b.valid_to IS NULL OR a.valid_from < b.valid_to) AND (a.valid_to IS NULL OR b.valid_from < a.valid_to)"


@query(_TAKE.format(source="live", kind="kind <> 'dead'"))
def take_live(spark: SparkSession, d: str) -> DataFrame:
    return reads.take(t.ledger(spark, d), CHAIN).select(*TAKEN)


@query(_TAKE.format(source=_ASOF, kind="kind <> 'dead'"))
def take_asof(spark, d):
    return reads.take(t.ledger(spark, d), CHAIN, as_of=AS_OF).select(*TAKEN)


@query(_TAKE.format(source="live", kind="kind = 'dead'"))
def take_kind_dead(spark, d):
    return reads.take(t.ledger(spark, d), CHAIN, kind="dead").select(*TAKEN)


@query(_TAKE.format(source="live", kind="kind <> 'dead' AND scope = 'org/acme/proj/a'"))
def take_isolated_chain(spark, d):
    modes = spark.createDataFrame([("org/acme", "shared", 1), ("org/acme/proj/a", "isolated", 5), ("org/acme/proj/b", "isolated", 6)], "scope string, mode string, asserted_at long")
    return reads.take(t.ledger(spark, d), reads.chain(modes, "org/acme/proj/a")).select(*TAKEN)


@query(f"WITH taken AS ({_TAKE.format(source='live', kind=chr(107) + 'ind <> ' + chr(39) + 'dead' + chr(39))})" + f"""
SELECT id, EXISTS (SELECT 1 FROM live a JOIN live b USING (scope, subject, predicate) WHERE a.id <> b.id AND a.value IS DISTINCT FROM b.value AND {_OVERLAP} AND a.id = taken.id) AS contested FROM taken""")
def take_contested(spark, d):
    led = t.ledger(spark, d)
    return reads.contested(reads.take(led, CHAIN), disputes.open_pairs(led)).select("id", "contested")


@query("""
SELECT id, confidence = 'derived' AND EXISTS (SELECT 1 FROM unnest(derived_from) u(x) WHERE x NOT IN (SELECT id FROM ledger JOIN chain USING (scope))) AS inputs_unresolvable FROM ledger WHERE superseded_by IS NULL""")
def take_unresolvable_inputs(spark, d):
    led = t.ledger(spark, d)
    return reads.unresolvable_inputs(reads.live(led), led, CHAIN).select("id", "inputs_unresolvable")


@query("SELECT id, scope, subject, predicate, confidence, superseded_by FROM ledger WHERE id = 100")
def by_id(spark, d):
    return t.ledger(spark, d).where("id = 100").select("id", "scope", "subject", "predicate", "confidence", "superseded_by")


@query("SELECT max(asserted_at) AS sequence FROM ledger")
def current_sequence(spark, d):
    return t.ledger(spark, d).agg(F.max("asserted_at").alias("sequence"))


@query(r"""WITH w AS (SELECT *, list_filter(regexp_split_to_array(lower(subject || ' ' || predicate || ' ' || kind), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM live)
SELECT id, round(len(list_intersect(['purchase', 'state', '7'], ws)) / len(ws), 6) AS rank FROM w WHERE len(list_intersect(['purchase', 'state', '7'], ws)) > 0""")
def search_tokens(spark, d):
    return reads.search(t.ledger(spark, d), F.concat_ws(" ", "subject", "predicate", "kind"), ["purchase", "state", "7"]).select("id", "rank")


@query("""SELECT id, max(id) OVER w AS head, count(*) OVER (PARTITION BY scope, subject, predicate, tier ORDER BY asserted_at DESC) - 1 AS hops FROM ledger
WINDOW w AS (PARTITION BY scope, subject, predicate, tier)""")
def chain_head(spark, d):
    return reads.chain_heads(t.ledger(spark, d))


@query("""WITH back AS (SELECT id, supersedes FROM ledger WHERE id = 100 UNION SELECT l.id, l.supersedes FROM ledger l JOIN back b ON l.id = b.supersedes),
forth AS (SELECT id, superseded_by FROM ledger WHERE id = 100 UNION SELECT l.id, l.superseded_by FROM ledger l JOIN forth f ON l.id = f.superseded_by)
SELECT id, scope, subject, value, asserted_at FROM ledger WHERE id IN (SELECT id FROM back UNION SELECT id FROM forth)""")
def lineage_full(spark, d):
    return reads.walked(t.ledger(spark, d), 100).select("id", "scope", "subject", "value", "asserted_at")


@query("SELECT confidence, count(*) AS n, count(*) FILTER (binding) AS n_binding FROM live GROUP BY confidence")
def live_by_confidence(spark, d):
    return reads.live(t.ledger(spark, d)).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("binding").alias("n_binding"))


@query("SELECT id, kind, confidence, (SELECT count(*) FROM live WHERE kind = 'state') AS total FROM live WHERE kind = 'state' ORDER BY asserted_at DESC LIMIT 20 OFFSET 10")
def admin_page(spark, d):
    rows = reads.live(t.ledger(spark, d)).where("kind = 'state'").select("id", "kind", "confidence", "asserted_at")
    return reads.page(rows, [F.desc("asserted_at")], 10, 20).select("id", "kind", "confidence", "total")


@query("""SELECT coalesce(r.scope, u.scope) AS scope, r.scope IS NOT NULL AS registered, coalesce(n, 0) AS n_live
FROM (VALUES ('org/acme'), ('org/acme/proj/z')) r(scope) FULL JOIN (SELECT scope, count(*) AS n FROM live GROUP BY scope) u ON r.scope = u.scope""")
def admin_scopes(spark, d):
    return reads.scopes_in_use(spark.createDataFrame([("org/acme",), ("org/acme/proj/z",)], "scope string"), t.ledger(spark, d))


@query(f"""SELECT scope, subject, predicate, a.id AS a_id, b.id AS b_id, a.confidence AS a_confidence, b.confidence AS b_confidence, a.id || '|' || b.id AS pair_key
FROM live a JOIN live b USING (scope, subject, predicate) WHERE a.id < b.id AND a.value IS DISTINCT FROM b.value AND {_OVERLAP}""")
def contradictions_open(spark, d):
    return disputes.open_pairs(t.ledger(spark, d))


@query(f"""SELECT scope, subject, predicate, a.id AS a_id, b.id AS b_id, CASE WHEN a.superseded_by IS NULL AND b.superseded_by IS NULL THEN 'open' ELSE 'superseded' END AS status
FROM ledger a JOIN ledger b USING (scope, subject, predicate) WHERE a.asserted_at < b.asserted_at AND (a.superseded_at IS NULL OR a.superseded_at > b.asserted_at) AND a.tier <> b.tier
AND a.value IS DISTINCT FROM b.value AND {_OVERLAP}""")
def contradictions_autoclosed(spark, d):
    return disputes.history(t.ledger(spark, d), TIERS)


_GATES = [
    ("m1", 1, "user:1", "purchase", ">=", 50.0, "measured"), ("m1", 2, "user:2", "click", "<=", 80.0, "derived"), ("m1", 3, "user:3", "view", ">", 10.0, "unverified"),
    ("m2", 4, "user:4", "error", "<", 30.0, "confirmed-by-human"), ("m2", 5, "user:5", "signup", "=", 12.0, "measured"), ("m3", 6, "user:6", "click", "!=", 3.0, "derived"), ("m3", 7, "nobody", "click", ">=", 1.0, "measured"), ("m4", 8, "user:7", "view", "<", -1.0, "confirmed-by-human"),
]
_GATE_SQL = f"""gates AS (SELECT * FROM (VALUES {", ".join(map(str, _GATES))}) v(mission, gate, subject, predicate, op, target, requires_confidence)),
evidence AS (SELECT * FROM live JOIN chain USING (scope) WHERE kind = 'measured' QUALIFY row_number() OVER (PARTITION BY subject, predicate, confidence ORDER BY ord, asserted_at DESC) = 1),
evaluated AS (SELECT g.*, CASE op WHEN '>=' THEN value >= target WHEN '<=' THEN value <= target WHEN '>' THEN value > target WHEN '<' THEN value < target WHEN '=' THEN value = target ELSE value <> target END AS reached,
 value AS actual, id AS evidence, scope AS resolved_scope FROM gates g LEFT JOIN evidence e ON e.subject = g.subject AND e.predicate = g.predicate AND e.confidence = g.requires_confidence)"""


_GATE_COLUMNS = ["mission", "gate", "subject", "predicate", "op", "target", "requires_confidence", "reached", "actual", "evidence", "resolved_scope"]


def _gates(spark, d):
    gates = spark.createDataFrame(_GATES, "mission string, gate int, subject string, predicate string, op string, target double, requires_confidence string")
    return disputes.evaluate(gates, t.ledger(spark, d), CHAIN)


@query(f"WITH {_GATE_SQL} SELECT mission, gate, subject, predicate, op, CAST(target AS DOUBLE) AS target, requires_confidence, reached, actual, evidence, resolved_scope FROM evaluated")
def gate_eval_all_ops(spark, d):
    return _gates(spark, d).select(*_GATE_COLUMNS)


@query(f"WITH {_GATE_SQL} SELECT mission, count(*) AS gates, count(*) FILTER (reached) AS reached, count(*) FILTER (NOT reached) AS missed, count(*) FILTER (reached IS NULL) AS awaiting FROM evaluated GROUP BY mission")
def missions_with_gates(spark, d):
    return disputes.missions(_gates(spark, d))


@query("""SELECT event_id AS row_id, keeps FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS keeps FROM events) WHERE event_id <> keeps""")
def mission_duplicates(spark, d):
    rows = t.table(spark, d, "events").select(F.col("event_id").alias("row_id"), "user_id", "event_type", F.to_date("ts").alias("day"))
    return disputes.duplicates(rows, ["user_id", "event_type", "day"], "row_id", "row_id").select("row_id", "keeps")


@query(r"""WITH c AS (SELECT event_id AS id, CASE WHEN event_id % 37 = 0 THEN 'bad scope!' ELSE 'ok' END AS scope, event_id % 41 = 0 AS no_subject, ['measured', 'failed', 'dead', 'state', 'guess'][1 + event_id % 5] AS kind,
 ['measured', 'derived', 'unverified', 'confirmed-by-human'][1 + event_id % 4] AS conf, event_id AS i FROM events)
SELECT id, CASE WHEN conf IN ('measured', 'derived') AND i % 19 = 0 THEN 'confidence_is_earned' WHEN conf = 'derived' AND i % 17 = 1 THEN 'derived_requires_inputs' WHEN i % 11 = 0 THEN 'evidence_required'
 WHEN kind = 'failed' AND i % 9 = 1 THEN 'failed_requires_reopen_if' WHEN kind IN ('failed', 'dead') AND i % 4 = 2 THEN 'failure_requires_why' WHEN conf = 'confirmed-by-human' AND i % 3 = 0 THEN 'human_evidence_names_a_human'
 WHEN kind = 'guess' THEN 'kind_known' WHEN conf = 'measured' AND i % 13 = 0 THEN 'measured_requires_verification' WHEN scope <> 'ok' THEN 'scope_shape' WHEN no_subject THEN 'subject_present'
 WHEN i % 29 = 0 THEN 'valid_period_ordered' END AS reason FROM c""")
def admit_reasons(spark, d):
    return admission.reasons(t.candidates(spark, d)).select("id", "reason")


@query("""WITH c AS (SELECT event_id AS id, event_id AS i, user_id, event_type, ts, ['measured', 'failed', 'dead', 'state', 'guess'][1 + event_id % 5] AS kind FROM events WHERE event_id % 4 < 2),
r AS (SELECT id, ts AS a, CASE WHEN i % 2 = 0 THEN ts + INTERVAL 2 DAY ELSE TIMESTAMP '9999-01-01' END AS b, (user_id % 3) || '|' || (user_id % 20) || '|' || event_type AS k, row_number() OVER (PARTITION BY user_id % 3, user_id % 20, event_type ORDER BY id) AS rn FROM c
 WHERE i % 19 <> 0 AND NOT (i % 4 = 1 AND i % 17 = 1) AND i % 11 <> 0 AND NOT (kind = 'failed' AND i % 9 = 1) AND kind <> 'guess' AND NOT (i % 4 = 0 AND i % 13 = 0) AND i % 37 <> 0 AND i % 41 <> 0 AND i % 29 <> 0),
fold AS (SELECT k, rn, id, true AS accepted, [struct_pack(a := a, b := b)] AS held FROM r WHERE rn = 1
 UNION ALL SELECT k, rn, id, len(hit) = 0, CASE WHEN len(hit) = 0 THEN list_append(held, struct_pack(a := a, b := b)) ELSE held END FROM (
  SELECT r.*, fold.held, list_filter(fold.held, lambda h: h.a < r.b AND r.a < h.b) AS hit FROM fold JOIN r ON r.k = fold.k AND r.rn = fold.rn + 1))
SELECT id, accepted FROM fold""")
def admit_exclusion(spark, d):
    return admission.exclusion(admission.split(t.candidates(spark, d))[0])


@query("""SELECT user_id AS actor, event_type AS signature, min(event_id) AS id FROM events GROUP BY ALL HAVING (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE event_id < 300)""")
def admit_idempotent_hash(spark, d):
    rows = t.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("event_type").alias("signature"))
    rows = admission.content_hash(rows, ["actor", "signature"])
    return admission.unseen(rows, rows.where("id < 300"), ["hash"], "id").select("actor", "signature", "id")


@query("""WITH r AS (SELECT event_type AS reason, ts FROM events WHERE event_id % 11 = 0) SELECT reason, count(*) AS n FROM r WHERE ts > (SELECT max(ts) FROM r) - INTERVAL 24 HOUR GROUP BY reason""")
def rejections_24h(spark, d):
    r = t.table(spark, d, "events").where("event_id % 11 = 0").select(F.col("event_type").alias("reason"), "ts")
    newest = r.agg(F.max("ts").alias("_now"))
    return r.crossJoin(F.broadcast(newest)).where(F.col("ts") > F.col("_now") - F.expr("INTERVAL 24 HOURS")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))  # one row


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, floor(epoch(ts)) AS e FROM events)""".replace("epoch(ts) RANGE", "e RANGE"))
def login_window_count(spark, d):
    e = t.table(spark, d, "events").withColumn("_e", F.unix_seconds(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("_e").rangeBetween(-86_400, 0)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT session) AS sessions, count(*) FILTER (role = 'human') AS human, count(*) FILTER (role = 'agent') AS agent, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM episodes")
def episode_stats(spark, d):
    return episodes.stats(t.episodes(spark, d))


@query("SELECT session, count(*) AS n, count(*) FILTER (role = 'human') AS human, min(occurred_at) AS first_at, max(occurred_at) AS last_at FROM episodes GROUP BY session")
def session_summaries(spark, d):
    return episodes.sessions(t.episodes(spark, d))


@query("SELECT id, session, seq, role FROM episodes WHERE session = 5 ORDER BY abs(seq - 2), seq LIMIT 3")
def session_around(spark, d):
    return episodes.around(t.episodes(spark, d), 5, 2, 3).select("id", "session", "seq", "role")


@query("SELECT session, n, human FROM (SELECT session, count(*) AS n, count(*) FILTER (role = 'human') AS human, max(occurred_at) AS m FROM episodes GROUP BY session) ORDER BY m DESC, session DESC LIMIT 1")
def resume_last_session(spark, d):
    return episodes.sessions(t.episodes(spark, d)).orderBy(F.desc("last_at"), F.desc("session")).limit(1).select("session", "n", "human")


@query("SELECT session, id, seq FROM episodes e WHERE role = 'human' AND right(rtrim(text, ' '), 1) = '?' AND NOT EXISTS (SELECT 1 FROM episodes f WHERE f.session = e.session AND f.role = 'human' AND f.seq > e.seq)")
def resume_open_questions(spark, d):
    return episodes.open_questions(t.episodes(spark, d)).select("session", "id", "seq")


@query("SELECT session, id, seq FROM episodes e WHERE role = 'human' AND NOT EXISTS (SELECT 1 FROM episodes f WHERE f.session = e.session AND f.seq > e.seq)")
def resume_unanswered(spark, d):
    return episodes.open_turns(t.episodes(spark, d)).select("session", "id", "seq")


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[\s.,:;!?()]+'), lambda x: x <> '')"
_WEIGHTS = f"""tok AS (SELECT id, session, seq, occurred_at, length(text) AS len, unnest(list_distinct({_TOKENS})) AS term FROM episodes),
weights AS (SELECT term, count(*) AS df, round(ln((SELECT count(*) FROM episodes) / CAST(count(*) AS DOUBLE)) + 1, 3) AS idf FROM tok WHERE term IN {TERMS} GROUP BY term)"""


@query(f"WITH {_WEIGHTS} SELECT term, df, idf FROM weights")
def term_weights(spark, d):
    return episodes.term_weights(t.episodes(spark, d), TERMS)


_RECALL = "SELECT id, session, seq, count(*) AS matched, round(sum(idf) / (1 + ln(1 + len / 240.0)), 4) AS score FROM tok JOIN weights USING (term) {where} GROUP BY id, session, seq, len"


@query(f"WITH {_WEIGHTS} {_RECALL.format(where='')}")
def recall_terms(spark, d):
    return episodes.recall(t.episodes(spark, d), TERMS)


@query(f"WITH {_WEIGHTS} {_RECALL.format(where=chr(87) + 'HERE occurred_at >= TIMESTAMP ' + chr(39) + '2024-01-02' + chr(39) + ' AND occurred_at < TIMESTAMP ' + chr(39) + '2024-01-03' + chr(39))}")
def recall_window(spark, d):
    return episodes.recall(t.episodes(spark, d), TERMS, F.lit("2024-01-02").cast("timestamp_ntz"), F.lit("2024-01-03").cast("timestamp_ntz"))


@query(f"SELECT id, session, seq, tier FROM (SELECT *, CASE WHEN contains(lower(text), 'the in') THEN 1 WHEN len(list_intersect(['the', 'in'], {_TOKENS})) = 2 THEN 2 END AS tier FROM episodes) WHERE tier IS NOT NULL")
def search_phrase(spark, d):
    return episodes.tiered(t.episodes(spark, d), "the in")


@query(r"""WITH l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM episodes WHERE length(text) >= 900)
SELECT id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^\|.*\|$') OR regexp_matches(x, '^[+|][-+|\s]{6,}$') OR regexp_matches(x, '^[┌├└│]') OR (regexp_matches(x, '->|→|=>') AND length(x) < 200) OR regexp_matches(x, '^(?:[-*]|[0-9]+\.)\s+\*\*')
 OR starts_with(x, '```') OR regexp_matches(x, '^#{1,4}\s'))) AS BIGINT) AS n_machine FROM l""")
def machine_prose(spark, d):
    return episodes.machine_lines(t.episodes(spark, d))


@query(r"""WITH w AS (SELECT id, session, seq, role, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM episodes),
g AS (SELECT DISTINCT id, session, seq, role, unnest(list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' '))) AS g FROM w WHERE len(ws) >= 10),
f AS (SELECT session, g, min(seq) AS first FROM g WHERE role = 'agent' GROUP BY session, g)
SELECT id, count(*) AS shingles, count(*) FILTER (first < seq) AS quoted FROM g LEFT JOIN f USING (session, g) WHERE role = 'human' GROUP BY id HAVING count(*) >= 4""")
def quoted_ratio(spark, d):
    return episodes.quoted(t.episodes(spark, d))


@query("SELECT id, CAST(upto AS BIGINT) AS upto FROM (SELECT id, sum(length(text)) OVER (ORDER BY occurred_at DESC, id DESC) AS upto FROM episodes) WHERE upto <= 20000")
def budget_newest(spark, d):
    return episodes.newest_within(t.episodes(spark, d), 20_000)


_IMPACT = """WITH up AS (SELECT src AS id, 1 AS depth, CASE confidence WHEN 'measured' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END AS rank, kind AS via FROM edges WHERE dst = 7 {kinds}
UNION SELECT e.src, u.depth + 1, greatest(u.rank, CASE confidence WHEN 'measured' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END), e.kind FROM edges e JOIN up u ON e.dst = u.id WHERE u.depth < {depth} {kinds})
SELECT id, depth, ['measured', 'derived', 'unverified'][1 + rank] AS confidence, via FROM up QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, rank, via) = 1"""


@query(_IMPACT.format(kinds="", depth=3))
def impact_depth_n(spark, d):
    return graph.impact(t.edges(spark, d), 7, 3)


@query(_IMPACT.format(kinds="AND kind IN ('calls', 'uses')", depth=4))
def impact_kind_filter(spark, d):
    return graph.impact(t.edges(spark, d), 7, 4, ["calls", "uses"])


_LOOKUP = "WITH lookups AS (SELECT DISTINCT replace(p_name, ' ', '_') AS lookup FROM part UNION SELECT 'nowhere')"


@query(f"""{_LOOKUP}, f AS (SELECT name, count(*) AS n, min(id) AS dst FROM symbols GROUP BY name)
SELECT lookup, CASE WHEN n = 1 THEN 'unique' WHEN n BETWEEN 2 AND 8 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, CASE WHEN n = 1 THEN dst END AS dst, coalesce(n, 0) AS n FROM lookups LEFT JOIN f ON name = lookup""")
def edges_resolved(spark, d):
    s = t.symbols(spark, d)
    lookups = s.select(F.col("name").alias("lookup")).distinct().union(spark.createDataFrame([("nowhere",)], "lookup string"))
    return graph.resolve(lookups, s)


@query("SELECT id, name, fqn, path, lower(name) = 'red_bolt' AS exact FROM symbols WHERE contains(lower(name), 'red_bolt') ORDER BY exact DESC, length(name), name, path, id LIMIT 25")
def symbol_search(spark, d):
    return graph.find(t.symbols(spark, d), "red_bolt", 25)


@query("SELECT kind, confidence, count(*) AS n FROM edges GROUP BY ALL")
def graph_histograms(spark, d):
    return graph.histogram(t.edges(spark, d))


@query("SELECT o_custkey AS repo, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS index_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def latest_index(spark, d):
    o = t.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("repo"), "o_orderdate", F.col("o_orderkey").alias("index_id"))
    return o.groupBy("repo").agg(F.max_by("index_id", F.struct("o_orderdate", "index_id")).alias("index_id"))


@query("SELECT o_orderkey AS index_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 3 AS doomed FROM orders")
def retention_doomed(spark, d):
    return reads.keep_newest(t.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select(F.col("o_orderkey").alias("index_id"), "doomed")


@query("SELECT DISTINCT c_custkey % 50 AS index_id, l AS language FROM customer, (VALUES ('rust'), ('python'), ('cuda')) v(l) WHERE (c_custkey % 50, l) NOT IN (SELECT p_partkey % 50, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'rust' END FROM part)")
def silent_languages(spark, d):
    declared = t.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("index_id"), F.explode(F.array(*map(F.lit, ("rust", "python", "cuda")))).alias("language")).distinct()
    return graph.silent(declared, t.code(spark, d).select("index_id", F.col("family").alias("language")))


_PREFS = """prefs AS (SELECT scope, signature, count(*) AS occasions, count(DISTINCT actor) AS humans, min(created_at) AS first_seen, max(created_at) AS last_seen, arg_max(value, (created_at, id)) AS latest,
 CASE WHEN count(DISTINCT actor) >= 3 THEN 'org' WHEN count(DISTINCT actor) = 2 THEN 'team' ELSE 'personal' END AS tier FROM feedback GROUP BY scope, signature HAVING count(*) >= 2)"""


@query(f"WITH {_PREFS} SELECT scope, signature, occasions, humans, first_seen, last_seen, latest, tier FROM prefs")
def preference_candidates(spark, d):
    return people.preference_candidates(t.feedback(spark, d))


@query(f"WITH {_PREFS} SELECT signature, scope, tier, occasions, ord - 1 AS distance FROM prefs JOIN chain USING (scope) QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord) = 1")
def preference_nearest(spark, d):
    return people.nearest_preference(people.preference_candidates(t.feedback(spark, d)), CHAIN)


@query("SELECT actor, signature, occasion, id FROM feedback")
def feedback_dedupe(spark, d):
    return t.feedback(spark, d).select("actor", "signature", "occasion", "id")


@query(r"""WITH k AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM prose),
a AS (SELECT count(*) AS n, avg(len(ws)) AS average FROM k),
f AS (SELECT doc_id, line, len(ws) AS len, term, len(list_filter(ws, lambda x: x = term)) AS tf FROM k, (VALUES ('license'), ('the'), ('data')) v(term) WHERE list_contains(ws, term)),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, a GROUP BY term, n)
SELECT doc_id, line, round(sum(idf * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * len / average))), 4) AS score FROM f JOIN i USING (term), a GROUP BY doc_id, line""")
def bm25_lines(spark, d):
    return prose.bm25(prose.lines(t.table(spark, d, "documents")), ("license", "the", "data"))


_KV = r"""kv AS (SELECT doc_id, line, lower(regexp_extract(text, '^\s*([A-Za-z][A-Za-z _-]{1,40})\s*[:=]\s*(\S.{0,60})$', 1)) AS predicate, regexp_extract(text, '^\s*([A-Za-z][A-Za-z _-]{1,40})\s*[:=]\s*(\S.{0,60})$', 2) AS object
 FROM noted WHERE regexp_matches(text, '^\s*([A-Za-z][A-Za-z _-]{1,40})\s*[:=]\s*(\S.{0,60})$'))"""


@query(f"WITH {_KV} SELECT * FROM kv")
def proposals_kv(spark, d):
    return prose.key_values(prose.lines(t.notes(spark, d)))


@query(f"WITH {_KV} SELECT predicate, arg_min(doc_id, (doc_id, line)) AS doc_id, arg_min(line, (doc_id, line)) AS line, count(*) AS n FROM kv GROUP BY predicate")
def proposals_dedup(spark, d):
    return prose.first_of_each(prose.key_values(prose.lines(t.notes(spark, d))), ["predicate"])


@query(r"""WITH w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM (SELECT * FROM prose UNION ALL SELECT doc_id + 1000000, line, text FROM noted)),
s AS (SELECT *, CASE WHEN list_has_any(ws, ['must', 'never', 'always', 'shall']) THEN 3 WHEN list_has_any(ws, ['should', 'required']) THEN 2 WHEN list_has_any(ws, ['avoid', 'prefer']) THEN 1 END AS strength FROM w WHERE NOT list_contains(ws, 'retracted'))
SELECT array_to_string(ws, ' ') AS rule, max(strength) AS strength, count(*) AS repeats, arg_min(doc_id, (doc_id, line)) AS doc_id, arg_min(line, (doc_id, line)) AS line, bool_or(list_has_any(ws, ['mit', 'lint', 'deny'])) AS enforced FROM s WHERE strength IS NOT NULL GROUP BY 1""")
def doctrine_unenforced(spark, d):
    rows = prose.lines(t.table(spark, d, "documents")).unionByName(prose.lines(t.notes(spark, d)).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    return prose.doctrine(rows, spark.createDataFrame([("mit",), ("lint",), ("deny",)], "token string"))


_NOW = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"""WITH act AS (SELECT user_id % 50 AS node_id, arg_max(event_type, event_id) AS activity, arg_max(ts, event_id) AS activity_at FROM events GROUP BY 1),
h AS (SELECT node_id, string_agg(path, ',' ORDER BY claimed_at, path) AS paths FROM claims WHERE NOT released GROUP BY node_id)
SELECT n.node_id, label, scope, CASE WHEN n.node_id % 9 = 4 THEN n.node_id % 2 = 0 AND s < 36001 ELSE s < 36001 END AS live, activity, activity_at, coalesce(paths, '') AS paths
FROM (SELECT *, CAST(floor(epoch({_NOW}) - epoch(heartbeat_at)) AS BIGINT) AS s FROM nodes) n LEFT JOIN act USING (node_id) LEFT JOIN h USING (node_id) WHERE NOT retired AND scope IN ('org/acme', 'org/acme/proj/a')""")
def fleet_view(spark, d):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    n = F.col("node_id")  # some workers never beat; of these half were seen
    nodes = t.nodes(spark, d).withColumn("last_seen", F.when(n % 2 == 0, F.col("heartbeat_at"))).withColumn("heartbeat_at", F.when(n % 9 != 4, F.col("heartbeat_at")))
    return people.fleet(nodes, t.activity(spark, d), t.claims(spark, d), now, 36_001, ["org/acme", "org/acme/proj/a"]).drop("seconds_ago")


@query("SELECT path, count(DISTINCT node_id) AS holders, min(claimed_at) AS since FROM claims JOIN nodes USING (node_id) WHERE NOT released AND NOT retired GROUP BY path HAVING count(DISTINCT node_id) > 1")
def fleet_collisions(spark, d):
    return people.collisions(t.claims(spark, d), t.nodes(spark, d))


@query("""WITH h AS (SELECT claim_id, node_id, path FROM claims JOIN nodes USING (node_id) WHERE NOT released AND NOT retired) SELECT h.claim_id, h.node_id, h.path, list_sort(list(DISTINCT o.node_id)) AS others FROM h JOIN h o ON o.path = h.path AND o.node_id <> h.node_id GROUP BY ALL""")
def fleet_contenders(spark, d):
    return people.contenders(t.claims(spark, d), t.nodes(spark, d))


@query("SELECT node_id, label, scope FROM nodes WHERE scope = 'org/acme/proj' OR starts_with(scope, 'org/acme/proj/')")
def nodes_subtree(spark, d):
    return reads.subtree(t.nodes(spark, d), "org/acme/proj").select("node_id", "label", "scope")


_LATEST = "latest AS (SELECT target, outcome, reason, checked_at FROM verifications QUALIFY row_number() OVER (PARTITION BY target ORDER BY checked_at DESC, id DESC) = 1)"


@query(f"WITH {_LATEST} SELECT * FROM latest")
def verification_latest(spark, d):
    return people.latest_verification(t.verifications(spark, d))


@query(f"""WITH {_LATEST} SELECT l.id, l.asserted_at, outcome AS last_outcome FROM live l LEFT JOIN latest v ON v.target = l.id
WHERE confidence = 'unverified' AND (v.target IS NULL OR (reason IS DISTINCT FROM 'no_commit_in_evidence' AND checked_at < TIMESTAMP '2024-01-29 00:00:00'))""")
def verification_candidates(spark, d):
    return people.verification_candidates(t.ledger(spark, d), t.verifications(spark, d), F.lit("2024-01-29").cast("timestamp_ntz"))


@query("SELECT id, scope, subject, predicate FROM live u WHERE confidence = 'unverified' AND EXISTS (SELECT 1 FROM live m WHERE m.confidence = 'measured' AND m.scope = u.scope AND m.subject = u.subject AND m.predicate = u.predicate)")
def duplicate_shadowed(spark, d):
    return people.shadowed(t.ledger(spark, d)).select("id", "scope", "subject", "predicate")


@query("SELECT event_id AS seq, 'assertion.created' AS topic, user_id % 3 AS scope FROM events WHERE event_id % 3 <> 0")
def outbox_unconsumed(spark, d):
    done = t.table(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("seq"))
    return jobs.unconsumed(jobs.outbox(spark, f"{d}/events.parquet"), done)


@query("SELECT DISTINCT user_id AS actor, event_type AS signature, CAST(ts AS DATE) AS occasion FROM events")
def feedback_stream(spark, d):
    return jobs.once_per_occasion(spark, f"{d}/events.parquet")

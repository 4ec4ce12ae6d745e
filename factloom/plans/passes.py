"""Registered queries on passes that record what they decide, and on why code is as it is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import disputes, people, preferences, records, verify, why, writes
from ..sources import tables as t
from ..sources.appended import Appended
from ..streaming import jobs
from .catalogue import CHAIN, query
from .talk import _RECORD

_NTZ = "timestamp_ntz"
_VERIFIED = f"{_RECORD}, why string, verification_id long"


def _folder(spark, kind: str) -> str:
    return f"{jobs.shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def verified(spark: SparkSession, d: str) -> tuple[writes.Store, DataFrame]:
    """A ledger of the live unverified rows after a pass over them, sent twice, and what the pass said. Commits are parts."""
    i, p = F.col("id"), F.col("p_partkey")
    store, checks = writes.Store(spark, _folder(spark, "verified"), _VERIFIED), Appended(spark, _folder(spark, "checks"), verify.CHECKS)
    rows = t.ledger(spark, d).where("superseded_by IS NULL AND confidence = 'unverified'")
    rows = rows.select("id", "scope", "subject", "predicate", "value", "kind", "confidence", F.concat(F.lit("log:"), i.cast("string")).alias("source"), F.lit("because").alias("why"), "valid_from", "valid_to")
    store.append(records.batch(rows.withColumn("reopen_if", F.lit("new data"))), "rows")
    x = F.floor(i / 4)
    evidence = rows.select("id", F.when(x % 5 == 0, "q").otherwise(F.concat(F.lit("r"), (x % 400 % 3).cast("string"))).alias("repo"), F.when(x % 6 != 0, (x % 400).cast("string")).alias("commit_sha"), F.when(x % 7 == 0, F.array(F.lit("main"))).alias("refs"))
    commits = t.table(spark, d, "part").select(F.concat(F.lit("r"), (p % 3).cast("string")).alias("repo"), p.cast("string").alias("commit_sha"), F.array(F.when(F.col("p_size") % 2 == 0, "main").otherwise("rel")).alias("contained_in"))
    repos = commits.select("repo", F.lit("main").alias("default_branch")).distinct()
    now = F.lit("2026-01-01").cast(_NTZ)
    verify.run(store, checks, evidence, repos, commits, "pass", now, now)
    return store, verify.run(store, checks, evidence, repos, commits, "pass", now, now)


_PASS = """u AS (SELECT *, id // 4 AS x FROM live WHERE confidence = 'unverified'),
j AS (SELECT u.*, CASE WHEN x % 6 = 0 THEN 'no_commit_in_evidence' WHEN x % 5 = 0 THEN 'repository_unreadable' WHEN p_partkey IS NULL THEN 'commit_not_found' WHEN x % 7 = 0 AND p_size % 2 = 1 THEN 'not_contained' END AS reason, p_size % 2 = 1 AS branch,
 (SELECT max(id) FROM u) + row_number() OVER (ORDER BY id) AS verification_id, count(*) OVER () AS n FROM u LEFT JOIN part ON p_partkey = x % 400),
v AS (SELECT *, CASE WHEN reason IN ('no_commit_in_evidence', 'repository_unreadable') THEN 'unresolvable' WHEN reason IS NULL THEN 'confirmed' ELSE 'refuted' END AS outcome FROM j)"""


@query(f"WITH {_PASS} SELECT id AS target, outcome, reason, verification_id, CASE WHEN outcome = 'confirmed' THEN verification_id END AS promoted_to, CAST(NULL AS VARCHAR) AS refused FROM v")
def verification_pass(spark, d):
    return verified(spark, d)[1]


@query(f"""WITH {_PASS} SELECT id, subject, predicate, value, 'unverified' AS confidence, 'log:' || id AS source, CAST(NULL AS BIGINT) AS supersedes FROM v WHERE outcome <> 'confirmed'
UNION ALL SELECT verification_id, subject, predicate, value, 'measured', 'log:' || id || CASE WHEN branch THEN ' (branch only, not on main)' ELSE '' END, id FROM v WHERE outcome = 'confirmed'
UNION ALL SELECT verification_id + n, 'assertion:' || id, 'verification_outcome', CASE outcome WHEN 'confirmed' THEN 1 WHEN 'refuted' THEN 0 END, 'measured', 'verification:' || verification_id, NULL FROM v""")
def verification_recorded(spark, d):
    """The live rows of the ledger after the pass."""
    return verified(spark, d)[0].assertions().where("superseded_by IS NULL").select("id", "subject", "predicate", "value", "confidence", "source", "supersedes")


#: An excerpt of flat around its first match (pre before it, hit long), as SQL.
_CUT = r"""f AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS flat FROM m),
g AS (SELECT *, length(regexp_extract(flat, {pattern}, 1)) AS at_, length(regexp_extract(flat, {pattern}, 2)) AS hit, length(flat) AS n FROM f),
h AS (SELECT *, greatest(at_ - 72, 0) AS s0 FROM g), h1 AS (SELECT *, greatest(least(n, s0 + 240), least(n, at_ + hit)) AS e0 FROM h),
h2 AS (SELECT *, instr(substr(flat, s0 + 1), ' ') AS gap, e0 + 1 - instr(reverse(substr(flat, 1, e0 + 1)), ' ') AS last_ FROM h1),
h3 AS (SELECT *, CASE WHEN s0 > 0 AND gap > 0 AND s0 + gap - 1 < at_ THEN s0 + gap ELSE s0 END AS b, CASE WHEN e0 < n AND last_ <= e0 AND last_ > at_ + hit THEN last_ ELSE e0 END AS e FROM h2),
x AS (SELECT *, CASE WHEN b > 0 THEN '…' ELSE '' END || trim(substr(flat, b + 1, e - b), ' ') || CASE WHEN e < n THEN '…' ELSE '' END AS excerpt FROM h3)"""


def _why_sql(symbol: list[str], path: list[str], base: list[str], facts: list[str]) -> str:
    """m, the turns that the needles find, x, with excerpts, and w, the facts."""
    one = lambda ns: "false" if not ns else f"regexp_matches(text, '\\b({'|'.join(ns)})\\b', 'i')"
    cut = _CUT.replace("{pattern}", "'(?i)^(.*?)\\b(" + "|".join([*symbol, *path, *base]) + ")\\b'")
    return f"""m AS (SELECT *, CASE WHEN {one(symbol)} THEN 0 WHEN {one(path)} THEN 1 WHEN {one(base)} THEN 2 END AS r FROM episodes WHERE r IS NOT NULL ORDER BY r, occurred_at DESC, id DESC LIMIT 20), {cut},
w AS (SELECT id, row_number() OVER (ORDER BY len(string_split(scope, '/')) DESC, asserted_at DESC, id DESC) AS rn FROM live JOIN chain USING (scope) WHERE regexp_matches(subject, '\\b({'|'.join(facts)})\\b', 'i') ORDER BY rn LIMIT 20)"""


def _shown(row: DataFrame) -> DataFrame:
    """An answer's parts, each turn as its id, needle and excerpt, and facts as ids, as rows of text."""
    turn = F.transform("mentions", lambda m: F.concat_ws("|", m["id"].cast("string"), m["why"], m["excerpt"]))
    return row.select("target", "resolved.kind", "resolved.path", "resolved.line_start", F.array_join(turn, "\n").alias("mentions"), F.array_join(F.transform("facts", lambda f: f["id"].cast("string")), ",").alias("facts"), (F.col("note").isNotNull()).alias("noted"))


_SHOWN = "(SELECT coalesce(string_agg(id || '|' || ['symbol', 'path', 'basename'][1 + r] || '|' || excerpt, chr(10) ORDER BY r, occurred_at DESC, id DESC), '') FROM x) AS mentions, (SELECT coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn), '') FROM w) AS facts"


@query(f"WITH {_why_sql([], ['of/der'], ['der'], ['of/der', 'der'])} SELECT 'of/der' AS target, 'path' AS kind, 'of/der' AS path, CAST(NULL AS BIGINT) AS line_start, {_SHOWN}, true AS noted")
def why_path_answer(spark, d):
    return _shown(why.why_path(t.episodes(spark, d), t.ledger(spark, d), "./of/der/", CHAIN))


def _asked(spark, d, symbol: str, repo: str | None = None) -> DataFrame:
    """Symbols named after words that are said, in two indexes of a repository; the older one has what the newer has not."""
    p = F.col("p_partkey")
    word = F.element_at(F.split("p_name", " "), 1)
    symbols = t.table(spark, d, "part").select((p % 2).alias("index_id"), F.when(p < 3, "the").otherwise(word).alias("name"), F.when(p < 3, "m::the").otherwise(F.concat(F.lit("m::"), word)).alias("fqn"), F.concat(F.lit("src/f"), p.cast("string"), F.lit(".rs")).alias("path"), p.alias("line_start"))
    indexes = t.table(spark, d, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("long").alias("index_id"), F.lit("r").alias("repo"), F.lit("abc").alias("commit_sha"), F.lit("org/acme").alias("scope"), F.col("r_regionkey").alias("indexed_at"), F.lit(True).alias("completed"))
    return _shown(why.why_symbol(t.episodes(spark, d), t.ledger(spark, d), symbols, indexes, symbol, CHAIN, repo))


@query(f"WITH {_why_sql(['m::the', 'the'], ['src/f1.rs'], ['f1.rs'], ['m::the', 'the', 'f1.rs'])} SELECT 'm::the' AS target, 'symbol' AS kind, 'src/f1.rs' AS path, CAST(1 AS BIGINT) AS line_start, {_SHOWN}, false AS noted")
def why_symbol_answer(spark, d):
    return _asked(spark, d, "m::the")


@query(f"WITH {_why_sql(['zzqx'], [], [], ['zzqx'])} SELECT 'zzqx' AS target, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS BIGINT) AS line_start, {_SHOWN}, true AS noted")
def why_symbol_unknown(spark, d):
    return _asked(spark, d, "zzqx", "r")


def _learned(spark, d) -> preferences.Preferences:
    """Preferences after two promotions, of half of the feedback and of all, the second sent twice."""
    prefs = preferences.Preferences(writes.Store(spark, _folder(spark, "learned"), _VERIFIED), _folder(spark, "preferences"))
    said = t.feedback(spark, d)
    prefs.promote(said.where("id % 2 = 0"), "half")
    prefs.promote(said, "all")
    prefs.promote(said, "all")
    return prefs


_TIERED = "SELECT scope, signature, count(*) AS occasions, count(DISTINCT actor) AS humans, CASE WHEN count(DISTINCT actor) >= 3 THEN 'org' WHEN count(DISTINCT actor) = 2 THEN 'team' ELSE 'personal' END AS tier FROM feedback WHERE {} GROUP BY 1, 2 HAVING count(*) > 1"


@query(f"""WITH h AS ({_TIERED.format("id % 2 = 0")}), a AS ({_TIERED.format("true")}), first_ AS (SELECT scope, signature, arg_min(actor, struct_pack(a := created_at, b := id)) AS human FROM feedback GROUP BY 1, 2)
SELECT a.*, tier = 'org' AS binding, 'active' AS status, CAST(human AS VARCHAR) AS human, h.occasions IS NOT NULL AND h.occasions <> a.occasions AS follows FROM a LEFT JOIN (SELECT scope, signature, occasions FROM h) h USING (scope, signature) JOIN first_ f USING (scope, signature) WHERE h.occasions IS DISTINCT FROM a.occasions
UNION ALL SELECT a.*, a.tier = 'org', 'active', (SELECT CAST(arg_min(actor, struct_pack(a := created_at, b := id)) AS VARCHAR) FROM feedback f WHERE f.scope = a.scope AND f.signature = a.signature AND id % 2 = 0), false FROM a JOIN h USING (scope, signature) WHERE h.occasions = a.occasions""")
def preferences_recorded(spark, d):
    return _learned(spark, d).rows().select("scope", "signature", "occasions", "humans", "tier", "binding", "status", "human", F.col("supersedes").isNotNull().alias("follows"))


@query("""WITH c AS (SELECT event_id, 'user:' || (user_id % 20) AS s, event_type AS p, event_id % 7 AS v FROM events)
SELECT event_id AS id, s || '|' || p || '|' || sha256('{"a":' || v || ',"b":["use tabs",' || v || ']}') AS signature FROM c""")
def preference_signatures(spark, d):
    """Feedback spelled in several ways that mean the same."""
    i, v = F.col("event_id"), (F.col("event_id") % 7).cast("string")
    tabs = F.when(i % 3 == 0, "Use  Tabs").when(i % 3 == 1, " use\\ttabs ").otherwise("\uff55\uff53\uff45 TABS")
    a, b = F.concat(F.lit('"A": '), v, F.when(i % 2 == 0, ".0").otherwise("")), F.concat(F.lit('"b": ["'), tabs, F.lit('", '), v, F.lit("]"))
    correction = F.when(i % 5 < 2, F.concat(F.lit("{"), a, F.lit(", "), b, F.lit("}"))).otherwise(F.concat(F.lit("{"), b, F.lit(","), a, F.lit("}")))
    subject = F.concat(F.when(i % 2 == 0, "USER:").otherwise(" user:"), (F.col("user_id") % 20).cast("string"))
    return t.table(spark, d, "events").select(i.alias("id"), preferences.signature(subject, F.upper("event_type"), correction).alias("signature"))


@query("""WITH a AS (SELECT user_id % 50 AS node_id, max(ts) FILTER (event_id % 3 = 0) AS said, max(ts) AS beat FROM events GROUP BY 1)
SELECT node_id, greatest(beat - INTERVAL 1 HOUR, said) AS heartbeat_at FROM a""")
def activity_reported(spark, d):
    """Nodes whose reports, some sent twice, move their heartbeat on."""
    log = Appended(spark, _folder(spark, "activity"), "node_id long, seq long, statement string, occurred_at timestamp_ntz")
    said = t.activity(spark, d).where("seq % 3 = 0")
    for name in ("one", "one"):
        log.append(said, name)
    return people.reported(t.nodes(spark, d).withColumn("heartbeat_at", F.col("heartbeat_at") - F.expr("INTERVAL 1 HOUR")), log.rows()).select("node_id", "heartbeat_at")


@query("SELECT DISTINCT ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + o_custkey % 3] AS scope FROM orders")
def mission_scopes(spark, d):
    return disputes.live_scopes(t.missions(spark, d)).select("scope")

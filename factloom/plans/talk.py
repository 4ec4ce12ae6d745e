"""Registered queries on episodes, prose, rules, preferences and the fleet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import doctrine, episodes, people, prose, recall, records, similar, writes
from ..sources import prose_files
from ..sources import tables as t
from ..streaming import jobs
from .catalogue import _PREFS, _TOKENS, CHAIN, query

_NTZ = "timestamp_ntz"
_QUESTION = "What did you say of the data in der zu les?"
_PROBES = ("say", "data", "der", "zu", "les")


def _holds(probes=_PROBES) -> str:
    return ", ".join(f"contains(lower(text), '{p}')" for p in probes)


#: The plan of _QUESTION: its probes that occur, and their weights.
_PLAN = f"""probes AS (SELECT unnest({list(_PROBES)}) AS probe),
plan AS (SELECT probe, count(*) AS df, round(ln((SELECT count(*) FROM episodes) / CAST(count(*) AS DOUBLE)) + 1, 3) AS idf FROM probes JOIN episodes ON contains(lower(text), probe) GROUP BY probe),
rare AS (SELECT ln(greatest(count(*), 4) / 4.0) + 1 AS bar FROM episodes)"""
_SCORED = """, scored AS (SELECT e.id, e.session, e.seq, e.occurred_at, coalesce(string_agg(probe, ',' ORDER BY idf DESC, probe), '') AS matched, round(coalesce(sum(idf), 0) / (1 + ln(1 + length(text) / 240.0)), 4) AS score,
 count(probe) >= 2 OR coalesce(bool_or(idf >= (SELECT bar FROM rare)), false) AS strong FROM {rows} e LEFT JOIN plan ON contains(lower(text), probe) GROUP BY e.id, e.session, e.seq, e.occurred_at, text)"""
_RECALL = ["id", "session", "seq", "matched", "score", "tier"]


@query(f"WITH {_PLAN} SELECT probe AS term, probe, 'exact' AS via, df, idf FROM plan")
def recall_plan(spark: SparkSession, d: str) -> DataFrame:
    return episodes.weighed(t.episodes(spark, d), episodes.content_terms(_QUESTION))


@query(f"WITH {_PLAN} {_SCORED.format(rows='episodes')} SELECT id, session, seq, matched, score, CASE WHEN strong THEN 'term' ELSE 'window' END AS tier FROM scored WHERE matched <> '' ORDER BY score DESC, occurred_at, id LIMIT 12")
def recall_ranked(spark, d):
    return episodes.recalled(t.episodes(spark, d), _QUESTION).select(*_RECALL)


_DAY = "occurred_at >= TIMESTAMP '2024-01-01 06:00:00' AND occurred_at < TIMESTAMP '2024-01-01 18:00:00'"
_HALF = (F.lit, "2024-01-01 06:00:00", "2024-01-01 18:00:00")


@query(f"WITH {_PLAN}, inside AS (SELECT * FROM episodes WHERE {_DAY}) {_SCORED.format(rows='inside')} SELECT id, session, seq, matched, score, CASE WHEN strong THEN 'term+window' ELSE 'window' END AS tier FROM scored ORDER BY matched <> '' DESC, score DESC, occurred_at, id LIMIT 12")
def recall_in_window(spark, d):
    return episodes.recalled(t.episodes(spark, d), _QUESTION, (F.lit(_HALF[1]).cast(_NTZ), F.lit(_HALF[2]).cast(_NTZ))).select(*_RECALL)


@query(f"WITH {_PLAN} {_SCORED.format(rows='episodes')} SELECT id, session, seq, matched, score, CASE WHEN strong THEN 'term' ELSE 'window' END AS tier FROM scored WHERE matched <> '' ORDER BY score DESC, occurred_at, id LIMIT 12")
def recall_fallback(spark, d):
    """A window without turns, whatever the turns are: a day that begins a day after the last one. The whole scope answers."""
    turns = t.episodes(spark, d)
    last = episodes.bounds(turns).first()["last_at"]  # one row
    last = F.lit(last or "2031-01-01").cast(_NTZ)
    return episodes.recalled(turns, _QUESTION, (last + F.expr("INTERVAL 1 DAY"), last + F.expr("INTERVAL 2 DAYS"))).select(*_RECALL)


@query(f"SELECT id, session, seq, '' AS matched, CAST(0 AS DOUBLE) AS score, 'window' AS tier FROM episodes WHERE {_DAY} ORDER BY occurred_at, id LIMIT 60")
def recall_window_alone(spark, d):
    """Nothing in the question tells turns apart, so the window itself answers, in order of time."""
    return episodes.recalled(t.episodes(spark, d), "zzqx?", (F.lit(_HALF[1]).cast(_NTZ), F.lit(_HALF[2]).cast(_NTZ))).select(*_RECALL)


@query(f"SELECT count(*) AS n FROM episodes WHERE {_DAY}")
def recall_window_total(spark, d):
    return t.episodes(spark, d).where((F.col("occurred_at") >= F.lit(_HALF[1]).cast(_NTZ)) & (F.col("occurred_at") < F.lit(_HALF[2]).cast(_NTZ))).agg(F.count(F.lit(1)).alias("n"))


def _index(spark, d) -> recall.Index:
    """An index of all turns, those of even sessions first; the second batch comes twice."""
    index = recall.Index(spark, f"{jobs.shared_dir(spark)}/index-{uuid.uuid4().hex}")
    turns = t.episodes(spark, d)
    index.ingest(turns.where("session % 2 = 0"), "even")
    index.ingest(turns, "all")
    index.ingest(turns, "all")
    return index


@query(f"WITH {_PLAN} SELECT probe AS term, probe, 'exact' AS via, df, idf FROM plan")
def recall_index_plan(spark, d):
    plan = _index(spark, d).plan(_QUESTION)[0]
    return spark.createDataFrame([tuple(p[c] for c in ("term", "probe", "via", "df", "idf")) for p in plan], "term string, probe string, via string, df long, idf double")


@query(f"WITH {_PLAN} {_SCORED.format(rows='episodes')} SELECT id, session, seq, matched, score, CASE WHEN strong THEN 'term' ELSE 'window' END AS tier FROM scored WHERE matched <> '' ORDER BY score DESC, occurred_at, id LIMIT 12")
def recall_indexed(spark, d):
    return _index(spark, d).recalled(_QUESTION).hits.select(*_RECALL)


@query(f"WITH {_PLAN}, inside AS (SELECT * FROM episodes WHERE {_DAY}) {_SCORED.format(rows='inside')} SELECT id, session, seq, matched, score, CASE WHEN strong THEN 'term+window' ELSE 'window' END AS tier FROM scored ORDER BY matched <> '' DESC, score DESC, occurred_at, id LIMIT 12")
def recall_indexed_window(spark, d):
    return _index(spark, d).recalled(_QUESTION, (F.lit(_HALF[1]).cast(_NTZ), F.lit(_HALF[2]).cast(_NTZ))).hits.select(*_RECALL)


@query(f"WITH {_PLAN} {_SCORED.format(rows='episodes')}, top AS (SELECT id, session, seq FROM scored WHERE matched <> '' ORDER BY score DESC, occurred_at, id LIMIT 12) SELECT top.id AS hit, e.id, e.session, e.seq, e.role FROM top JOIN episodes e ON e.session = top.session AND abs(e.seq - top.seq) = 1")
def recall_nearby(spark, d):
    return _index(spark, d).recalled(_QUESTION).nearby(t.episodes(spark, d)).select("hit", "id", "session", "seq", "role")


@query("SELECT min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) AS n FROM episodes")
def corpus_bounds(spark, d):
    return episodes.bounds(t.episodes(spark, d))


@query("SELECT id, seq, role FROM episodes WHERE session = 5 ORDER BY seq")
def session_ordered(spark, d):
    return t.episodes(spark, d).where("session = 5").orderBy("seq").select("id", "seq", "role")


@query("SELECT id, seq FROM episodes WHERE session = 5 ORDER BY seq DESC LIMIT 3")
def thread_tail(spark, d):
    return episodes.tail(t.episodes(spark, d), 5, 3).select("id", "seq")


@query("SELECT branch, count(*) AS n FROM episodes WHERE branch IS NOT NULL GROUP BY branch")
def resume_branch_histogram(spark, d):
    return episodes.branches(t.episodes(spark, d))


@query(f"""WITH s AS (SELECT *, CASE WHEN contains(lower(text), 'the in') THEN 1 WHEN len(list_intersect(['the', 'in'], {_TOKENS})) = 2 THEN 2 END AS tier FROM episodes)
SELECT id, session, seq, tier FROM s WHERE tier IS NOT NULL ORDER BY tier, occurred_at DESC, id DESC LIMIT 15""")
def search_tiers(spark, d):
    return episodes.searched(t.episodes(spark, d), "the in", 15).select("id", "session", "seq", "tier")


_NEEDLE = "thhat wass"


@query(rf"""WITH need AS (SELECT {similar.trigrams_of(_NEEDLE)} AS t), g AS (SELECT id, session, seq, occurred_at, flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))) AS l FROM episodes),
c AS (SELECT g.*, list_distinct(t) AS t FROM g, need WHERE len(list_intersect(t, l)) >= 0.45 * len(list_distinct(t))), p AS (SELECT id, unnest(list_filter(range(1, len(l) + 1), lambda i: list_contains(t, l[i]))) AS i FROM c),
x AS (SELECT c.id, session, seq, occurred_at, max(len(list_intersect(t, l[a.i:b.i])) / CAST(len(list_distinct(list_concat(t, l[a.i:b.i]))) AS DOUBLE)) AS s FROM c JOIN p a ON a.id = c.id JOIN p b ON b.id = c.id AND b.i BETWEEN a.i AND a.i + 60 GROUP BY ALL)
SELECT id, session, seq, 3 AS tier FROM x WHERE s >= 0.45 ORDER BY s DESC, occurred_at DESC, id DESC LIMIT 15""")
def search_last_tier(spark, d):
    return episodes.searched(t.episodes(spark, d), _NEEDLE, 15).select("id", "session", "seq", "tier")


_RESUME = """last AS (SELECT session, min(occurred_at) AS first_at, max(occurred_at) AS last_at, count(*) AS n, count(*) FILTER (role = 'human') AS human FROM episodes GROUP BY session ORDER BY last_at DESC, session DESC LIMIT 1),
own AS (SELECT e.* FROM episodes e JOIN last USING (session)),
resumed AS (SELECT session, n, human, (SELECT coalesce(list(branch ORDER BY k DESC, branch), []) FROM (SELECT branch, count(*) AS k FROM own WHERE branch IS NOT NULL GROUP BY branch)) AS branches, (SELECT list(id ORDER BY seq) FROM (SELECT * FROM own ORDER BY seq DESC LIMIT 3)) AS thread,
 (SELECT coalesce(list(id), []) FROM own o WHERE role = 'human' AND right(rtrim(text, ' '), 1) = '?' AND NOT EXISTS (SELECT 1 FROM own p WHERE p.role = 'human' AND p.seq > o.seq)) AS questions, round(epoch(TIMESTAMP '2026-01-01' - last_at) / 3600.0, 2) AS age_hours,
 coalesce((SELECT branch FROM own WHERE branch IS NOT NULL GROUP BY branch ORDER BY count(*) DESC, branch LIMIT 1) <> (SELECT branch FROM episodes ORDER BY occurred_at DESC, seq DESC LIMIT 1), false) AS drift, n = 1 AS single, human = 0 AS no_human FROM last)"""


def resume_of(spark, d) -> DataFrame:
    rows = episodes.resumed(t.episodes(spark, d), F.lit("2026-01-01").cast(_NTZ), k=3)
    ids = lambda c: F.transform(c, lambda x: x["id"])
    return rows.select("session", "n", "human", "branches", ids("thread").alias("thread"), ids("open_questions").alias("questions"), "age_hours", "drift", "stale", "single", "no_human")


@query(f"WITH {_RESUME} SELECT *, age_hours > 24 AS stale FROM resumed")
def resume_bundle(spark, d):
    return resume_of(spark, d)


@query(f"SELECT id, session, seq FROM episodes WHERE role = 'human' AND actor = 2 AND occurred_at <= TIMESTAMP '2024-01-03' ORDER BY occurred_at DESC, id DESC LIMIT 50")
def search_filter_only(spark, d):
    return episodes.filtered(t.episodes(spark, d), "human", 2, until=F.lit("2024-01-03").cast(_NTZ)).select("id", "session", "seq")


def _whole(names) -> str:
    return "'" + "|".join(rf"(^|[^A-Za-z0-9_]){n}($|[^A-Za-z0-9_])" for n in names) + "'"


@query(f"""SELECT id, why FROM (SELECT *, CASE WHEN regexp_matches(text, {_whole(["der"])}, 'i') THEN 'symbol' WHEN regexp_matches(text, {_whole(["les", "zu"])}, 'i') THEN 'path' WHEN regexp_matches(text, {_whole(["the"])}, 'i') THEN 'basename' END AS why FROM episodes)
WHERE why IS NOT NULL ORDER BY CASE why WHEN 'symbol' THEN 0 WHEN 'path' THEN 1 ELSE 2 END, occurred_at DESC, id DESC LIMIT 120""")
def why_path_tiers(spark, d):
    return episodes.mentions(t.episodes(spark, d), ["der"], ["les", "zu"], ["the"], 120).select("id", "why")


@query(f"""SELECT id, confidence, subject, predicate FROM live JOIN chain USING (scope) WHERE regexp_matches(subject, {_whole(["user:7", "user:9"])}, 'i') ORDER BY len(string_split(scope, '/')) DESC, asserted_at DESC, id DESC LIMIT 40""")
def why_symbol_facts(spark, d):
    from ..operators import reads

    rows = reads.live(t.ledger(spark, d)).where(F.col("scope").isin(CHAIN) & F.col("subject").rlike("|".join(map(episodes.needle, ("user:7", "user:9")))))
    return rows.orderBy(F.desc(F.size(F.split("scope", "/"))), F.desc("asserted_at"), F.desc("id")).limit(40).select("id", "confidence", "subject", "predicate")


#: Every third human turn repeats the middle of the agent's turn before it.
_ECHO = r"""heard AS (SELECT id, session, seq, role, CASE WHEN role = 'human' AND id % 3 = 0 THEN coalesce(substr(lag(text) OVER (PARTITION BY session ORDER BY seq), 40, 200), '') || ' ' || text ELSE text END AS text FROM episodes),
w AS (SELECT id, session, role, count(*) FILTER (role = 'agent') OVER (PARTITION BY session ORDER BY seq) AS a, list_filter(regexp_split_to_array(lower(CASE WHEN role = 'agent' THEN substr(text, 1, 4000) ELSE text END), '\s+'), lambda x: x <> '') AS ws FROM heard),
g AS (SELECT DISTINCT id, session, role, a, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))) AS g FROM w WHERE len(ws) >= 12 AND role IN ('human', 'agent'))"""


@query(f"WITH {_ECHO} SELECT h.id, count(DISTINCT h.g) AS runs FROM g h JOIN g s USING (session, g) WHERE h.role = 'human' AND s.role = 'agent' AND s.a <= h.a AND s.a > h.a - 40 GROUP BY h.id")
def echo_last_turns(spark, d):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("session").orderBy("seq"))
    heard = F.when((F.col("role") == "human") & (F.col("id") % 3 == 0), F.concat(F.coalesce(F.substring(before, 40, 200), F.lit("")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return episodes.echoes(t.episodes(spark, d).withColumn("text", heard))


def _transcripts(spark, d) -> DataFrame:
    """JSON lines of the conversations: some malformed, some meta, some in blocks beside a tool's result."""
    c, n = F.col("conv_id"), F.col("turn")
    quoted = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("t"))), r'^\{"t":|\}$', "")
    text = quoted(F.coalesce("text", F.lit("")))
    block = F.concat(F.lit('[{"type":"tool_result","text":"no"},{"type":"text","text":'), text, F.lit("}]"))
    content = F.when(n % 3 == 1, block).when((n == 2) & (c % 4 == 0), F.lit('"<tag>"')).when((n == 2) & (c % 4 == 1), F.lit('"[a short note]"')).otherwise(text)
    meta = F.when((n == 4) | (c % 11 == 3), "true").otherwise("false")
    parts = ['{"type":"x","timestamp":"2024-01-01T00:00:00Z","sessionId":"c', c, '","uuid":"', c * 100 + n, '","parentUuid":"', c * 100 + n - 1, '","isMeta":', meta, ',"message":{"role":"', F.col("role"), '","content":', content, "}}"]
    line = F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    return t.table(spark, d, "conversations").select(F.lit("a.jsonl").alias("path"), (c * 100 + n).alias("line"), F.when((c % 10 == 9) & (n == 1), "{bad").otherwise(line).alias("value"))


_SAID = """said AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'agent' END AS role, trim(coalesce(text, ''), ' ') AS text FROM conversations WHERE NOT (conv_id % 10 = 9 AND turn = 1)),
heard AS (SELECT *, conv_id * 100 + turn AS uuid FROM said WHERE role IS NOT NULL AND text <> '' AND turn <> 4 AND conv_id % 11 <> 3 AND NOT (turn = 2 AND conv_id % 4 IN (0, 1)))"""


@query(f"WITH {_SAID} SELECT 'c' || conv_id AS session, seq, role, length(text) AS n FROM heard")
def transcript_ingest(spark, d):
    return episodes.transcript(_transcripts(spark, d)).select("session", "seq", "role", F.length("text").alias("n"))


@query(f"WITH {_SAID} SELECT 'c' || h.conv_id AS session, h.seq, p.seq AS answers FROM heard h LEFT JOIN heard p ON p.uuid = h.uuid - 1")
def transcript_threads(spark, d):
    return episodes.threaded(episodes.transcript(_transcripts(spark, d))).select("session", "seq", "answers")


_BM25 = r"""k AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM noted WHERE trim(text, ' ') <> ''),
a AS (SELECT count(*) AS n, avg(len(ws)) AS average FROM k),
f AS (SELECT doc_id, line, len(ws) AS len, term, len(list_filter(ws, lambda x: x = term)) AS tf, contains(' ' || array_to_string(ws, ' ') || ' ', ' small parts ') AS phrase FROM k, (VALUES ('small'), ('parts')) v(term) WHERE list_contains(ws, term)),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, a GROUP BY term, n),
bm AS (SELECT doc_id, line, phrase, round(round(sum(idf * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * len / average))), 4) * CASE WHEN phrase THEN 2 ELSE 1 END, 4) AS score FROM f JOIN i USING (term), a GROUP BY doc_id, line, phrase)"""


@query(f"WITH {_BM25} SELECT doc_id, line, score, phrase FROM bm ORDER BY score DESC, doc_id, line LIMIT 10")
def prose_phrase_boost(spark, d):
    return prose.phrase_boosted(prose.lines(t.notes(spark, d)), "small parts").select("doc_id", "line", "score", "phrase")


@query(f"WITH {_BM25}, top AS (SELECT * FROM bm ORDER BY score DESC, doc_id, line LIMIT 10) SELECT top.doc_id, top.line, string_agg(n.text, chr(10) ORDER BY n.line) AS snippet FROM top JOIN noted n ON n.doc_id = top.doc_id AND abs(n.line - top.line) <= 2 GROUP BY ALL")
def prose_snippets(spark, d):
    rows = prose.lines(t.notes(spark, d))
    return prose.with_context(prose.phrase_boosted(rows, "small parts"), rows).select("doc_id", "line", "snippet")


@query(f"WITH {_BM25} SELECT doc_id, line, score FROM bm ORDER BY score DESC, doc_id, line LIMIT 10")
def prose_fallback(spark, d):
    nothing = spark.createDataFrame([], "id long")
    return prose.fallback(nothing, prose.lines(t.notes(spark, d)), "small parts").select("doc_id", "line", "score")


@query("SELECT p_partkey AS doc_id, array_to_string(list_concat([lower(n), lower(a), lower(b)], ['x2']), ' ') AS tokens FROM (SELECT p_partkey, split_part(p_name, ' ', 1) || '_' || upper(split_part(p_name, ' ', 2)) AS n, split_part(p_name, ' ', 1) AS a, upper(split_part(p_name, ' ', 2)) AS b FROM part)")
def prose_name_tokens(spark, d):
    a, b = F.split("p_name", " ")[0], F.upper(F.split("p_name", " ")[1])
    text = F.concat(a, F.lit("_"), b, F.lit(" ... x2"))
    # x2 is one token and, as a name of parts, x and 2; parts equal to the whole are left out
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.array_join(F.array_except(prose.name_tokens("text"), F.array(F.lit("x"), F.lit("2"))), " ").alias("tokens"))


_STATED = """stated AS (SELECT n.*, '# ' || p_brand || CASE WHEN p_partkey % 9 = 4 THEN ' UNMEASURED_x, do not quote' ELSE '' END AS h FROM noted n JOIN part ON p_partkey = doc_id WHERE NOT starts_with(text, '#') AND NOT starts_with(text, '>') AND NOT starts_with(text, '```') AND NOT starts_with(text, 'size: 4'))"""


@query(f"WITH {_STATED} SELECT doc_id, line, text, substr(h, 3) AS heading FROM stated")
def prose_statements(spark, d):
    return prose.statements(prose.lines(t.notes(spark, d)))


_FACTS = f"""{_STATED}, quotable AS (SELECT * FROM stated WHERE doc_id % 9 <> 4), facts AS (SELECT doc_id, line, 'key_value' AS family, split_part(text, ': ', 1) AS subject, regexp_extract(text, ': ([0-9]+)', 1) AS object, 'mm' AS unit, 0.7 AS self_confidence FROM quotable WHERE regexp_matches(text, '^[a-z_]+: [0-9]+ mm$')
UNION ALL SELECT doc_id, line, 'measured', replace(regexp_extract(lower(text), '^the (.*) is now', 1), ' ', '_'), regexp_extract(text, 'now ([0-9]+)', 1), 'kg', 0.6 FROM quotable WHERE starts_with(text, 'The ')
UNION ALL SELECT doc_id, line, 'defined', split_part(text, ' ', 1), regexp_extract(text, ' is a (.*)[.]$', 1), '', 0.35 FROM quotable WHERE starts_with(text, 'widget_'))"""
_FACT = ["doc_id", "line", "family", "subject", "object", "unit"]


def _facts(spark, d) -> DataFrame:
    return prose.facts(prose.statements(prose.lines(t.notes(spark, d))))


@query(f"WITH {_FACTS} SELECT {', '.join(_FACT)} FROM facts")
def proposals_facts(spark, d):
    return _facts(spark, d).select(*_FACT)


@query(f"WITH {_FACTS}, k AS (SELECT DISTINCT subject, family FROM facts WHERE doc_id % 9 = 0) SELECT f.subject, f.family, min(doc_id) AS doc_id, count(*) AS n FROM facts f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.subject = f.subject AND k.family = f.family) GROUP BY ALL")
def proposals_new(spark, d):
    rows = _facts(spark, d).checkpoint()
    return prose.new_proposals(rows, rows.where("doc_id % 9 = 0"), ["subject", "family"]).select("subject", "family", "doc_id", "n")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'accepted' WHEN p_partkey % 4 = 1 AND p_partkey % 3 <> 0 THEN 'rejected' WHEN p_partkey % 4 = 1 THEN 'accepted' ELSE 'pending' END AS status FROM part""")
def proposals_reviewed(spark, d):
    i = F.col("id")
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    one = rows.where(i % 4 < 3).select("id", F.when(i % 4 == 0, "accepted").otherwise("rejected").alias("verdict"), F.when(i % 4 != 2, "ada").alias("reviewer"), F.when(i % 3 != 0, "no").alias("note"), F.lit(1).alias("at"))
    two = rows.where(i % 4 < 2).select("id", F.lit("accepted").alias("verdict"), F.lit("bob").alias("reviewer"), F.lit("").alias("note"), F.lit(2).alias("at"))
    return prose.reviewed(rows, one.unionByName(two)).select("id", "status")


@query("""WITH r AS (SELECT p_brand AS subject, p_type AS predicate, p_size AS object, p_partkey % 3 = 0 AS binding, CASE WHEN p_partkey % 7 = 0 THEN 'nowhere' ELSE 'f' || (p_partkey % 9) || ':' || p_partkey END AS locator FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY binding DESC, locator) AS rn FROM r WHERE locator <> 'nowhere')
SELECT g.subject, g.predicate, object, binding, locator, coalesce((SELECT string_agg(x.locator, ',' ORDER BY x.locator) FROM g x WHERE x.subject = g.subject AND x.predicate = g.predicate AND x.rn > 1), '') AS also_at FROM g WHERE rn = 1""")
def rules_dedupe(spark, d):
    i = F.col("p_partkey")
    locator = F.when(i % 7 == 0, "nowhere").otherwise(F.concat(F.lit("f"), (i % 9).cast("string"), F.lit(":"), i.cast("string")))
    rows = t.table(spark, d, "part").select(F.col("p_brand").alias("subject"), F.col("p_type").alias("predicate"), F.col("p_size").alias("object"), (i % 3 == 0).alias("binding"), locator.alias("locator"))
    return prose.merged_rules(rows)


@query("""WITH r AS (SELECT p_partkey AS id, p_name AS subject, 'size' AS predicate, p_size % 2 AS object, CASE WHEN p_partkey % 7 = 0 THEN 'nowhere' ELSE 'f' || p_partkey || ':1' END AS locator, p_partkey % 5 <> 0 AS timed FROM part),
c AS (SELECT subject FROM r GROUP BY subject HAVING count(DISTINCT object) > 1)
SELECT id, CASE WHEN NOT timed THEN 'no_commit_time' WHEN locator = 'nowhere' THEN 'no_line' WHEN subject IN (SELECT subject FROM c) THEN 'conflicting_value' WHEN row_number() OVER (PARTITION BY subject, object ORDER BY locator) > 1 THEN 'duplicate' ELSE 'accepted' END AS verdict FROM r""")
def facts_ingested(spark, d):
    i = F.col("p_partkey")
    rows = t.table(spark, d, "part").select(i.alias("id"), F.col("p_name").alias("subject"), F.lit("size").alias("predicate"), (F.col("p_size") % 2).alias("object"), F.when(i % 7 == 0, "nowhere").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(":1"))).alias("locator"), F.when(i % 5 != 0, i).alias("committed_at"))
    return prose.ingestable(rows).select("id", "verdict")


_RECORD = "id long, scope string, subject string, predicate string, value double, kind string, confidence string, source string, human string, valid_from timestamp_ntz, valid_to timestamp_ntz, supersedes long"


def _store(spark) -> writes.Store:
    return writes.Store(spark, f"{jobs.shared_dir(spark)}/records-{uuid.uuid4().hex}", _RECORD)


@query("""WITH r AS (SELECT p_partkey AS id, p_name AS subject, p_size % 2 AS object, CASE WHEN p_partkey % 7 = 0 THEN 'nowhere' ELSE 'f' || p_partkey || ':1' END AS locator, p_partkey % 5 <> 0 AS timed FROM part),
c AS (SELECT subject FROM r GROUP BY subject HAVING count(DISTINCT object) > 1), v AS (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY locator) AS rn FROM r)
SELECT id + 1000 AS id, subject, CAST(object AS DOUBLE) AS value, locator AS source, 'unverified' AS confidence, id + 1000 AS chain FROM v WHERE timed AND locator <> 'nowhere' AND subject NOT IN (SELECT subject FROM c) AND rn = 1""")
def facts_recorded(spark, d):
    """What the ledger holds after the accepted facts were appended, twice."""
    i, store = F.col("p_partkey"), _store(spark)
    rows = t.table(spark, d, "part").select(i.alias("id"), F.col("p_name").alias("subject"), F.lit("size").alias("predicate"), (F.col("p_size") % 2).alias("object"), F.when(i % 7 == 0, "nowhere").otherwise(F.concat(F.lit("f"), i.cast("string"), F.lit(":1"))).alias("locator"), F.when(i % 5 != 0, i).alias("committed_at"))
    new = records.facts(prose.ingestable(rows), "org/acme", 1000)
    store.append(new, "facts")
    store.append(new, "facts")
    return store.assertions().select("id", "subject", "value", "source", "confidence", "chain")


@query("""WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN 'accepted' WHEN p_partkey % 4 = 2 THEN 'rejected' ELSE 'pending' END AS status, p_partkey % 6 <> 1 AS named, p_partkey % 10 <> 8 AS sourced FROM part)
SELECT id, status, CASE WHEN status = 'accepted' AND sourced AND named THEN id + 5000 END AS promoted_to, CASE WHEN status = 'accepted' AND NOT sourced THEN 'evidence_required' WHEN status = 'accepted' AND NOT named THEN 'human_evidence_names_a_human' END AS refused FROM r""")
def proposals_promoted(spark, d):
    i = F.col("p_partkey")
    rows = t.table(spark, d, "part").select(i.alias("id"), F.when(i % 4 < 2, "accepted").when(i % 4 == 2, "rejected").otherwise("pending").alias("status"), F.when(i % 6 != 1, "ada").alias("reviewed_by"), F.concat(F.lit("part:"), i.cast("string")).alias("subject"), F.lit("size").alias("predicate"), F.col("p_size").cast("double").alias("value"), F.when(i % 10 != 8, F.concat(F.lit("notes:"), i.cast("string"))).alias("source"))
    return records.promote(_store(spark), rows, "org/acme", "reviewed", 5000).select("id", "status", "promoted_to", "refused")


@query("""SELECT doc_id, line, CASE WHEN doc_id % 4 = 0 THEN 'LIMIT' ELSE 'width' END AS name, CASE WHEN doc_id % 4 = 0 THEN '=' ELSE 'divisible_by' END AS relation, CASE WHEN doc_id % 4 = 0 THEN 1000 + CAST(right(regexp_replace(text, '[^0-9]', '', 'g'), 3) AS BIGINT) ELSE CAST(regexp_extract(text, '% ([0-9]+)', 1) AS BIGINT) END AS value
FROM noted WHERE starts_with(text, 'const') OR starts_with(text, 'static_assert')""")
def pinned_consts(spark, d):
    return prose.pinned(prose.lines(t.notes(spark, d)))


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'right' ELSE 'wrong' END WHEN p_partkey % 5 = 0 THEN 'abstained' WHEN starts_with(p_name, 'red') THEN 'wrong' WHEN p_size > 20 THEN 'right' ELSE 'missed' END AS verdict FROM part""")
def grader_verdicts(spark, d):
    i = F.col("p_partkey")
    said = F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("It is 1,"), F.when(F.col("p_size") > 20, "200").otherwise("300"), F.lit(" - "), F.col("p_name")))
    rows = t.table(spark, d, "part").select(i.alias("id"), said.alias("answer"), F.array(F.lit("1200")).alias("expect"), F.array(F.lit("RED")).alias("forbid"), (i % 6 == 0).alias("abstain"))
    return prose.graded(rows).select("id", "verdict")


@query("SELECT p_type AS kind, count(*) AS n, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS deviation FROM part GROUP BY p_type")
def bench_strata(spark, d):
    return t.table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean"), F.stddev_samp("p_retailprice").alias("deviation"))


_JUDGED = """WITH f AS (SELECT DISTINCT l_orderkey % 40 AS question, l_partkey AS item FROM lineitem WHERE l_linenumber < 4), e AS (SELECT DISTINCT l_orderkey % 40 AS question, l_partkey AS item FROM lineitem WHERE l_linenumber > 2),
c AS (SELECT coalesce(f.question, e.question) AS question, count(*) FILTER (f.item IS NOT NULL AND e.item IS NOT NULL) AS tp, count(*) FILTER (e.item IS NULL) AS fp, count(*) FILTER (f.item IS NULL) AS fn FROM f FULL JOIN e ON f.question = e.question AND f.item = e.item GROUP BY 1)"""
_RATIOS = """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c"""


@query(f"{_JUDGED} {_RATIOS}")
def impact_agreement(spark, d):
    rows = t.table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("question"), F.col("l_partkey").alias("item"), "l_linenumber")
    return prose.agreement(rows.where("l_linenumber < 4").drop("l_linenumber"), rows.where("l_linenumber > 2").drop("l_linenumber"))


@query(f"{_JUDGED}, j AS ({_RATIOS}) SELECT question % 3 AS stratum, grouping(question % 3) = 1 AS overall, count(*) AS n, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, coalesce(sum(tp) / nullif(sum(tp + fp), 0), 0) AS micro_precision, coalesce(sum(tp) / nullif(sum(tp + fn), 0), 0) AS micro_recall, coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0) AS micro_f1 FROM j GROUP BY GROUPING SETS ((question % 3), ())")
def impact_scores(spark, d):
    return prose.scores(impact_agreement(spark, d).withColumn("stratum", F.col("question") % 3), "stratum")


_HELD = f"""{_PREFS}, held AS (SELECT scope || '|' || signature AS id, scope, signature, CASE WHEN occasions % 7 = 1 THEN 'personal' ELSE tier END AS tier, CASE WHEN occasions % 4 = 0 THEN occasions ELSE occasions - 1 END AS occasions, humans,
 CASE WHEN occasions % 5 = 0 THEN 'rejected' ELSE 'active' END AS status, tier = 'org' AS binding, last_seen FROM prefs WHERE occasions % 3 <> 0)"""


@query(f"""WITH {_HELD}, r AS (SELECT 'org' AS t, 3 AS n UNION ALL SELECT 'team', 2 UNION ALL SELECT 'personal', 1),
j AS (SELECT p.*, h.id AS hid, h.tier AS ht, h.occasions AS ho, h.humans AS hh, h.status AS hs, a.n AS pn, b.n AS hn FROM prefs p LEFT JOIN held h ON h.scope = p.scope AND h.signature = p.signature JOIN r a ON a.t = p.tier LEFT JOIN r b ON b.t = h.tier),
k AS (SELECT *, CASE WHEN hs = 'rejected' THEN 'skip_rejected' WHEN ht = tier AND ho = occasions AND hh = humans THEN 'skip_unchanged' WHEN pn < hn THEN 'skip_lower_tier' WHEN hid IS NOT NULL THEN 'supersede' ELSE 'create' END AS action FROM j)
SELECT scope, signature, tier, occasions, humans, action, CASE WHEN action = 'supersede' THEN hid END AS supersedes, tier = 'org' AS binding FROM k""")
def preference_promotions(spark, d):
    found = people.preference_candidates(t.feedback(spark, d))
    return people.promotions(found, t.preferences(spark, d, found))


@query(f"WITH {_HELD} SELECT signature, id, scope, tier, binding, last_seen, ord - 1 AS distance FROM held JOIN chain USING (scope) WHERE status = 'active' QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ord, id) = 1")
def preference_active(spark, d):
    return people.active(t.preferences(spark, d, people.preference_candidates(t.feedback(spark, d))), CHAIN)


@query(f"WITH {_HELD} SELECT id, CASE WHEN humans = 1 AND occasions % 2 = 0 THEN 'rejected' WHEN humans = 1 THEN 'active' ELSE status END AS status FROM held")
def preference_rejected(spark, d):
    rows = t.preferences(spark, d, people.preference_candidates(t.feedback(spark, d)))
    one = rows.where("humans = 1").select(F.col("id").alias("preference_id"), F.lit("rejected").alias("status"), F.lit(1).alias("decided_at"))
    two = rows.where("humans = 1 AND occasions % 2 <> 0").select(F.col("id").alias("preference_id"), F.lit("active").alias("status"), F.lit(2).alias("decided_at"))
    return people.rejected(rows, one.unionByName(two)).select("id", "status")


@query(f"WITH {_HELD} SELECT h.id, l.confidence AS assertion_confidence, l.kind AS assertion_kind FROM held h LEFT JOIN ledger l ON l.id = h.occasions * 3")
def preference_citations(spark, d):
    rows = t.preferences(spark, d, people.preference_candidates(t.feedback(spark, d))).withColumn("assertion_id", F.col("occasions") * 3)
    return people.cited(rows, t.ledger(spark, d)).select("id", "assertion_confidence", "assertion_kind")


@query("SELECT signature, count(*) AS events, count(DISTINCT actor) AS humans, count(DISTINCT occasion) AS days FROM feedback GROUP BY signature")
def feedback_counts(spark, d):
    return people.feedback_counts(t.feedback(spark, d), ["signature"])


@query("""WITH e AS (SELECT CASE WHEN event_id % 31 = 0 THEN 'retire' WHEN event_id % 3 = 0 THEN 'announce' ELSE 'beat' END AS event, 'worker' AS kind, ['org/acme', 'org/acme/proj/a', 'org/acme/proj/b'][1 + user_id % 3] AS scope, 'w' || user_id AS label, ts AS at_ FROM events)
SELECT kind, scope, label, max(at_) FILTER (event = 'announce') AS announced_at, max(at_) FILTER (event <> 'retire') AS heartbeat_at, coalesce(max(at_) FILTER (event = 'retire') >= max(at_) FILTER (event = 'announce') OR (max(at_) FILTER (event = 'announce') IS NULL AND max(at_) FILTER (event = 'retire') IS NOT NULL), false) AS retired
FROM e GROUP BY ALL HAVING count(*) FILTER (event <> 'retire') > 0""")
def fleet_registered(spark, d):
    i = F.col("event_id")
    log = t.table(spark, d, "events").select(F.when(i % 31 == 0, "retire").when(i % 3 == 0, "announce").otherwise("beat").alias("event"), F.lit("worker").alias("kind"), F.element_at(F.array(*map(F.lit, t.SCOPES)), (F.col("user_id") % 3 + 1).cast("int")).alias("scope"), F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("label"), F.col("ts").alias("at"))
    return people.registered(log)


@query("""WITH e AS (SELECT user_id % 50 AS node_id, event_type AS path, CASE WHEN event_id % 40 = 7 THEN 'retire' WHEN event_id % 4 = 1 THEN 'release' ELSE 'claim' END AS event, ts AS t FROM events),
g AS (SELECT node_id, max(t) AS gone FROM e WHERE event = 'retire' GROUP BY 1), f AS (SELECT node_id, path, max(t) AS freed FROM e WHERE event = 'release' GROUP BY 1, 2)
SELECT node_id, path, min(t) AS claimed_at FROM e LEFT JOIN g USING (node_id) LEFT JOIN f USING (node_id, path) WHERE event = 'claim' AND (gone IS NULL OR t > gone) AND (freed IS NULL OR t > freed) GROUP BY 1, 2""")
def fleet_held(spark, d):
    i = F.col("event_id")
    event = F.when(i % 40 == 7, "retire").when(i % 4 == 1, "release").otherwise("claim")
    log = t.table(spark, d, "events").select((F.col("user_id") % 50).alias("node_id"), F.when(event != "retire", F.col("event_type")).alias("path"), event.alias("event"), F.col("ts").alias("at"))
    return people.held_paths(log)


_CHECKED = """c AS (SELECT id, CASE WHEN id % 4 < 3 THEN id % 90 END AS sha FROM live WHERE confidence = 'unverified'),
v AS (SELECT id, CASE WHEN sha IS NULL OR sha >= 60 THEN 'unresolvable' WHEN sha % 2 = 0 THEN 'confirmed' ELSE 'refuted' END AS outcome, CASE WHEN sha IS NULL THEN 'no_commit_in_evidence' WHEN sha >= 60 THEN 'commit_unknown' END AS reason FROM c)"""


def _verdicts(spark, d) -> DataFrame:
    i = F.col("id")
    rows = t.ledger(spark, d).where("superseded_by IS NULL AND confidence = 'unverified'").select("id", F.when(i % 4 < 3, (i % 90).cast("string")).alias("commit_sha"))
    commits = spark.range(60).select(i.cast("string").alias("commit_sha"), (i % 2 == 0).alias("is_ancestor"))
    return people.verified(rows, commits)


@query(f"WITH {_CHECKED} SELECT * FROM v")
def verification_outcomes(spark, d):
    return _verdicts(spark, d)


@query(f"WITH {_CHECKED}, l AS (SELECT target, outcome FROM verifications QUALIFY row_number() OVER (PARTITION BY target ORDER BY checked_at DESC, id DESC) = 1) SELECT v.* FROM v LEFT JOIN l ON l.target = v.id WHERE v.outcome IS DISTINCT FROM l.outcome")
def verification_changes(spark, d):
    return people.changed(_verdicts(spark, d), t.verifications(spark, d))


_BUDGET = 100_000


@query(f"""WITH f AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size, row_number() OVER (ORDER BY 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS rn FROM documents),
w AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS doc_id, false AS taken, CAST({_BUDGET} AS BIGINT) AS left_ UNION ALL SELECT f.rn, f.doc_id, left_ > 0 AND size <= left_, CASE WHEN left_ > 0 AND size <= left_ THEN left_ - size ELSE left_ END FROM w JOIN f ON f.rn = w.rn + 1)
SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path FROM w WHERE taken""")
def prose_budget(spark, d):
    """Documents as files, chosen within a budget of bytes as a walk would."""
    files = t.table(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    return prose_files.chosen(files, _BUDGET, 50).select("path")


def _handbook(spark, d) -> DataFrame:
    """doc_id, line and text of handbooks on parts: rules under headings, wrapped, listed, retracted, told of the past, in code and in tables."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    k = (i % 40).cast("string")
    text = [
        F.when(i % 3 == 0, "# Rules that must hold").when(i % 3 == 1, "# Notes").otherwise("# Old ways (SUPERSEDED)"), F.lit(""), F.concat(F.lit("Never ship `tool_"), k, F.lit("` with `mode_"), size, F.lit("`. This has never been")), F.lit("tested with `x_gate`. All builds must set LIMIT_"), F.concat(F.lit("SIZE="), size, F.lit(" for part "), k, F.lit(".")),
        F.concat(F.lit("- The `opt_"), k, F.lit("` switch is banned, unlike `alt_"), k, F.lit("`.")), F.concat(F.lit("- Always pass --flag-"), k, F.lit(" so that it works.")), F.lit("| never | `cell` |"), F.lit("```"), F.lit("never `code`"), F.lit("```"), F.lit("You must be careful here."),
    ]
    return prose.lines(t.table(spark, d, "part").select(i.alias("doc_id"), F.concat_ws("\n", *text).alias("text")))


@query(r"""WITH k AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS k, p_partkey AS i, CAST(p_size AS VARCHAR) AS size, p_partkey % 3 = 0 AS ruled FROM part WHERE p_partkey % 3 <> 2),
s AS (SELECT i AS doc_id, 3 AS line, 'Never ship `tool_' || k || '` with `mode_' || size || '`.' AS statement, 'absolute' AS strength, 'tool_' || k AS target, 4 AS own, ruled FROM k
UNION ALL SELECT i, 6, '- The `opt_' || k || '` switch is banned, unlike `alt_' || k || '`.', 'absolute', 'alt_' || k, 4, ruled FROM k
UNION ALL SELECT i, 7, '- Always pass --flag-' || k || ' so that it works.', 'obligation', 'flag-' || k, 2, ruled FROM k
UNION ALL SELECT i, 4, 'All builds must set LIMIT_ SIZE=' || size || ' for part ' || k || '.', 'obligation', 'size=' || size, 4, ruled FROM k),
r AS (SELECT *, own + CASE WHEN ruled THEN 4 ELSE 0 END AS doctrinal, count(*) OVER (PARTITION BY statement) - 1 AS also_at, row_number() OVER (PARTITION BY statement ORDER BY doc_id, line) AS rn FROM s)
SELECT doc_id, line, statement, strength, target, doctrinal, also_at, starts_with(target, 'tool_') AND coalesce(TRY_CAST(substr(target, 6) AS INT) % 4 = 0, false) AS enforced FROM r WHERE rn = 1""")
def doctrine_scan(spark, d):
    rules = t.table(spark, d, "part").where("p_partkey % 4 = 0").select(F.concat(F.lit("deny(tool_"), (F.col("p_partkey") % 40).cast("string"), F.lit(")")).alias("text"), F.lit(True).alias("binding"))
    said = doctrine.sentences(doctrine.blocks(_handbook(spark, d))).withColumn("path", F.lit("docs/a.md"))
    return doctrine.scan(said, doctrine.corpus(rules)).select("doc_id", "line", "statement", "strength", "target", "doctrinal", "also_at", "enforced")

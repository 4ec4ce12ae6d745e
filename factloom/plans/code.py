"""Registered queries on the code graph: loading, resolution, impact and retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import graphs
from ..sources import tables as t
from ..streaming import jobs
from .catalogue import query

_RANK = "CASE confidence WHEN 'measured' THEN 0 WHEN 'derived' THEN 1 ELSE 2 END"
_NAMES = "['measured', 'derived', 'unverified']"
_TRAIT = f"""et AS (SELECT tr.id FROM code me JOIN code tr ON tr.kind = 'trait' AND tr.path = me.path AND me.line_start BETWEEN tr.line_start AND tr.line_end WHERE me.id = 2 ORDER BY tr.line_end - tr.line_start LIMIT 1),
methods AS (SELECT m.id, 1 AS depth, min({_RANK.replace("confidence", "e.confidence")}) AS rank, 'implements' AS via FROM et JOIN cedges e ON e.kind = 'implements' AND e.dst = et.id JOIN code ty ON ty.id = e.src JOIN code me ON me.id = 2
 JOIN code m ON m.name = me.name AND m.kind IN ('method', 'function') AND (m.fqn = ty.fqn || '::' || me.name OR (ty.fqn IS NULL AND m.path = ty.path AND m.line_start BETWEEN ty.line_start AND ty.line_end)) GROUP BY m.id)"""


def _closure(target: int, depth: int) -> str:
    """CTEs that end in reached(id, depth, rank, via)."""
    return f"""up AS (SELECT src AS id, 1 AS depth, {_RANK} AS rank, kind AS via FROM cedges WHERE dst = {target}
 UNION SELECT e.src, u.depth + 1, greatest(u.rank, {_RANK.replace("confidence", "e.confidence")}), e.kind FROM cedges e JOIN up u ON e.dst = u.id WHERE u.depth < {depth}),
reached AS (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, rank, via) = 1)"""


_REPORT = f"""{_closure(2, 2)}, {_TRAIT}, hops AS (SELECT * FROM (SELECT * FROM reached UNION ALL SELECT * FROM methods) QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, rank, via) = 1),
report AS (SELECT h.id, depth, {_NAMES}[1 + rank] AS confidence, via, name, fqn, path, rank < 2 AS certain, c.kind = 'test' AS is_test FROM hops h JOIN code c USING (id))"""


def _report(spark, d) -> DataFrame:
    return graph.report(t.code_edges(spark, d), t.code(spark, d), 2, 2)


@query(f"WITH {_REPORT} SELECT * FROM report")
def impact_report(spark: SparkSession, d: str) -> DataFrame:
    return graph.presented(_report(spark, d))


@query(f"WITH {_REPORT} SELECT id, depth, confidence, name FROM report WHERE is_test")
def impact_tests(spark, d):
    return _report(spark, d).where("is_test").select("id", "depth", "confidence", "name")


@query(f"WITH {_REPORT} SELECT confidence, count(*) AS n, count(*) FILTER (certain) AS certain FROM report GROUP BY confidence")
def impact_counts(spark, d):
    return _report(spark, d).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if("certain").alias("certain"))


@query(f"WITH {_TRAIT} SELECT id, depth, {_NAMES}[1 + rank] AS confidence, via FROM methods")
def impact_trait_methods(spark, d):
    return graph.trait_methods(t.code_edges(spark, d), t.code(spark, d), 2)


@query(f"WITH {_closure(7, 3)}, own AS (SELECT src AS id, min({_RANK}) AS own FROM cedges GROUP BY src) SELECT id, depth, {_NAMES}[1 + rank] AS confidence FROM reached JOIN own USING (id) WHERE rank > own")
def impact_weakest_link(spark, d):
    return graph.weakest(t.code_edges(spark, d), 7, 3)


@query("SELECT min(id) AS id, fqn FROM code WHERE fqn = (SELECT min(fqn) FROM (SELECT fqn FROM code WHERE fqn IS NOT NULL GROUP BY fqn HAVING count(*) = 1)) GROUP BY fqn")
def target_resolve(spark, d):
    s = t.code(spark, d)
    fqn = s.where("fqn IS NOT NULL").groupBy("fqn").count().where("count = 1").agg(F.min("fqn")).first()[0]
    return s.where(F.col("id") == graph.target_of(s, fqn)).select("id", "fqn")


_INDEX = "ix AS (SELECT o_orderkey AS index_id, 'r' || (o_custkey % 20) AS repo, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS commit_sha, o_orderdate AS indexed_at, o_orderstatus = 'F' AS completed FROM orders)"


def _indexes(spark, d) -> DataFrame:
    return t.table(spark, d, "orders").select(F.col("o_orderkey").alias("index_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 20).cast("string")).alias("repo"), F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 12).alias("commit_sha"), F.col("o_orderdate").alias("indexed_at"), (F.col("o_orderstatus") == "F").alias("completed"))


@query(f"WITH {_INDEX} SELECT index_id, commit_sha FROM ix WHERE repo = 'r3' AND completed AND starts_with(commit_sha, 'a') ORDER BY indexed_at DESC, index_id DESC LIMIT 1")
def index_resolve(spark, d):
    return graph.index_of(_indexes(spark, d), "r3", "a").select("index_id", "commit_sha")


@query(f"WITH {_INDEX} SELECT commit_sha, CASE WHEN count(DISTINCT repo) = 1 THEN min(repo) END AS repo, count(DISTINCT repo) AS repos FROM (SELECT substr(commit_sha, 1, 3) AS commit_sha, repo FROM ix WHERE completed) GROUP BY 1")
def only_repo(spark, d):
    return graph.only_repo(_indexes(spark, d).withColumn("commit_sha", F.substring("commit_sha", 1, 3)), "commit_sha")


_RAW = """raw AS (SELECT l_orderkey AS o, l_linenumber AS n, 's' || l_partkey AS src, CASE WHEN l_linenumber % 3 = 0 THEN ['s' || (l_partkey + 1), 's' || (l_partkey + 2)] ELSE ['s' || (l_partkey + l_linenumber * 7)] END AS ds,
 CASE WHEN l_linenumber % 3 = 0 THEN 'ambiguous-name' WHEN l_linenumber % 3 = 1 THEN 'unique-name' ELSE 'compiler' END AS resolution FROM lineitem),
fan AS (SELECT o, n, resolution, r.src, u.dst, a.p_partkey AS src_id, b.p_partkey AS dst_id FROM raw r, unnest(ds) u(dst) LEFT JOIN part a ON 's' || a.p_partkey = r.src LEFT JOIN part b ON 's' || b.p_partkey = u.dst)"""


def _fanned(spark, d) -> DataFrame:
    key = lambda c: F.concat(F.lit("s"), c.cast("string"))
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.when(n % 3 == 0, "ambiguous-name").when(n % 3 == 1, "unique-name").otherwise("compiler")
    raw = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), n.alias("n"), key(p).alias("src"), F.when(n % 3 != 0, key(p + n * 7)).alias("dst"), F.when(n % 3 == 0, F.array(key(p + 1), key(p + 2))).alias("candidates"), kind.alias("resolution"))
    return graph.fan_out(raw, t.code(spark, d).select(key(F.col("id")).alias("key"), "id"))


@query(f"WITH {_RAW} SELECT o, n, src_id, dst_id, CASE resolution WHEN 'compiler' THEN 'measured' WHEN 'unique-name' THEN 'derived' ELSE 'unverified' END AS confidence FROM fan WHERE src_id IS NOT NULL AND dst_id IS NOT NULL")
def edges_fanned_out(spark, d):
    return _fanned(spark, d).where("src_id IS NOT NULL AND dst_id IS NOT NULL").select("o", "n", "src_id", "dst_id", "confidence")


@query(f"WITH {_RAW} SELECT dst AS key, count(*) AS n FROM fan WHERE dst_id IS NULL GROUP BY dst")
def edges_unknown_keys(spark, d):
    return graph.unknown(_fanned(spark, d))


@query("SELECT kind || '.' || name AS key, id, CASE WHEN rn = 1 THEN kind || '.' || name ELSE kind || '.' || name || '~' || rn END AS unique_key FROM (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY path, line_start, id) AS rn FROM code)")
def symbol_keys(spark, d):
    rows = t.code(spark, d).withColumn("key", F.concat_ws(".", "kind", "name"))
    return graph.unique_keys(rows, "key", ["path", "line_start", "id"]).select("key", "id", "unique_key")


@query("SELECT id FROM code c WHERE NOT is_declaration OR NOT EXISTS (SELECT 1 FROM code e WHERE NOT e.is_declaration AND e.family = c.family AND e.kind = c.kind AND e.fqn = c.fqn)")
def shadowed_declarations(spark, d):
    return graph.without_shadowed(t.code(spark, d)).select("id")


_SUFFIX = """parts AS (SELECT id, family, string_split(fqn, '::') AS ps FROM code WHERE fqn IS NOT NULL),
names AS (SELECT family, key, suffix, count(*) AS n, min(id) AS dst FROM (SELECT id, family, unnest(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[i:], '::'))) AS key, unnest(list_transform(range(1, len(ps) + 1), lambda i: i > 1)) AS suffix FROM parts) GROUP BY ALL),
asked AS (SELECT p_partkey AS lookup, CASE WHEN p_partkey % 2 = 0 THEN 'python' ELSE 'rust' END AS family, unnest(['T' || (p_partkey // 2), 'm' || (p_size % 9), 'T1::m' || (p_size % 8)]) AS key, unnest([0, 1, 2]) AS place FROM part),
best AS (SELECT lookup, place, n, dst FROM asked JOIN names USING (family, key) QUALIFY row_number() OVER (PARTITION BY lookup ORDER BY place, suffix) = 1)"""


@query(f"WITH {_SUFFIX} SELECT p_partkey AS lookup, place, CASE WHEN n = 1 THEN 'unique-name' WHEN n BETWEEN 2 AND 8 THEN 'ambiguous-name' ELSE 'unresolved' END AS resolution, CASE WHEN n = 1 THEN dst END AS dst, coalesce(n, 0) AS n FROM part LEFT JOIN best ON lookup = p_partkey")
def edges_ceiling(spark, d):
    i, size = F.col("p_partkey"), F.col("p_size")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    asked = t.table(spark, d, "part").select(i.alias("lookup"), F.when(i % 2 == 0, "python").otherwise("rust").alias("family"), F.array(text("T", F.floor(i / 2)), text("m", size % 9), text("T1::m", size % 8)).alias("keys"))
    return graph.resolve_by_suffix(asked, t.code(spark, d).where("fqn IS NOT NULL")).withColumnRenamed("at", "place")


@query("SELECT src, dst, CASE WHEN e.kind = 'calls' AND c.kind = 'type' THEN 'instantiates' ELSE e.kind END AS kind, confidence FROM cedges e LEFT JOIN code c ON c.id = e.dst")
def edges_retagged(spark, d):
    return graph.retagged(t.code_edges(spark, d), t.code(spark, d)).select("src", "dst", "kind", "confidence")


@query("""SELECT 'k' || (l_linenumber % 4) AS kind, count(*) FILTER (l_quantity % 5 = 0) AS compiler, count(*) FILTER (l_quantity % 5 = 1) AS language_server, count(*) FILTER (l_quantity % 5 = 2) AS unique_name, count(*) FILTER (l_quantity % 5 = 3) AS ambiguous_name,
 count(*) FILTER (l_quantity % 5 = 4) AS unresolved FROM lineitem GROUP BY 1""")
def resolution_histogram(spark, d):
    names = F.array(*map(F.lit, ("compiler", "language-server", "unique-name", "ambiguous-name", "unresolved")))
    rows = t.table(spark, d, "lineitem").select(F.concat(F.lit("k"), (F.col("l_linenumber") % 4).cast("string")).alias("kind"), F.element_at(names, (F.col("l_quantity") % 5 + 1).cast("int")).alias("resolution"))
    return graph.resolutions(rows)


@query("""WITH i AS (SELECT p_partkey % 50 AS index_id, count(*) AS symbols FROM part GROUP BY 1), e AS (SELECT l_orderkey % 60 AS index_id, count(*) AS edges FROM lineitem GROUP BY 1)
SELECT x AS index_id, coalesce(symbols, 0) AS symbols, coalesce(edges, 0) AS edges FROM range(70) r(x) LEFT JOIN i ON i.index_id = x LEFT JOIN e ON e.index_id = x WHERE x % 3 = 0""")
def prune_tallies(spark, d):
    indexes = spark.range(70).select(F.col("id").alias("index_id"), (F.col("id") % 3 == 0).alias("doomed"))
    edges = t.table(spark, d, "lineitem").select((F.col("l_orderkey") % 60).alias("index_id"))
    return graph.prune_tallies(indexes, t.code(spark, d), edges)


@query("SELECT DISTINCT p_brand || ' / ' || p_name AS repo, 'org/' || trim(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') AS scope FROM part")
def default_scopes(spark, d):
    rows = t.table(spark, d, "part").select(F.concat("p_brand", F.lit(" / "), "p_name").alias("repo")).distinct()
    return rows.select("repo", graph.default_scope("repo").alias("scope"))


@query("SELECT index_id, repo FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY indexed_at DESC, index_id DESC) AS rn FROM (SELECT o_orderkey AS index_id, 'r' || (o_custkey % 20) AS repo, o_orderdate AS indexed_at FROM orders WHERE o_orderstatus = 'F')) WHERE rn <= 3")
def retention_kept(spark, d):
    newest = Window.partitionBy("repo").orderBy(F.desc("indexed_at"), F.desc("index_id"))
    return _indexes(spark, d).where("completed").withColumn("_n", F.row_number().over(newest)).where("_n <= 3").select("index_id", "repo")


_HEAD = {"version": 1, "repo": "acme/code", "commit_sha": "0123abcd", "indexer": "ix", "languages": ["python", "rust", "c"], "file_count": 20}


def loaded(spark, d) -> graphs.Graphs:
    """A store of three indexes of a repository, of which two are kept; the third has the edges of all of lineitem."""
    store = graphs.Graphs(spark, f"{jobs.shared_dir(spark)}/graphs-{uuid.uuid4().hex}")
    i, n, p = F.col("p_partkey"), F.col("l_linenumber"), F.col("l_partkey")
    key = lambda c: F.concat(F.lit("s"), c.cast("string"))
    symbols = t.table(spark, d, "part").select(key(i).alias("key"), F.when(i % 3 == 0, "type").otherwise("function").alias("kind"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("fqn"), F.when(i % 2 == 0, "python").otherwise("rust").alias("language"), F.concat("p_brand", F.lit(".x")).alias("path"), i.alias("line_start"), (i + 5).alias("line_end"), *(F.lit(None).cast("string").alias(c) for c in ("visibility", "signature", "signature_hash")))
    resolution = F.when(n % 4 == 0, "ambiguous-name").when(n % 4 == 1, "unique-name").when(n % 4 == 2, "compiler").otherwise("unresolved")
    edges = t.table(spark, d, "lineitem").select(key(p).alias("src"), F.when(n % 4 < 3, F.when(n % 4 > 0, key(p))).alias("dst"), F.lit("f").alias("dst_name"), F.when(n % 2 == 0, "calls").otherwise("uses_type").alias("kind"), resolution.alias("resolution"), F.when(n % 4 == 0, F.array(key(p), key(p))).alias("candidates"), F.lit("a.x").alias("path"), F.col("l_orderkey").alias("line"))
    for k, sha in enumerate(("aaaaaaa", "bbbbbbb", "ccccccc")):
        store.load_parts(_HEAD | {"commit_sha": sha}, symbols, edges if k == 2 else edges.limit(0), "org/acme", keep=2)
    return store


@query("""WITH r AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'calls' ELSE 'uses_type' END AS kind, ['ambiguous-name', 'unique-name', 'compiler', 'unresolved'][1 + l_linenumber % 4] AS resolution FROM lineitem)
SELECT kind, resolution, CASE resolution WHEN 'compiler' THEN 'measured' WHEN 'unique-name' THEN 'derived' ELSE 'unverified' END AS confidence, CAST(sum(CASE WHEN resolution = 'ambiguous-name' THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(count(*) FILTER (resolution = 'unresolved') AS BIGINT) AS without_target FROM r GROUP BY ALL""")
def graph_loaded(spark, d):
    store = loaded(spark, d)
    return store.edges(store.latest("acme/code")).groupBy("kind", "resolution", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dst").isNull()).alias("without_target"))


@query("""SELECT x.index_id, x.commit_sha, (SELECT count(*) FROM part) AS symbols, CASE WHEN x.index_id = 4 THEN (SELECT CAST(sum(CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END) AS BIGINT) FROM lineitem) ELSE 0 END AS edges, ['c'] AS silent FROM (VALUES (2, 'bbbbbbb'), (3, 'ccccccc')) x(index_id, commit_sha)""".replace("index_id = 4", "index_id = 3"))
def graph_indexes(spark, d):
    """What is left of three loads, and what the report of each says."""
    rows = [(c["version"], c["commit_sha"], c["symbols"], c["edges"]["rows"], c["silent"]) for c in loaded(spark, d).indexes()]
    return spark.createDataFrame(rows, "index_id int, commit_sha string, symbols long, edges long, silent array<string>")

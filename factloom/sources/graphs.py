"""Code graphs: artifacts of an indexer as a source, and the store that loads them, shows them when complete, and keeps the newest."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks, graph
from ..operators.recall import Observed
from .log import Conflict, Log

SYMBOL = "key string, kind string, name string, fqn string, language string, path string, line_start long, line_end long, visibility string, signature string, signature_hash string"
EDGE = "src string, dst string, dst_name string, kind string, resolution string, candidates array<string>, path string, line long"
_STRUCT = lambda columns: f"array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in columns.split(', '))}>>"
ARTIFACT = f"version int, repo string, commit_sha string, indexer string, languages array<string>, file_count long, symbols {_STRUCT(SYMBOL)}, edges {_STRUCT(EDGE)}"
#: Names that a refusal lists at most, and groups in which ids are dealt.
TOLD, GROUPS = 20, 256
#: The vocabularies of artifacts.
SYMBOL_KINDS = ("function", "method", "type", "trait", "module", "macro", "test", "constant", "field", "kernel")
EDGE_KINDS = ("calls", "imports", "uses_type", "implements", "tests", "references", "instantiates")
RESOLUTIONS = ("compiler", "language-server", "unique-name", "ambiguous-name", "unresolved")


class Refused(ValueError):
    """An artifact that is not loaded: reason, and what it is about."""

    def __init__(self, reason: str, **detail):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


def read(spark: SparkSession, path: str) -> DataFrame:
    """The artifact of a file of one JSON object, plain or gzipped (.gz)."""
    return spark.read.schema(ARTIFACT).option("multiLine", "true").json(path)


def numbered(rows: DataFrame, key: str, first: int) -> DataFrame:
    """rows with id, gapless from first on: keys are dealt to GROUPS groups, numbered in each, and a group begins where those before it end."""
    rows = rows.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    sizes = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}  # GROUPS at most
    begins, at = [], first
    for g in range(GROUPS):
        begins.append(at)
        at += sizes.get(g, 0)
    starts = F.element_at(F.array(*map(F.lit, begins)), (F.col("_g") + 1).cast("int"))
    return rows.withColumn("id", (starts + F.row_number().over(Window.partitionBy("_g").orderBy(key)) - 1).cast("long")).drop("_g")


def _told(rows: DataFrame, column: str) -> list:
    return [r[0] for r in rows.select(column).distinct().orderBy(column).limit(TOLD).collect()]


class Graphs:
    """Indexes of repositories below one folder. An index is complete once its commit is there; until then nothing of it is seen."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Log(spark, folder)

    def indexes(self) -> list[dict]:
        """The indexes that were loaded and not pruned, in the order of their loads."""
        log = self.log.commits()
        gone = {i for c in log for i in c.get("pruned", ())}
        return [c for c in log if "repo" in c and c["version"] not in gone]

    def latest(self, repo: str, commit: str | None = None) -> dict | None:
        """The newest index of a repository, or that of a commit (a prefix will do; the whole name goes first)."""
        own = [c for c in self.indexes() if c["repo"] == repo and c["commit_sha"].startswith(commit or "")]
        return max(own, key=lambda c: (c["commit_sha"] == commit, c["version"]), default=None)

    def symbols(self, *indexes: dict) -> DataFrame:
        return self._read("symbols", f"{SYMBOL}, id long, index_id long", indexes)

    def edges(self, *indexes: dict) -> DataFrame:
        return self._read("edges", "src long, dst long, dst_name string, kind string, resolution string, confidence string, path string, line long, index_id long", indexes)

    def _read(self, name: str, schema: str, indexes) -> DataFrame:
        paths = [f"{c['folder']}/{name}" for c in indexes or self.indexes()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def load(self, artifact: DataFrame, scope: str | None = None, keep: int = 3) -> dict:
        """Loads an artifact (one row of ARTIFACT) and keeps the newest of its repository. The commit of the index, with its counts and the versions pruned."""
        heads = artifact.drop("symbols", "edges").limit(2).collect()
        if len(heads) != 1:
            raise Refused("one_artifact_a_load", found=len(heads))
        return self.load_parts(heads[0].asDict(), artifact.select(F.explode("symbols").alias("s")).select("s.*"), artifact.select(F.explode("edges").alias("e")).select("e.*"), scope, keep)

    def load_parts(self, head: dict, symbols: DataFrame, edges: DataFrame, scope: str | None = None, keep: int = 3) -> dict:
        """load of an artifact whose symbols and edges are tables."""
        if head["version"] != 1:
            raise Refused("version_known", version=head["version"])
        for name in ("repo", "indexer"):
            if not (head[name] or "").strip():
                raise Refused(f"{name}_present")
        faults = checks.refused(self.spark.createDataFrame([(head["commit_sha"], head["indexer"], head["repo"], scope or "org", 1)], "commit_sha string, indexer string, repo string, scope string, version int"), checks.artifacts()).first()["reason"]
        if faults:
            raise Refused(faults, commit_sha=head["commit_sha"], scope=scope)
        while True:
            log = self.log.commits()
            twin = next((c for c in log if (c.get("repo"), c.get("commit_sha"), c.get("indexer")) == (head["repo"], head["commit_sha"], head["indexer"]) and not any(c["version"] in p.get("pruned", ()) for p in log)), None)
            if twin:
                raise Refused("index_exists", index_id=twin["version"])
            entry = self._written(symbols, edges, head, len(log) + 1, 1 + max((c.get("last_id", 0) for c in log), default=0))
            entry["scope"] = scope
            try:
                self.log.commit(entry)
            except Conflict:
                self.log.remove(entry["folder"])
                continue
            entry["pruned_now"] = self.prune(head["repo"], keep)
            return entry

    def _written(self, symbols: DataFrame, raw: DataFrame, head: dict, version: int, first: int) -> dict:
        folder = self.log.new_folder()
        symbols = symbols.repartition(F.xxhash64("key")).checkpoint()
        bad = symbols.withColumn("_why", F.when(checks.blank("key"), "key_present").when(checks.not_in("kind", SYMBOL_KINDS), "kind_known").when(checks.blank("name"), "name_present").when(F.col("line_end") < F.col("line_start"), "lines_ordered")).where("_why IS NOT NULL").select("_why", "key").limit(1).collect()
        if bad:
            raise Refused(bad[0]["_why"], key=bad[0]["key"])
        twice = symbols.groupBy("key").count().where("count > 1")
        names = _told(twice, "key")
        if names:
            raise Refused("duplicate_keys", keys=names, n=twice.count())
        placed = numbered(symbols, "key", first).checkpoint()
        seen = Observed(f"symbols-{version}")
        seen.of(placed.withColumn("index_id", F.lit(version).cast("long")), last_id=F.max("id"), odd_names=F.count_if(F.col("name").rlike(r"\s"))).write.parquet(f"{folder}/symbols")
        raw = raw.withColumn("_why", F.when(checks.not_in("kind", EDGE_KINDS), "kind_known").when(checks.not_in("resolution", RESOLUTIONS), "resolution_known").when((F.col("resolution") == "ambiguous-name") & (F.coalesce(F.size("candidates"), F.lit(0)) < 2), "ambiguous_needs_candidates")).checkpoint()
        bad = raw.where("_why IS NOT NULL").select("_why", "src").limit(1).collect()
        if bad:
            raise Refused(bad[0]["_why"], src=bad[0]["src"])
        fanned = graph.fan_out(raw.drop("_why"), placed.select("key", "id")).checkpoint()
        strange = graph.unknown(fanned)
        names = _told(strange, "key")
        if names:
            raise Refused("unknown_keys", keys=names, n=strange.count())
        edges = fanned.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "dst_name", "kind", "resolution", "confidence", "path", "line", F.lit(version).cast("long").alias("index_id"))
        drawn = Observed(f"edges-{version}")
        drawn.of(edges, without_target=F.count_if(F.col("dst").isNull()), **{c: F.count_if(F.col("confidence") == c) for c in ("measured", "derived", "unverified")}).write.parquet(f"{folder}/edges")
        spoken = [r["language"] for r in placed.groupBy("language").count().collect()]  # languages are few
        at = datetime.datetime.now(datetime.timezone.utc).isoformat()
        return {
            "version": version, **{k: head[k] for k in ("repo", "commit_sha", "indexer", "languages", "file_count")}, "folder": folder, "completed_at": at,
            "symbols": seen.rows(), "last_id": seen.report()["last_id"] or first - 1, "odd_names": seen.report()["odd_names"], "edges": drawn.report(), "silent": sorted(set(head["languages"] or ()) - set(spoken)),
        }

    def prune(self, repo: str, keep: int = 3) -> list[int]:
        """Drops all but the newest keep indexes of a repository, never the last: the log first, so that no reader starts on what goes, then the files. The versions dropped, newest first."""
        while True:
            own = sorted((c for c in self.indexes() if c["repo"] == repo), key=lambda c: -c["version"])
            doomed = own[max(keep, 1) :]
            if not doomed:
                return []
            versions = [c["version"] for c in doomed]
            try:
                self.log.commit({"version": len(self.log.commits()) + 1, "pruned": versions})
            except Conflict:
                continue
            for c in doomed:
                self.log.remove(c["folder"])
            return versions

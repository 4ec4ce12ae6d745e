"""Recall by an inverted index of turns: a question reads the lists of the words that hold its probes, and no text.

A probe has no white space, so a text holds it if and only if one of the text's words (runs without white space, in
lower case) does. The index has three tables, written by the ingest of each batch of turns and made visible by its
commit: the vocabulary (word, in how many turns), lists (word, block of ids, the ids), sorted by word so that a look-up
prunes, and turns (id, session, seq, occurred_at, length). A list is cut by blocks of ids, so a word in every turn is
many rows of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import Conflict, Log
from . import episodes

#: Ids that a row of a list spans, and words up to which a look-up goes to the scan as a filter.
BLOCK, MOST_WORDS = 1 << 16, 1000


class Index:
    """The index of turns below one folder."""

    TABLES = {"vocabulary": "word string, n long", "lists": "word string, block long, ids array<long>", "turns": "id long, session long, seq long, occurred_at timestamp_ntz, n long"}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, Log(spark, folder)

    def table(self, name: str, commits: list[dict] | None = None) -> DataFrame:
        paths = [f"{c['folder']}/{name}" for c in (self.log.commits() if commits is None else commits)]
        return self.spark.read.schema(self.TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.TABLES[name])

    def ingest(self, turns: DataFrame, name: str) -> int:
        """Adds turns (id, session, seq, occurred_at, text) that the index lacks, as a batch; a batch that was committed is not read again. How many were added."""
        while True:
            commits = self.log.commits()
            for c in commits:
                if c["batch"] == name:
                    return c["rows"]
            folder = self.log.new_folder()
            new = turns.join(self.table("turns", commits).select("id"), "id", "left_anti").dropDuplicates(["id"])
            seen = Observed("turns")
            seen.of(new.select("id", "session", "seq", "occurred_at", F.length("text").alias("n"))).write.parquet(f"{folder}/turns")
            words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
            each = new.select("id", F.explode(words).alias("word")).withColumn("block", F.floor(F.col("id") / BLOCK))
            lists = each.groupBy("word", "block").agg(F.array_sort(F.collect_list("id")).alias("ids"))
            lists.repartitionByRange("word", "block").sortWithinPartitions("word", "block").write.parquet(f"{folder}/lists")
            written = self.spark.read.schema(self.TABLES["lists"]).parquet(f"{folder}/lists")
            written.groupBy("word").agg(F.sum(F.size("ids")).alias("n")).write.parquet(f"{folder}/vocabulary")
            try:
                self.log.commit({"version": len(commits) + 1, "batch": name, "folder": folder, "rows": seen.rows()})
            except Conflict:
                continue
            return seen.rows()

    def matches(self, probes: list[str]) -> DataFrame:
        """id and probe of the turns that hold each probe, each once."""
        held = F.array_compact(F.array(*(F.when(F.contains("word", F.lit(p)), F.lit(p)) for p in probes)))
        words = self.table("vocabulary").select("word").distinct().select("word", held.alias("probes")).where(F.size("probes") > 0)
        lists = self.table("lists")
        few = [r["word"] for r in words.limit(MOST_WORDS + 1).collect()]
        if len(few) <= MOST_WORDS:
            lists = lists.where(F.col("word").isin(few))
        return lists.join(words, "word").select(F.explode("ids").alias("id"), "probes").select("id", F.explode("probes").alias("probe")).distinct()

    def plan(self, question: str) -> tuple[list[dict], list[str], int]:
        """The probes that occur with their weights, best first; the terms no spelling of which occurs; and how many turns there are. The index alone is read."""
        terms = episodes.content_terms(question)
        probes = episodes.probes_of(terms)
        n = sum(c["rows"] for c in self.log.commits())
        if not probes or not n:
            return [], terms, n
        counts = {r["probe"]: r["df"] for r in self.matches(sorted({p for _, p, _ in probes})).groupBy("probe").agg(F.count(F.lit(1)).alias("df")).collect()}  # MOST_PROBES at most
        found = [{"term": t, "probe": p, "via": via, "df": counts[p], "idf": round((math.log(n / counts[p]) + 1) * episodes.DISCOUNT[via], 3)} for t, p, via in probes if p in counts]
        reached = {f["term"] for f in found}
        return sorted(found, key=lambda f: (-f["idf"], f["probe"])), [t for t in terms if t not in reached], n

    def recalled(self, question: str, window: tuple | None = None, limit: int = 12) -> Answer:
        """What episodes.recalled answers, read from the index."""
        limit = min(max(limit, 1), 100)
        plan, absent, n = self.plan(question)
        rare = math.log(max(n, 4) / 4) + 1
        turns, fell_back, total = self.table("turns"), False, None
        if window:
            inside = turns.where((F.col("occurred_at") >= window[0]) & (F.col("occurred_at") < window[1]))
            total = inside.count()
            if total:
                turns = inside
            else:
                window, fell_back = None, True
        weights = [(p["probe"], float(p["idf"])) for p in plan]
        probes = sorted({p for p, _ in weights})
        hits = self.matches(probes).groupBy("id").agg(F.collect_set("probe").alias("_probes")) if probes else None
        rows = turns.join(hits, "id", "left" if window else "inner") if hits is not None else turns.withColumn("_probes", F.array().cast("array<string>")).where(F.lit(window is not None))
        found = F.array_compact(F.array(*(F.when(F.array_contains("_probes", p), F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"))) for p, w in weights))) if weights else F.array().cast("array<struct<p:string,w:double>>")
        rows = rows.withColumn("_found", found)
        total_ = F.aggregate("_found", F.lit(0.0), lambda a, x: a + x["w"])
        strong = (F.size("_found") >= 2) | F.exists("_found", lambda x: x["w"] >= rare)
        tier = F.when(strong, "term+window" if window else "term").otherwise("window")
        rows = rows.select("id", "session", "seq", "occurred_at", F.array_join(F.transform("_found", lambda x: x["p"]), ",").alias("matched"), F.round(total_ / (1 + F.ln(1 + F.col("n") / 240)), 4).alias("score"), tier.alias("tier"), strong.alias("strong"))
        alone = bool(window) and rows.where("strong").isEmpty()
        if alone:
            top = rows.orderBy("occurred_at", "id").limit(episodes.WINDOW_CAP)
        else:
            top = rows.orderBy(F.desc(F.col("matched") != ""), F.desc("score"), "occurred_at", "id").limit(limit)
        return Answer(top.drop("strong"), plan, absent, total if window else None, fell_back, alone)


class Answer:
    """The hits of a question, its plan, and what to say about both."""

    def __init__(self, hits: DataFrame, plan: list[dict], absent: list[str], total: int | None, fell_back: bool, alone: bool):
        self.hits, self.plan, self.absent, self.total, self.fell_back, self.alone = hits, plan, absent, total, fell_back, alone

    def texts(self, turns: DataFrame) -> DataFrame:
        """The hits with their text: that of the hits alone is read."""
        return turns.select("id", "text").join(F.broadcast(self.hits), "id")  # 100 rows at most

    def nearby(self, turns: DataFrame, k: int = 1) -> DataFrame:
        """hit, and id, session, seq, role and text of the turns up to k before and after each hit, the hit itself left out."""
        near = self.hits.select(F.col("id").alias("hit"), "session", F.explode(F.sequence(F.col("seq") - k, F.col("seq") + k)).alias("seq"))
        return turns.join(F.broadcast(near), ["session", "seq"]).where("id <> hit").select("hit", "id", "session", "seq", "role", "text")  # 100 hits at most

    def note(self, read_as: str | None = None) -> str:
        """What was done, for a reader who never looks at the plan."""
        hits, said = self.hits.select("tier").collect(), []  # 100 rows at most
        if self.fell_back or self.total is not None:
            said.append(f"window {read_as or 'as given'}")
        if self.fell_back:
            said.append("that window was empty, so this is a search of the whole scope")
        if self.plan:
            said.append("terms " + " ".join(f"{p['term']}({p['idf']})" if p["probe"] == p["term"] else f"{p['term']}->{p['probe']}[{p['via']}]({p['idf']})" for p in self.plan[:6]))
        if self.absent:
            said.append("absent from corpus: " + ", ".join(self.absent[:8]))
        if hits and all(h["tier"] == "window" for h in hits):
            total = self.total if self.total is not None else len(hits)
            said.append(f"no term matched - showing {len(hits)} of {total} said in that window" if total > len(hits) else f"no term matched - this is all {len(hits)} said in that window")
        if not hits:
            said.append("no usable terms and no date in the question" if not self.plan and self.total is None else "nothing matched")
        return "; ".join(said)


class Observed:
    """Counts of what a write passes on, taken as it is written: no pass of its own."""

    def __init__(self, name: str):
        from pyspark.sql import Observation

        self.seen = Observation(name)

    def of(self, df: DataFrame, **counts) -> DataFrame:
        return df.observe(self.seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in counts.items()))

    def rows(self) -> int:
        return self.seen.get["rows"]

    def report(self) -> dict:
        return dict(self.seen.get)

"""The engine's tables: an append-only ledger and its companions, read from Parquet or derived from event-like inputs.

Supersession is never stamped on a row. A row names the row it supersedes; superseded_by is a view over the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCOPES = ("org/acme", "org/acme/proj/a", "org/acme/proj/b")
CONFIDENCE = ("measured", "derived", "unverified", "confirmed-by-human")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(rows: DataFrame, other: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join of rows with other by a shuffle at any size, for sides that both grow with the input: what Spark takes for small it would send through the driver."""
    return rows.join(other.hint("merge"), on, how)


def looked_up(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
    """rows with what other has of their on, null if it has nothing. Rows without on find nothing and take no part in the join, which would send them all to one task."""
    found = joined(rows.where(F.col(on).isNotNull()), other, on, "left")
    return found.unionByName(rows.where(F.col(on).isNull()), allowMissingColumns=True)


def _pick(values, n) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n + 1).cast("int"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions from events: one a row, each superseding the one before it of its key and tier. chain and place are what a store keeps of each row at its append."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(
        i.alias("id"),
        i.alias("asserted_at"),
        _pick(SCOPES, F.col("user_id") % 3).alias("scope"),
        F.concat(F.lit("user:"), (F.col("user_id") % 20).cast("string")).alias("subject"),
        F.col("event_type").alias("predicate"),
        "value",
        F.when(i % 23 == 0, "dead").when(i % 7 == 3, "state").otherwise("measured").alias("kind"),
        _pick(CONFIDENCE, i % 4).alias("confidence"),
        (i % 6 == 0).alias("binding"),
        F.col("ts").alias("valid_from"),
        F.when(i % 5 == 0, F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("valid_to"),
        F.when(i % 4 == 1, F.array(i - 1, F.when(i % 40 == 1, i + 100_000_000).otherwise(i))).alias("derived_from"),
    ).withColumn("tier", F.when(F.col("confidence").isin("measured", "derived"), "machine").otherwise(F.col("confidence")))
    before = Window.partitionBy("scope", "subject", "predicate", "tier").orderBy("asserted_at")
    return with_supersession(rows.withColumns({"supersedes": F.lag("id").over(before), "chain": F.first("id").over(before), "place": (F.row_number().over(before) - 1).cast("long")}))


def with_supersession(rows: DataFrame) -> DataFrame:
    """rows with superseded_by and superseded_at: the first row asserted that supersedes each."""
    first = rows.where("supersedes IS NOT NULL").groupBy(F.col("supersedes").alias("_target")).agg(F.min(F.struct("asserted_at", "id")).alias("_by"))
    out = joined(rows, first, rows["id"] == first["_target"], "left")
    return out.withColumns({"superseded_by": F.col("_by.id"), "superseded_at": F.col("_by.asserted_at")}).drop("_by", "_target")


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes that scopes were set to, from every 97th event."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").where(i % 97 == 5).select(_pick(SCOPES, F.col("user_id") % 3).alias("scope"), F.when(i % 2 == 0, "isolated").otherwise("shared").alias("mode"), i.alias("asserted_at"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions that ask for admission, some with defects."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.when(i % 37 == 0, "bad scope!").otherwise(_pick(SCOPES, F.col("user_id") % 3)).alias("scope"),
        F.when(i % 41 == 0, " ").otherwise(F.concat(F.lit("user:"), (F.col("user_id") % 20).cast("string"))).alias("subject"),
        F.col("event_type").alias("predicate"),
        "value",
        _pick(("measured", "failed", "dead", "state", "guess"), i % 5).alias("kind"),
        _pick(CONFIDENCE, i % 4).alias("confidence"),
        F.when(i % 11 != 0, F.concat(F.lit("log:"), i.cast("string"))).alias("source"),
        F.when(i % 3 != 0, "ada").alias("human"),
        F.when(i % 4 != 2, "because").alias("why"),
        F.when(i % 9 != 1, "new data").alias("reopen_if"),
        F.when(i % 13 != 0, i).alias("verification_id"),
        F.when(i % 17 != 1, F.array(i - 1)).otherwise(F.array().cast("array<bigint>")).alias("derived_from"),
        F.col("ts").alias("valid_from"),
        F.when(i % 29 == 0, F.col("ts") - F.expr("INTERVAL 1 DAY")).when(i % 2 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("valid_to"),
        (i % 19 != 0).alias("is_verifier"),
    )


def verifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").where(i % 3 == 2)
    return rows.select(
        i.alias("id"),
        (i - i % 10).alias("target"),
        _pick(("confirmed", "refuted", "unresolvable"), i % 10 % 3).alias("outcome"),
        F.when(i % 10 == 8, "no_commit_in_evidence").alias("reason"),
        F.col("ts").alias("checked_at"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances from conversations."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "agent").otherwise("system")
    at = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(conv_id AS INT), CAST(turn AS INT), 0)")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session"), F.col("turn").alias("seq"), role.alias("role"), (F.col("conv_id") % 5).alias("actor"), at.alias("occurred_at"), F.concat(F.coalesce("text", F.lit("")), F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), "?").otherwise("")).alias("text"), F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("branch-"), (F.col("conv_id") % 4).cast("string"))).alias("branch"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback events, one an actor, signature and occasion (a day); the first one stays."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _pick(SCOPES, F.col("user_id") % 3).alias("scope"),
        F.col("user_id").alias("actor"),
        F.concat("event_type", F.lit(":"), (F.col("event_id") % 50).cast("string")).alias("signature"),
        F.to_date("ts").alias("occasion"),
        "value",
        F.col("ts").alias("created_at"),
    )
    return e.groupBy("actor", "signature", "occasion").agg(F.min_by(F.struct("id", "scope", "value", "created_at"), "id").alias("e")).select("actor", "signature", "occasion", "e.*")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers: the latest heartbeat of each, from an event log."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("node_id")).agg(F.max("ts").alias("heartbeat_at"))
    return e.select("node_id", F.concat(F.lit("worker-"), F.col("node_id").cast("string")).alias("label"), _pick(SCOPES, F.col("node_id") % 3).alias("scope"), "heartbeat_at", (F.col("node_id") % 17 == 5).alias("retired"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("node_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("statement"), F.col("ts").alias("occurred_at"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of paths; every third is released."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").where(i % 20 == 3).select(i.alias("claim_id"), (F.col("user_id") % 50).alias("node_id"), F.concat("event_type", F.lit("/"), (i % 100).cast("string")).alias("path"), F.col("ts").alias("claimed_at"), (i % 3 == 0).alias("released"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat_ws("::", F.replace("p_brand", F.lit("#"), F.lit("_")), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("fqn"), F.col("p_type").alias("language"), F.concat("p_brand", F.lit(".py")).alias("path"), F.col("p_size").cast("long").alias("line"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls between symbols, each once: src calls dst."""
    kinds, trust = ("calls", "imports", "tests", "implements", "uses", "extends", "instantiates"), ("unverified", "derived", "measured")
    ranks = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    n = table(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("n"))
    e = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))  # one row
    return e.select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") + 1) % F.col("n")).alias("dst"), _pick(kinds, (F.col("l_linenumber") - 1) % 7).alias("kind"), _pick(trust, ranks).alias("confidence")).distinct()


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates, with ids beyond the ledger's, some of which ask to supersede rows of it."""
    i = F.col("id")
    target = F.when(i % 35 == 3, i + 200_000_000).when(i % 5 == 3, i - i % 4)
    return candidates(spark, sf_dir).withColumn("supersedes", target).withColumn("id", i + 1_000_000_000)


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missions from orders: a customer's supersede one another in the order of their keys; some are faulty."""
    i = F.col("o_orderkey")
    mine = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gate = F.struct(F.lit("user:1").alias("subject"), F.col("o_orderpriority").alias("predicate"), F.when(i % 11 == 0, "~").otherwise(">=").alias("op"), F.when(i % 13 == 0, "soon").otherwise("5").alias("target"), F.lit("measured").alias("requires_confidence"))
    gates = F.when(i % 7 == 0, F.array().cast(gate_type())).otherwise(F.array(gate))
    rows = table(spark, sf_dir, "orders").select(i.alias("id"), i.alias("asserted_at"), _pick(SCOPES, F.col("o_custkey") % 3).alias("scope"), F.when(i % 17 == 0, " ").otherwise(F.concat(F.lit("mission "), (i % 100).cast("string"))).alias("statement"), F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "closed").otherwise("odd").alias("state"), gates.alias("gates"), F.lag(i).over(mine).alias("supersedes"), F.lead(i).over(mine).alias("superseded_by"))
    return rows


def gate_type() -> str:
    return "array<struct<subject:string,predicate:string,op:string,target:string,requires_confidence:string>>"


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of files of ten each from parts: a trait, a type, methods, functions, a test and a constant; one file in four has no qualified names."""
    i = F.col("p_partkey")
    at, file = i % 10, F.floor(i / 10)
    kind = _pick(("trait", "type", "method", "method", "method", "method", "function", "function", "test", "const"), at)
    own = F.concat(F.lit("m"), (F.col("p_size") % 8).cast("string"))
    name = F.when(at == 0, F.concat(F.lit("Tr"), i.cast("string"))).when(at == 1, F.concat(F.lit("T"), i.cast("string"))).otherwise(own)
    fqn = F.when(at == 0, name).when(file % 4 == 3, None).when(at == 1, name).otherwise(F.concat(F.lit("T"), (i - at + 1).cast("string"), F.lit("::"), own))
    start = (at * 10 + 1).cast("long")
    path = F.concat(F.lit("f"), file.cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "part").select(i.alias("id"), kind.alias("kind"), name.alias("name"), fqn.alias("fqn"), path.alias("path"), start.alias("line_start"), (start + F.when(at == 0, 45).when(at == 1, 60).otherwise(5)).alias("line_end"), F.when(i % 2 == 0, "python").otherwise("rust").alias("family"), (i % 3 == 0).alias("is_declaration"), (i % 50).alias("index_id"))


def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges, types implementing five traits."""
    i = F.col("p_partkey")
    types = table(spark, sf_dir, "part").where(i % 10 == 1)
    own = types.select(i.alias("src"), (F.floor(i / 10) % 5 * 10).alias("dst"), F.lit("implements").alias("kind"), _pick(("unverified", "derived", "measured"), F.floor(i / 10) % 3).alias("confidence"))
    return edges(spark, sf_dir).where("kind <> 'implements'").unionByName(own)


def preferences(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Preferences as an earlier pass over the candidates found may have left them."""
    n = F.col("occasions")
    return found.where(n % 3 != 0).select(F.concat_ws("|", "scope", "signature").alias("id"), "scope", "signature", F.when(n % 7 == 1, "personal").otherwise(F.col("tier")).alias("tier"), F.when(n % 4 == 0, n).otherwise(n - 1).alias("occasions"), "humans", F.when(n % 5 == 0, "rejected").otherwise("active").alias("status"), (F.col("tier") == "org").alias("binding"), "last_seen")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of notes on parts: headings, statements of three shapes, code in fences, and lines that state nothing."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    lines = [
        F.concat(F.lit("# "), F.col("p_brand"), F.when(i % 9 == 4, " UNMEASURED_x, do not quote").otherwise("")), F.concat(name, F.lit(": "), size, F.lit(" mm")), F.concat(F.lit("The "), F.col("p_name"), F.lit(" is now "), size, F.lit(" kg.")),
        F.concat(F.lit("widget_"), size, F.lit(" is a "), F.lower("p_type"), F.lit(" part.")), F.when(i % 5 == 0, "this estimate is 3 mm.").otherwise("You must never mix small parts with large ones."),
        F.when(i % 3 == 0, "```\nsize: 4 mm\n```").otherwise("> quoted: 5 mm"), F.when(i % 4 == 0, F.concat(F.lit("const LIMIT: u32 = 1_"), F.lpad(size, 3, "0"), F.lit(";"))).otherwise(F.concat(F.lit("static_assert(width % "), size, F.lit(");"))),
    ]
    return table(spark, sf_dir, "part").select(i.alias("doc_id"), F.concat_ws("\n", *lines).alias("text"))

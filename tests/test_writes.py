"""The write path and the streaming jobs over several runs, and odd tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import checks, episodes, graph, people, prose, reads, writes
from factloom.plans import answers, catalogue
from factloom.sources import log
from factloom.streaming import jobs

SCHEMA = "id long, scope string, subject string, predicate string, value double, kind string, confidence string, source string, human string, why string, reopen_if string, verification_id long, derived_from array<long>, valid_from timestamp_ntz, valid_to timestamp_ntz, is_verifier boolean, supersedes long"
DAY = datetime.datetime(2024, 1, 1)
GOOD = dict(scope="a/b", subject="s", predicate="p", value=1.0, kind="measured", confidence="measured", source="x", human="h", why="w", reopen_if="r", verification_id=1, derived_from=[1], valid_from=DAY, valid_to=None, is_verifier=True, supersedes=None)


def _store(spark, tmp_path):
    return writes.Store(spark, str(tmp_path / "store"), answers._STORE)


def _batch(spark, *rows):
    return spark.createDataFrame([GOOD | r for r in rows], SCHEMA)


def _said(verdicts):
    return {r["id"]: (r["reason"], r["existing"]) for r in verdicts.collect()}


TAKEN, ABSENT, CLASH = "supersedes_target_already_superseded", "supersedes_target_not_found", "no_two_live_contradictions"


def test_appends_supersessions_and_refusals(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.assertions().count() == store.outbox().count() == store.rejections().count() == 0
    first = store.append(_batch(spark, {"id": 1}, {"id": 2}, {"id": 3, "value": 2.0}, {"id": 4, "source": " ", "subject": "t"}), "one")
    assert _said(first) == {1: (None, None), 2: (None, 1), 3: (CLASH, None), 4: ("evidence_required", None)}
    # a successor frees its target's period; a second one comes too late, as does one of a row that is not there
    second = store.append(_batch(spark, {"id": 11, "value": 3.0, "supersedes": 1}, {"id": 12, "value": 4.0, "supersedes": 1}, {"id": 13, "subject": "u", "supersedes": 99}), "two")
    assert {i: r for i, (r, _) in _said(second).items()} == {11: None, 12: TAKEN, 13: ABSENT}
    third = store.append(_batch(spark, {"id": 21, "value": 5.0, "supersedes": 1}, {"id": 22}), "three")
    assert _said(third) == {21: (TAKEN, None), 22: (None, 1)}
    led = store.assertions()
    assert {(r["id"], r["superseded_by"], r["chain"], r["place"]) for r in led.collect()} == {(1, 11, 1, 0), (11, None, 1, 1)}
    assert [r["id"] for r in store.outbox().orderBy("seq").collect()] == [1, 11]
    told = {r["id"]: r["message"] for r in store.rejections().collect()}
    assert set(told) == {3, 4, 12, 13, 21} and told[21].endswith("head: 11")
    assert {r["id"] for r in reads.walked(led, 1).collect()} == {1, 11}
    assert store.tampered() == []


def test_a_batch_sent_again_after_its_successor_loses_nothing(spark, tmp_path):
    store = _store(spark, tmp_path)
    one = _batch(spark, {"id": 1}, {"id": 2, "subject": "t"}, {"id": 3, "source": " "})
    first = sorted(store.append(one, "one").collect())
    store.append(_batch(spark, {"id": 11, "value": 2.0, "supersedes": 1}), "two")
    before = sorted(store.assertions().collect())
    assert sorted(store.append(one, "one").collect()) == first
    assert sorted(store.assertions().collect()) == before and len(before) == 3
    assert {r["id"]: r["superseded_by"] for r in before} == {1: 11, 2: None, 11: None}
    assert sorted(r["id"] for r in store.outbox().collect()) == [1, 2, 11] and store.rejections().count() == 1
    assert [c["batch"] for c in store.commits()] == ["one", "two"]


def test_of_two_writers_one_commits_a_version(spark, tmp_path):
    """The other decides anew on what is there then; if it has the same batch, it gets the stored verdicts."""
    mine, other = _store(spark, tmp_path), _store(spark, tmp_path)
    real, turns = mine.log.commit, []

    def late(entry):
        if not turns:
            turns.append(entry["version"])
            other.append(_batch(spark, {"id": 5, "value": 9.0}), "theirs")
        real(entry)

    mine.log.commit = late
    assert _said(mine.append(_batch(spark, {"id": 6, "value": 1.0}, {"id": 7, "subject": "free"}), "ours")) == {6: (CLASH, None), 7: (None, None)}
    assert [(c["version"], c["batch"]) for c in mine.commits()] == [(1, "theirs"), (2, "ours")]
    with pytest.raises(log.Conflict):
        real(mine.commits()[0])
    turns.clear()
    rows = _batch(spark, {"id": 8, "subject": "same"})

    def twin(entry):
        if not turns:
            turns.append(1)
            other.append(rows, "same")
        real(entry)

    mine.log.commit = twin
    assert _said(mine.append(rows, "same")) == {8: (None, None)} and len(mine.commits()) == 3
    assert mine.assertions().where("id = 8").count() == 1


def test_a_writer_that_fails_leaves_nothing_to_be_seen(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(_batch(spark, {"id": 1}), "one")

    def lost(_):
        raise OSError("gone")

    broken = _store(spark, tmp_path)
    broken.log.commit = lost
    with pytest.raises(OSError):
        broken.append(_batch(spark, {"id": 2, "subject": "t"}, {"id": 3, "source": ""}), "two")
    assert [r["id"] for r in store.assertions().collect()] == [1] and store.rejections().count() == 0
    assert _said(store.append(_batch(spark, {"id": 2, "subject": "t"}), "two")) == {2: (None, None)}


def test_stored_rows_are_not_rewritten(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(_batch(spark, {"id": 1}, {"id": 2, "subject": "t"}), "one")
    again = store.append(_batch(spark, {"id": 1, "value": 7.0}, {"id": 2, "subject": "t"}, {"id": 3, "subject": "u"}), "two")
    assert _said(again) == {1: ("assertions_are_immutable", None), 2: (None, 2), 3: (None, None)}
    assert {r["id"]: r["value"] for r in store.assertions().collect()} == {1: 1.0, 2: 1.0, 3: 1.0}
    # rows that vanish or change below the store's hands are told of
    folder = store.commits()[0]["folder"] + "/assertions"
    rows = spark.read.parquet(folder).collect()
    schema = spark.read.parquet(folder).schema
    spark.createDataFrame([r for r in rows if r["id"] == 2], schema).write.mode("overwrite").parquet(folder)
    assert store.tampered() == [("one", "assertions_are_append_only")]
    spark.createDataFrame([tuple("forged" if n == "hash" and r["id"] == 1 else r[n] for n in schema.names) for r in rows], schema).write.mode("overwrite").parquet(folder)
    assert store.tampered() == [("one", "assertions_are_immutable")]


def test_chains_within_a_batch_and_across_keys(spark, tmp_path):
    """A row may supersede one of its own batch, and one of another key; a row that falls leaves its target to the next."""
    store = _store(spark, tmp_path)
    store.append(_batch(spark, {"id": 1}, {"id": 2, "subject": "t"}), "one")
    rows = [
        {"id": 10, "value": 2.0, "subject": "t", "supersedes": 1},  # the period of t is 2's: falls, 1 stays a head
        {"id": 11, "value": 3.0, "supersedes": 1},
        {"id": 12, "value": 4.0, "supersedes": 11},
        {"id": 13, "value": 5.0, "supersedes": 12},
        {"id": 14, "value": 6.0, "subject": "v", "supersedes": 2},  # of another key: t's period is free
        {"id": 15, "value": 7.0, "subject": "t"},
        {"id": 16, "value": 8.0, "subject": "w", "supersedes": 14},
        {"id": 17, "value": 9.0, "subject": "v"},
        {"id": 18, "value": 9.5, "subject": "x", "supersedes": 19},  # comes before its target
        {"id": 19, "value": 9.5, "subject": "y"},
        {"id": 20, "value": 1.5, "subject": "z", "supersedes": 2},
    ]
    got = {i: r for i, (r, _) in _said(store.append(_batch(spark, *rows), "two")).items()}
    assert got == {10: CLASH, 11: None, 12: None, 13: None, 14: None, 15: None, 16: None, 17: None, 18: ABSENT, 19: None, 20: TAKEN}
    led = {r["id"]: (r["superseded_by"], r["chain"], r["place"]) for r in store.assertions().collect()}
    assert led == {1: (11, 1, 0), 11: (12, 1, 1), 12: (13, 1, 2), 13: (None, 1, 3), 2: (14, 2, 0), 14: (16, 2, 1), 16: (None, 2, 2), 15: (None, 15, 0), 17: (None, 17, 0), 19: (None, 19, 0)}
    heads = {r["id"]: (r["head"], r["hops"]) for r in reads.chain_heads(store.assertions()).collect()}
    assert heads[1] == (13, 3) and heads[2] == (16, 2) and heads[16] == (16, 0)


def test_long_chain_takes_no_more_jobs(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = _batch(spark, *({"id": k, "value": float(k), "supersedes": k - 1 if k > 1 else None} for k in range(1, 301)))
    assert set(_said(store.append(rows, "one")).values()) == {(None, None)}
    led = store.assertions()
    assert reads.walked(led, 150).count() == 300 and reads.chain_heads(led).where("head = 300 AND hops = 300 - id").count() == 300


def test_rows_that_ask_for_no_target_are_dealt_to_all_tasks(spark):
    ledger = _batch(spark, *({"id": k, "subject": f"s{k}"} for k in range(1, 40))).withColumn("superseded_by", F.lit(None).cast("long"))
    batch = _batch(spark, *({"id": 1000 + k, "supersedes": k if k < 50 else None} for k in range(1, 400)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = writes._standing(batch, ledger).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 399 and {r["id"] - 1000 for r in rows if r["standing"] == "head"} == set(range(1, 40))
    none = [r["task"] for r in rows if r["supersedes"] is None]
    assert len(none) == 350 and max(map(none.count, set(none))) < 350 / 2


def test_versions_of_long_chains_take_few_rounds(spark, monkeypatch):
    rows = [(k * 7 % 41, (k - 1) * 7 % 41 if k else None) for k in range(41)] + [(100, 101), (101, 102), (102, 100), (103, 100), (104, 999), (105, 104), (106, 7)]
    missions, rounds = spark.createDataFrame(rows, "id long, supersedes long"), []
    kind, real = type(missions), type(missions).checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a: rounds.append(1) or real(self, *a))
    got = {r["id"]: r["version"] for r in writes.versions(missions).collect()}
    assert got == {k * 7 % 41: k + 1 for k in range(41)} | {106: 3}  # none in or behind a circle, or that leads nowhere
    assert len(rounds) <= 9


def test_gates_of_numbers_of_any_form(spark):
    from factloom.operators import disputes

    cases_ = [(2.0e7, ">=", "5", True), (2.0e7, "=", "20000000", True), (1e-5, ">=", "5", False), (1e-5, "=", "0.00001", True), (12345678.25, ">", "12345678.2", True), (5.0, "=", "five", False), (5.0, "!=", "five", True), (5.0, ">", "five", None), (1e300, ">", "1e299", True), (7.0, "=", "NaN", False)]
    gates = spark.createDataFrame([("m", k, "s", str(k), op, target, "measured") for k, (_, op, target, _) in enumerate(cases_)], "mission string, gate int, subject string, predicate string, op string, target string, requires_confidence string")
    led = spark.createDataFrame([(k, k, "a", "s", str(k), v, "measured", "measured", None) for k, (v, *_) in enumerate(cases_)], "id long, asserted_at long, scope string, subject string, predicate string, value double, kind string, confidence string, superseded_by long")
    got = {r["gate"]: r["reached"] for r in disputes.evaluate(gates, led, ["a"]).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(cases_)}
    texts = led.withColumn("value", F.lit("12345678901234568")).where("id = 0")
    gate = gates.where("gate = 0").withColumn("op", F.lit("=")).withColumn("target", F.lit("12345678901234567"))
    assert disputes.evaluate(gate, texts, ["a"]).first()["reached"] is False
    assert checks.refused(spark.createDataFrame([("x", "active", "a", [("s", "p", ">=", t, "measured")]) for t in ("1234567890123456789", "1e-7", "ten")], "statement string, state string, scope string, gates array<struct<subject:string,predicate:string,op:string,target:string,requires_confidence:string>>"), checks.missions()).where("reason IS NULL").count() == 2


def test_retracted_numbers_are_no_facts(spark):
    lines = spark.createDataFrame([(1, 1, "# Results"), (1, 2, "aa: 3 ms"), (1, 3, "## UNMEASURED - do not quote"), (1, 4, "latency: 31.69 ms"), (1, 5, "## Later"), (1, 6, "bb: 4 ms"), (1, 7, "cc_UNVERIFIED_x: 5 ms")], "doc_id long, line long, text string")
    assert sorted(r["subject"] for r in prose.facts(prose.statements(lines)).collect()) == ["aa", "bb"]


def test_empty_batch(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.append(_batch(spark).limit(0), "none").count() == 0 and store.assertions().count() == 0


def _events(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(folder)


def test_jobs_deliver_once_over_runs_and_forget_nothing(spark, tmp_path):
    folder, job = str(tmp_path / "events"), f"test-{tmp_path.name}"
    late = DAY - datetime.timedelta(days=400)
    _events(spark, folder, [(1, 7, "a", DAY), (2, 7, "a", DAY), (3, 8, "a", late)])
    assert jobs.outbox(spark, folder, f"{job}-o").count() == 3
    assert jobs.once_per_occasion(spark, folder, f"{job}-f").count() == 2
    _events(spark, folder, [(4, 7, "a", DAY), (5, 9, "a", late - datetime.timedelta(days=400)), (6, 8, "a", late)])
    assert sorted(r["seq"] for r in jobs.outbox(spark, folder, f"{job}-o").collect()) == [1, 2, 3, 4, 5, 6]
    assert {r["actor"] for r in jobs.once_per_occasion(spark, folder, f"{job}-f").collect()} == {7, 8, 9}
    assert jobs.once_per_occasion(spark, folder, f"{job}-f").count() == 3
    assert jobs.tallies(spark, folder, f"{job}-t").first().asDict() == {"signature": "a", "events": 6, "humans": 3}


def test_odd_tables(spark):
    """Nulls, ties and empty tables have results."""
    none = spark.createDataFrame([], "id long, session long, seq long, role string, text string, occurred_at timestamp_ntz, actor long, branch string")
    assert episodes.recalled(none, "any thing?").count() == 0 and episodes.echoes(none).count() == 0 and episodes.branches(none).count() == 0
    edges = spark.createDataFrame([(1, 1, "calls", "derived"), (None, 1, "calls", "measured")], "src long, dst long, kind string, confidence string")
    assert [r["id"] for r in graph.impact(edges.where("src IS NOT NULL"), 1, 3).collect()] == [1]
    lines = spark.createDataFrame([(1, 1, "---"), (1, 2, "aa: 3 ms"), (1, 3, "---"), (1, 4, "bb: 3 ms"), (1, 5, "it is 3 ms"), (2, 1, "")], "doc_id long, line long, text string")
    assert [r["subject"] for r in prose.facts(prose.statements(lines)).collect()] == ["bb"]
    assert checks.refused(spark.createDataFrame([(None, None, None)], "path string, claimed_at timestamp, scope string").withColumn("released_at", F.lit(None).cast("timestamp")), checks.claims()).first()["reason"] == "path_present"
    claims = spark.createDataFrame([(1, "p", "claim", 1), (1, "p", "claim", 2), (1, None, "retire", 3), (1, "q", "claim", 3), (1, "r", "claim", 4)], "node_id long, path string, event string, at long")
    assert [(r["path"], r["claimed_at"]) for r in people.held_paths(claims).collect()] == [("r", 4)]


def test_targets(spark):
    symbols = spark.createDataFrame([(1, "f", "a::f"), (2, "f", "b::f"), (3, "g", None)], "id long, name string, fqn string")
    assert graph.target_of(symbols, "id:2") == 2 and graph.target_of(symbols, "a::f") == 1 and graph.target_of(symbols, "g") == 3
    for text in ("f", "nothing", "id:9"):
        with pytest.raises(ValueError):
            graph.target_of(symbols, text)
    with pytest.raises(ValueError):
        graph.report(symbols, symbols, 1, 9)


def test_all_names_of_the_survey_are_registered():
    names = "why_bundle binding_count contradictions_pairs_overlap gate_no_evidence awaiting_human admit_precedence admit_supersede_head session_ordered resume_branch_histogram recall_fallback search_filter_only why_path_tiers why_symbol_facts echo_last_turns impact_weakest_link impact_tests impact_trait_methods edges_ceiling shadowed_declarations preference_promotions prose_phrase_boost rules_dedupe pinned_consts grader_verdicts"
    assert set(names.split()) <= set(catalogue.QUERIES)

"""Every registered query against DuckDB, and the ones without SQL against plain Python."""

import pytest

from factloom.operators import admission, reads
from factloom.plans import catalogue
from factloom.sources import tables
from tests.oracle import assert_same, connection

SMALL = "/root/testdata/sf0.001"


#: Queries that the smallest tables have no rows for.
LARGER = {name: "/root/testdata/sf0.01" for name in ("admit_idempotent_hash", "recall_window")}


@pytest.fixture(scope="module")
def cons():
    return {d: connection(d) for d in (SMALL, *LARGER.values())}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, cons, name):
    folder = LARGER.get(name, SMALL)
    assert assert_same(catalogue.QUERIES[name](spark, folder), cons[folder], catalogue.ORACLES[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SMALL).count() > 0


def test_exclusion(spark):
    rows = admission.split(tables.candidates(spark, SMALL))[0].where("confidence IN ('measured', 'derived')").collect()
    got = {r["id"]: r["accepted"] for r in catalogue.admit_exclusion(spark, SMALL).collect()}
    held, want = {}, {}
    for r in sorted(rows, key=lambda r: r["id"]):
        mine = held.setdefault((r["scope"], r["subject"], r["predicate"]), [])
        want[r["id"]] = all((b is not None and b <= r["valid_from"]) or (r["valid_to"] is not None and r["valid_to"] <= a) for a, b in mine)
        if want[r["id"]]:
            mine.append((r["valid_from"], r["valid_to"]))
    assert got == want and len(set(want.values())) == 2


BAD = {
    "confidence_is_earned": {"is_verifier": False}, "confidence_known": {"confidence": "sure"}, "derived_requires_inputs": {"confidence": "derived", "derived_from": []}, "episode_evidence_is_never_measured": {"source": "episode:e1"}, "evidence_required": {"source": " "},
    "failed_requires_reopen_if": {"reopen_if": None}, "failure_requires_why": {"why": ""}, "human_evidence_names_a_human": {"confidence": "confirmed-by-human", "human": None}, "kind_known": {"kind": "guess"},
    "measured_requires_verification": {"verification_id": None}, "predicate_present": {"predicate": None}, "scope_shape": {"scope": "a//b"}, "subject_present": {"subject": ""}, "valid_period_ordered": {"valid_to": 1},
}


@pytest.mark.parametrize("rule", sorted(BAD))
def test_each_rule_is_what_refuses(spark, rule):
    """Without the rule, a row that only it refuses is accepted."""
    good = dict(id=1, scope="a/b", subject="s", predicate="p", kind="failed", confidence="measured", source="x", human="h", why="w", reopen_if="r", verification_id=1, derived_from=[1], valid_from=1, valid_to=2, is_verifier=True)
    schema = "id long, scope string, subject string, predicate string, kind string, confidence string, source string, human string, why string, reopen_if string, verification_id long, derived_from array<long>, valid_from long, valid_to long, is_verifier boolean"
    row = spark.createDataFrame([good | BAD[rule]], schema)
    assert {name for name, _ in admission.rules()} == set(BAD)
    assert admission.reasons(row).first()["reason"] == rule
    assert admission.reasons(row, without=rule).first()["reason"] is None


def test_chain(spark):
    modes = spark.createDataFrame([("a", "isolated", 1), ("a/b", "shared", 5)], "scope string, mode string, asserted_at long")
    assert reads.chain(modes, "a/b/c") == ["a/b/c", "a/b", "a"]
    assert reads.chain(modes, "a/b/c", as_of=2) == ["a/b/c", "a/b", "a"]
    assert reads.chain(modes.where("scope = 'a'"), "a/b") == ["a/b", "a"]
    assert reads.chain(spark.createDataFrame([("a/b", "isolated", 1)], modes.schema), "a/b/c") == ["a/b/c", "a/b"]
    assert reads.chain(reads.empty_modes(spark), "a") == ["a"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fallback_with_turns_in_any_year(spark, tmp_path):
    """A turn of 2031, as tables of 60,000 conversations have, leaves the window of recall_fallback empty."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows.union(rows.withColumn("conv_id", F.col("conv_id") + 61_365)).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("region", "nation", "part", "orders", "lineitem", "events", "documents"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SMALL}/{name}.parquet")
    assert assert_same(catalogue.QUERIES["recall_fallback"](spark, str(tmp_path)), connection(str(tmp_path)), catalogue.ORACLES["recall_fallback"]) == 12

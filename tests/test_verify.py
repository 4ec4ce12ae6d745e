"""The verification pass and the append-only tables, over several passes, writers and failures."""

import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import records, verify, writes
from factloom.sources import appended

SCHEMA = "id long, scope string, subject string, predicate string, value double, kind string, confidence string, source string, valid_from timestamp_ntz, valid_to timestamp_ntz, supersedes long, verification_id long"
DAY = datetime.datetime(2024, 1, 1)
EVIDENCE = "id long, repo string, commit_sha string, refs array<string>"
COMMITS = "repo string, commit_sha string, contained_in array<string>"


def _rows(spark, *rows):
    good = dict(scope="a/b", subject="s", predicate="p", value=1.0, kind="measured", confidence="unverified", source="x", valid_from=DAY, valid_to=None, supersedes=None, verification_id=None)
    return records.batch(spark.createDataFrame([good | r for r in rows], SCHEMA))


def _at(hour):
    return F.lit(datetime.datetime(2024, 2, 1, hour)).cast("timestamp_ntz")


def _both(spark, tmp_path):
    return writes.Store(spark, str(tmp_path / "store"), SCHEMA), appended.Appended(spark, str(tmp_path / "checks"), verify.CHECKS)


def _pass(spark, store, checks, name, hour, evidence, commits, before=None, limit=None):
    repos = spark.createDataFrame([("r", "main")], "repo string, default_branch string")
    out = verify.run(store, checks, spark.createDataFrame(evidence, EVIDENCE), repos, spark.createDataFrame(commits, COMMITS), name, _at(hour), _at(before if before is not None else 0), limit)
    return {r["target"]: (r["outcome"], r["reason"], r["promoted_to"] is not None, r["refused"]) for r in out.collect()}


HELD = [("r", "c1", ["main", "rel"]), ("r", "c2", ["rel"]), ("r", "c3", None)]
SAID = [(1, "r", "c1", ["main"]), (2, "r", "c2", None), (3, "r", " ", None), (4, "q", "c1", None), (5, "r", "c9", []), (6, "r", "c2", ["rel", "main"]), (7, "r", "c3", ["main"])]


def test_outcomes_and_promotions(spark, tmp_path):
    store, checks = _both(spark, tmp_path)
    store.append(_rows(spark, *({"id": i, "subject": f"s{i}"} for i in range(1, 9))), "rows")
    got = _pass(spark, store, checks, "one", 1, SAID, HELD)
    assert got == {
        1: ("confirmed", None, True, None), 2: ("confirmed", None, True, None), 3: ("unresolvable", "no_commit_in_evidence", False, None), 4: ("unresolvable", "repository_unreadable", False, None),
        5: ("refuted", "commit_not_found", False, None), 6: ("refuted", "not_contained", False, None), 7: ("refuted", "not_contained", False, None), 8: ("unresolvable", "no_commit_in_evidence", False, None),
    }
    led = {r["subject"]: r for r in store.assertions().where("superseded_by IS NULL").collect()}
    assert (led["s1"]["confidence"], led["s1"]["supersedes"], led["s1"]["source"]) == ("measured", 1, "x")
    assert led["s2"]["source"] == "x (branch only, not on main)" and led["s3"]["confidence"] == "unverified"
    assert {k: (r["value"], r["why"] if "why" in r.asDict() else None) for k, r in led.items() if k.startswith("assertion:")}.keys() == {f"assertion:{i}" for i in range(1, 9)}
    assert led["assertion:5"]["value"] == 0.0 and led["assertion:1"]["value"] == 1.0 and led["assertion:4"]["value"] is None
    assert checks.rows().where("id = target").count() == 0 and checks.rows().select("id").distinct().count() == 8


def test_a_recheck_supersedes_what_changed_only(spark, tmp_path):
    store, checks = _both(spark, tmp_path)
    store.append(_rows(spark, *({"id": i, "subject": f"s{i}"} for i in range(1, 9))), "rows")
    _pass(spark, store, checks, "one", 1, SAID, HELD)
    # nothing is due before an hour has gone by
    assert _pass(spark, store, checks, "none", 1, SAID, HELD, before=1) == {}
    later = [("r", "c1", ["main"]), ("r", "c2", ["main", "rel"]), ("r", "c9", ["main"])]
    got = _pass(spark, store, checks, "two", 3, SAID, later, before=2)
    # rows without a commit stay as they are; confirmed ones are live no more
    assert got == {4: ("unresolvable", "repository_unreadable", False, None), 5: ("confirmed", None, True, None), 6: ("confirmed", None, True, None), 7: ("refuted", "commit_not_found", False, None)}
    rows = store.assertions().where("predicate = 'verification_outcome'").collect()
    by = {}
    for r in rows:
        by.setdefault(r["subject"], []).append((r["value"], r["superseded_by"] is None))
    assert sorted(by["assertion:5"]) == [(0.0, False), (1.0, True)] and by["assertion:7"] == [(0.0, True)] and by["assertion:4"] == [(None, True)]
    assert store.tampered() == []


def test_a_pass_sent_again_or_stopped_halfway(spark, tmp_path, monkeypatch):
    store, checks = _both(spark, tmp_path)
    store.append(_rows(spark, {"id": 1, "subject": "s1"}, {"id": 5, "subject": "s5"}), "rows")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "append", lost)
        with pytest.raises(RuntimeError):
            _pass(spark, store, checks, "one", 1, SAID, HELD)
    assert checks.rows().count() == 2 and store.assertions().count() == 2
    first = _pass(spark, store, checks, "one", 2, SAID, HELD)
    assert first == {1: ("confirmed", None, True, None), 5: ("refuted", "commit_not_found", False, None)}
    n = store.assertions().count()
    assert _pass(spark, store, checks, "one", 9, [], []) == first and store.assertions().count() == n == 5


def test_refused_promotion_and_limit(spark, tmp_path):
    store, checks = _both(spark, tmp_path)
    measured = _rows(spark, {"id": 9, "value": 2.0, "confidence": "measured", "verification_id": 1}).withColumn("is_verifier", F.lit(True))
    store.append(measured, "measured")
    store.append(_rows(spark, {"id": 10}, {"id": 11, "subject": "t"}, {"id": 12, "subject": "u"}), "rows")
    # the key's period is held by a measured row: the check stands, the promotion is refused
    assert _pass(spark, store, checks, "one", 1, [(10, "r", "c1", None), (11, "r", "c1", None)], HELD, limit=2) == {10: ("confirmed", None, False, "no_two_live_contradictions"), 11: ("confirmed", None, True, None)}
    assert _pass(spark, store, checks, "two", 2, [], HELD, limit=2) == {12: ("unresolvable", "no_commit_in_evidence", False, None)}


def test_empty_pass(spark, tmp_path):
    store, checks = _both(spark, tmp_path)
    assert _pass(spark, store, checks, "one", 1, [], []) == {}
    assert checks.rows().count() == store.assertions().count() == 0


def test_of_two_writers_one_commits_and_the_other_looks_again(spark, tmp_path):
    table, other = (appended.Appended(spark, str(tmp_path / "t"), "id long, supersedes long") for _ in range(2))
    one = spark.createDataFrame([(1, None)], "id long, supersedes long")
    seen = []

    def next_of(had):
        seen.append(had.count())
        if len(seen) == 1:
            other.append(one, "theirs")
        return spark.createDataFrame([(2, 1 if seen[-1] else None)], "id long, supersedes long")

    assert [tuple(r) for r in table.append(next_of, "mine").collect()] == [(2, 1)] and seen == [0, 1]
    assert [r["id"] for r in appended.in_force(table.rows()).collect()] == [2]
    assert table.batch("none") is None and table.append(one, "mine").count() == 1 and table.rows().count() == 2


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbered(spark, n):
    rows = spark.range(0, n).select((F.col("id") * 37 % 1009).alias("k"))
    got = sorted((r["k"], r["i"]) for r in appended.numbered(rows, "k", "i", 5).collect())
    assert got == [(k, 5 + i) for i, k in enumerate(sorted(x * 37 % 1009 for x in range(n)))]

"""Preferences over several promotions, rejections and failures, and what makes two corrections one."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import people, preferences, writes
from factloom.plans import passes

DAY = datetime.datetime(2024, 1, 1)


def _said(spark, *rows):
    """Feedback: (signature, actor, value) in order, in one scope."""
    return spark.createDataFrame([(i, "a/b", s, who, v, DAY + datetime.timedelta(days=i)) for i, (s, who, v) in enumerate(rows)], "id long, scope string, signature string, actor string, value string, created_at timestamp_ntz")


def _rows(prefs):
    return {r["signature"]: (r["tier"], r["occasions"], r["humans"], r["binding"], r["status"]) for r in prefs.rows().collect()}


def test_promotions_rejections_and_failures(spark, tmp_path, monkeypatch):
    store = writes.Store(spark, str(tmp_path / "store"), passes._VERIFIED)
    prefs = preferences.Preferences(store, str(tmp_path / "prefs"))
    early = [("tabs", "ada", "x"), ("tabs", "ada", "y"), ("once", "ada", "x"), ("no", "ada", None), ("no", "bob", None)]
    with monkeypatch.context() as m:
        m.setattr(store, "append", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            prefs.promote(_said(spark, *early), "one")
    assert prefs.plans.rows().count() == 2 and _rows(prefs) == {}  # not in force without their assertions
    first = {r["signature"]: r for r in prefs.promote(_said(spark, *early), "one").collect()}
    assert {s: r["refused"] for s, r in first.items()} == {"tabs": None, "no": None}
    assert _rows(prefs) == {"tabs": ("personal", 2, 1, False, "active"), "no": ("team", 2, 2, False, "active")}
    prefs.decide(spark.createDataFrame([(first["no"]["id"], "rejected", DAY)], preferences.DECISIONS), "no")
    late = [*early, ("tabs", "bob", "z"), ("tabs", "eve", "z"), ("no", "eve", "x")]
    assert {r["signature"] for r in prefs.promote(_said(spark, *late), "two").collect()} == {"tabs"}
    assert _rows(prefs) == {"tabs": ("org", 4, 3, True, "active"), "no": ("team", 2, 2, False, "rejected")}
    # nothing new, and a lower tier, change nothing
    assert prefs.promote(_said(spark, *late), "three").count() == 0 and prefs.promote(_said(spark, *early), "four").count() == 0
    led = {r["id"]: r for r in store.assertions().collect()}
    top = led[max(led)]
    assert (top["subject"], top["predicate"], top["confidence"], top["human"], top["value"]) == ("preference:tabs", "prefers", "confirmed-by-human", "ada", 4.0)
    assert led[top["supersedes"]]["superseded_by"] == top["id"] and len(led) == 3 and store.tampered() == []


def test_signatures(spark):
    same = [("Sub|x", "p", '{"b": [1, " A  b\\n"], "a": {"X": null, "y": true}}'), (" sub|X ", "P", '{"a":{"y":true,"x":null},"B":[1.0,"a b"]}'), ("Ｓub|x", "p", '{"a":{"y":true,"x":null},"b":[1,"ａ b"]}')]
    other = [("sub", "x|p", same[0][2]), ("sub|x", "p", '{"b": ["a b", 1], "a": {"x": null, "y": true}}'), ("sub\\|x", "p", same[0][2]), ("sub|x", "p", '"a"'), ("sub|x", "p", "{}")]
    bad = [(None, "p", "{}"), ("s", None, "{}"), ("s", "p", None), ("s", "p", "{no"), ("s", "p", "")]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(same + other + bad)], "i int, s string, p string, c string")
    got = [r["x"] for r in rows.select("i", preferences.signature(F.col("s"), F.col("p"), F.col("c")).alias("x")).orderBy("i").collect()]
    assert len(set(got[:3])) == 1 and got[0].startswith("sub\\|x|p|") and len(set(got[2:8])) == 6 and got[8:] == [None] * 5
    assert preferences.canonical(json.loads('{"b":"É","a":[1e2,0.5,-1]}')) == '{"a":[100,0.5,-1],"b":"é"}'


def test_reports_move_heartbeats_on(spark):
    nodes = spark.createDataFrame([(1, "a", DAY), (2, "b", None), (3, "c", DAY), (4, "d", None)], "node_id long, label string, heartbeat_at timestamp_ntz")
    said = spark.createDataFrame([(1, DAY - datetime.timedelta(1)), (2, DAY), (3, DAY + datetime.timedelta(1)), (3, DAY), (9, DAY), (None, DAY)], "node_id long, occurred_at timestamp_ntz")
    got = {r["node_id"]: r["heartbeat_at"] for r in people.reported(nodes, said).collect()}
    assert got == {1: DAY, 2: DAY, 3: DAY + datetime.timedelta(1), 4: None}

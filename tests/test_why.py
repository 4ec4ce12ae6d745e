"""Why code is as it is: excerpts against a plain loop, resolution, ambiguity and notes."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import why

DAY = datetime.datetime(2024, 1, 1)


def _excerpt(text, needles):
    """The excerpt as plain Python."""
    flat = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
    spans = [m.span() for m in (re.search(why.pattern([n]), flat) for n in needles) if m]
    at, hit = min(((a, b - a) for a, b in spans), key=lambda x: x[0], default=(0, 0))
    start = max(0, at - why.LEAD)
    end = max(min(len(flat), start + why.EXCERPT), min(len(flat), at + hit))
    if start > 0 and 0 <= flat.find(" ", start) < at:
        start = flat.find(" ", start) + 1
    if end < len(flat) and flat.rfind(" ", 0, end + 1) > at + hit:
        end = flat.rfind(" ", 0, end + 1)
    return ("…" if start > 0 else "") + flat[start:end].strip(" ") + ("…" if end < len(flat) else "")


def test_excerpts(spark):
    rng = random.Random(3)
    words = ["a", "gemv", "gemv_wide", "src/a.rs", "xsrc/a.rs", "é" * 30, "long" * 20, "\n", "\t", "...", "b" * 300]
    texts = ["", " ", "gemv", "x" * 500 + " gemv " + "y" * 500, "gemv" * 100, "gemv " * 100] + [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(300)]
    needles = ["gemv", "src/a.rs", "..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", why.excerpt(F.col("text"), needles).alias("x")).collect()
    for r in rows:
        assert r["x"] == _excerpt(texts[r["id"]], needles), texts[r["id"]]
    assert spark.range(1).select(why.excerpt(F.lit(None).cast("string"), needles)).first()[0] is None


def _turns(spark, *texts):
    return spark.createDataFrame([(i, 1, i, DAY + datetime.timedelta(minutes=i), x) for i, x in enumerate(texts)], "id long, session long, seq long, occurred_at timestamp, text string")


def _facts(spark, *rows):
    return spark.createDataFrame([(i, i, *r) for i, r in enumerate(rows)], "id long, asserted_at long, scope string, subject string, predicate string, confidence string, source string, superseded_by long")


def _code(spark, symbols, indexes=((1, "r", "c1", "a", 1, True),)):
    return spark.createDataFrame(symbols, "index_id long, name string, fqn string, path string, line_start long"), spark.createDataFrame(list(indexes), "index_id long, repo string, commit_sha string, scope string, indexed_at long, completed boolean")


def test_path_before_basename_and_facts_of_the_chain(spark):
    turns = _turns(spark, "see mod.rs", "src/x/mod.rs is slow", "another/mod.rs here", "amod.rs", None, "SRC/X/MOD.RS again")
    led = _facts(spark, ("a/b", "src/x/mod.rs", "p", "measured", "x", None), ("a", "s", "p", "measured", "bench of mod.rs", None), ("a", "mod.rs", "p", "measured", "x", 9), ("z", "mod.rs", "p", "measured", "x", None), ("a", None, "p", "measured", None, None))
    r = why.why_path(turns, led, "./src/x/mod.rs/", ["a/b", "a"]).first()
    assert (r["target"], r["resolved"]["kind"], r["resolved"]["path"]) == ("src/x/mod.rs", "path", "src/x/mod.rs")
    assert [(m["id"], m["why"]) for m in r["mentions"]] == [(5, "path"), (1, "path"), (2, "basename"), (0, "basename")]
    assert [f["id"] for f in r["facts"]] == [0, 1] and r["note"].startswith("2 of 4")
    assert [m["id"] for m in why.why_path(turns, led, "src/x/mod.rs", ["a"], 1).first()["mentions"]] == [5]
    silent = why.why_path(turns, led, "nothing.py", ["a"]).first()
    assert silent["mentions"] == silent["facts"] == [] and "nothing.py" in silent["note"]
    assert why.why_path(_turns(spark), _facts(spark), "x", ["a"]).first()["note"]
    for bad in ("", " / "):
        with pytest.raises(ValueError):
            why.why_path(turns, led, bad, ["a"])
    with pytest.raises(ValueError):
        why.why_path(turns, led, "x", ["a"], 0)


def test_symbols_are_resolved_or_left(spark):
    turns, led = _turns(spark, "gemv is odd", "k::gemv was chosen", "src/g.rs", "g.rs", "gemv_wide"), _facts(spark, ("a", "gemv", "p", "measured", "x", None))
    symbols, indexes = _code(spark, [(1, "gemv", "k::gemv", "src/g.rs", 7), (1, "dup", "k::dup", "src/a.rs", 1), (1, "dup", "l::dup", "src/b.rs", 2), (0, "old", "k::old", "src/o.rs", 3), (2, "young", None, "src/y.rs", 4)], [(1, "r", "c1", "a/code", 2, True), (0, "r", "c0", "a", 1, True), (2, "r", "c2", "a", 3, False)])
    ask = lambda s, **k: why.why_symbol(turns, led, symbols, indexes, s, ["a"], **k).first()
    r = ask("gemv")
    assert r["resolved"].asDict() == {"kind": "symbol", "path": "src/g.rs", "fqn": "k::gemv", "line_start": 7}
    assert [(m["id"], m["why"]) for m in r["mentions"]] == [(1, "symbol"), (0, "symbol"), (2, "path"), (3, "basename")] and [f["id"] for f in r["facts"]] == [0]
    assert ask("k::gemv")["resolved"]["path"] == "src/g.rs"
    several = ask("dup")
    assert several["resolved"] is None and "src/a.rs:1, src/b.rs:2" in several["note"]
    assert ask("l::dup")["resolved"]["path"] == "src/b.rs"
    # the older index and the one not completed are not asked
    for gone in ("old", "young", "never"):
        assert ask(gone)["resolved"] is None and "No completed index" in ask(gone, repo="r")["note"]
    assert ask("gemv", repo="q")["resolved"] is None


def test_more_candidates_than_are_told_apart(spark):
    symbols, indexes = _code(spark, [(1, "f", f"m{i}::f", f"src/{i:03}.rs", i) for i in range(300)])
    note = why.why_symbol(_turns(spark, "f"), _facts(spark), symbols, indexes, "f", ["a"]).first()["note"]
    assert "over 200" in note and note.count(".rs:") == why.NAMED and "…" in note

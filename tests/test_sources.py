"""Seeds, code graphs, prose files and the index of episodes: loads, refusals, and what an unfinished load shows."""

import datetime
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import doctrine, episodes, recall, similar, writes
from factloom.plans import answers
from factloom.sources import graphs, log, prose_files, seeds

DAY = datetime.datetime(2024, 1, 1)


# --- seeds


def _seed_file(tmp_path, rows):
    path = tmp_path / "seed.json"
    good = dict(scope="a/b", predicate="p", kind="state", source="x", value=1.0)
    path.write_text(json.dumps({"assertions": [good | r for r in rows]}, indent=1))
    return str(path)


def test_seed_goes_in_the_order_of_its_supersessions(spark, tmp_path):
    rows = [
        {"ref": "c", "supersedes_ref": "b", "subject": "s", "value": 3.0},
        {"ref": "b", "supersedes_ref": "a", "subject": "s", "value": 2.0},
        {"ref": "a", "subject": "s"},
        {"ref": "d", "supersedes_ref": "nowhere", "subject": "t"},
        {"ref": "e", "supersedes_ref": "d", "subject": "t"},
        {"ref": "f", "subject": "u", "source": " "},
        {"ref": "g", "supersedes_ref": "f", "subject": "u"},
        {"ref": "h", "supersedes_ref": "h", "subject": "v"},
        {"subject": "w", "confidence": "measured"},
        {"supersedes_ref": "a", "subject": "x"},
    ]
    store = writes.Store(spark, str(tmp_path / "store"), answers._SEED_SCHEMA)
    report = seeds.load(store, seeds.read(spark, _seed_file(tmp_path, rows)), "seed", 100)
    got = {r["place"]: r["reason"] for r in report.rows.collect()}
    missing = 'supersedes_ref "{}" was not loaded'.format
    assert got == {0: None, 1: None, 2: None, 3: missing("nowhere"), 4: missing("d"), 5: "evidence_required", 6: missing("f"), 7: missing("h"), 8: "confidence_is_earned", 9: "supersedes_target_already_superseded"}
    led = {r["id"]: (r["superseded_by"], r["chain"], r["place"]) for r in store.assertions().collect()}
    assert led == {102: (101, 102, 0), 101: (100, 102, 1), 100: (None, 102, 2)}
    assert report.loaded() == 3 and {r["kind"]: r["n"] for r in report.by("kind").collect()} == {"state": 3} and report.skipped().count() == 7
    # the same load again changes nothing; under another name its rows are on record already
    assert seeds.load(store, seeds.read(spark, _seed_file(tmp_path, rows)), "seed", 100).loaded() == 3
    again = seeds.load(store, seeds.read(spark, _seed_file(tmp_path, rows[:3])), "other", 500)
    assert {r["place"]: r["id"] for r in again.rows.collect()}[2] == 102 and store.assertions().count() == 3


def _executions(seen):
    found = seen.executionsList()
    return [found.apply(i) for i in range(found.size())]


def test_seed_load_broadcasts_no_rows(spark, tmp_path):
    """Both sides of a load's joins grow with the seed."""
    rows = [{"ref": f"r{k}", "supersedes_ref": f"r{k - 1}" if k % 3 else None, "subject": f"s{k // 3}", "source": " " if k == 4 else "x"} for k in range(12)]
    store = writes.Store(spark, str(tmp_path / "store"), answers._SEED_SCHEMA)
    seen = spark._jsparkSession.sharedState().statusStore()
    before = {e.executionId() for e in _executions(seen)}
    got = {r["place"]: r["reason"] for r in seeds.load(store, seeds.read(spark, _seed_file(tmp_path, rows)), "seed", 1).rows.collect()}
    assert {k: v for k, v in got.items() if v} == {4: "evidence_required", 5: 'supersedes_ref "r4" was not loaded'} and len(got) == 12
    plans = [e.physicalPlanDescription() for e in _executions(seen) if e.executionId() not in before]
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_seed_with_a_cycle_is_refused(spark, tmp_path):
    rows = [{"ref": r, "supersedes_ref": u, "subject": "s"} for r, u in (("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None))]
    with pytest.raises(seeds.Cycle, match="a"):
        seeds.layered(seeds.read(spark, _seed_file(tmp_path, rows)))


def test_seed_layers_of_a_long_chain(spark):
    rng = random.Random(3)
    places = list(range(200))
    rng.shuffle(places)
    rows = [(p, f"r{k}", f"r{k - 1}" if k else None) for k, p in enumerate(places)]
    out = seeds.layered(spark.createDataFrame(rows, "place int, ref string, supersedes_ref string"))
    assert {r["ref"]: r["layer"] for r in out.collect()} == {f"r{k}": k for k in range(200)}
    assert seeds.layered(spark.createDataFrame([], "place int, ref string, supersedes_ref string")).count() == 0


# --- code graphs


def _artifact(**changes):
    symbol = lambda k, **c: {"key": k, "kind": "function", "name": k, "language": "rust", "path": "a.rs", "line_start": 1, "line_end": 2} | c
    edge = lambda s, d, **c: {"src": s, "dst": d, "dst_name": d or "x", "kind": "calls", "resolution": "unique-name", "path": "a.rs", "line": 3} | c
    return {
        "version": 1, "repo": "acme/code", "commit_sha": "0123abcd", "indexer": "ix", "languages": ["rust", "c"], "file_count": 1,
        "symbols": [symbol("f"), symbol("g"), symbol("two words")],
        "edges": [edge("f", "g"), edge("f", None, resolution="unresolved"), edge("g", None, resolution="ambiguous-name", candidates=["f", "g"])],
    } | changes


def _read(spark, tmp_path, artifact, name="g.json"):
    path = tmp_path / name
    data = json.dumps(artifact).encode()
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return graphs.read(spark, str(path))


def test_graph_artifact_plain_and_gzipped(spark, tmp_path):
    store = graphs.Graphs(spark, str(tmp_path / "graphs"))
    entry = store.load(_read(spark, tmp_path, _artifact()), "org/acme")
    assert (entry["symbols"], entry["edges"]["rows"], entry["silent"], entry["odd_names"]) == (3, 4, ["c"], 1)
    assert (entry["edges"]["derived"], entry["edges"]["unverified"], entry["edges"]["without_target"]) == (1, 3, 1)
    second = store.load(_read(spark, tmp_path, _artifact(commit_sha="feedface"), "g.json.gz"))
    ids = [r["id"] for r in store.symbols().collect()]
    assert sorted(ids) == list(range(1, 7)) and second["version"] == 2
    assert store.latest("acme/code")["commit_sha"] == "feedface" and store.latest("acme/code", "0123")["version"] == 1 and store.latest("other") is None
    names = {r["id"]: r["key"] for r in store.symbols(second).collect()}
    assert {(names[r["src"]], names.get(r["dst"]), r["confidence"]) for r in store.edges(second).collect()} == {("f", "g", "derived"), ("f", None, "unverified"), ("g", "f", "unverified"), ("g", "g", "unverified")}


BAD = [
    ("version_known", {"version": 2}), ("repo_present", {"repo": ""}), ("indexer_present", {"indexer": None}), ("commit_shape", {"commit_sha": "XYZ"}),
    ("duplicate_keys", {"symbols": _artifact()["symbols"] + _artifact()["symbols"][:2]}), ("unknown_keys", {"symbols": _artifact()["symbols"][:1]}), ("kind_known", {"symbols": [_artifact()["symbols"][0] | {"kind": "thing"}]}),
    ("ambiguous_needs_candidates", {"edges": [_artifact()["edges"][2] | {"candidates": ["f"]}]}), ("resolution_known", {"edges": [_artifact()["edges"][0] | {"resolution": "luck"}]}),
]


@pytest.mark.parametrize(("reason", "change"), BAD)
def test_graph_artifacts_that_are_refused_leave_nothing(spark, tmp_path, reason, change):
    store = graphs.Graphs(spark, str(tmp_path / "graphs"))
    with pytest.raises(graphs.Refused) as told:
        store.load(_read(spark, tmp_path, _artifact(**change)))
    assert told.value.reason == reason and store.indexes() == [] and store.symbols().count() == store.edges().count() == 0
    if reason == "duplicate_keys":
        assert told.value.detail == {"keys": ["f", "g"], "n": 2}
    if reason == "unknown_keys":
        assert told.value.detail == {"keys": ["g"], "n": 1}


def test_an_unfinished_load_is_invisible_and_a_twin_is_refused(spark, tmp_path):
    store = graphs.Graphs(spark, str(tmp_path / "graphs"))
    real = store.log.commit

    def lost(_):
        raise OSError("gone")

    store.log.commit = lost
    with pytest.raises(OSError):
        store.load(_read(spark, tmp_path, _artifact()))
    assert store.indexes() == [] and store.symbols().count() == 0
    store.log.commit = real
    assert store.load(_read(spark, tmp_path, _artifact()))["version"] == 1
    with pytest.raises(graphs.Refused) as told:
        store.load(_read(spark, tmp_path, _artifact()))
    assert told.value.reason == "index_exists" and told.value.detail == {"index_id": 1}


def test_graphs_keep_the_newest(spark, tmp_path):
    store = graphs.Graphs(spark, str(tmp_path / "graphs"))
    for k in range(4):
        last = store.load(_read(spark, tmp_path, _artifact(commit_sha=f"aaaaaa{k}")), keep=2)
    assert [c["commit_sha"] for c in store.indexes()] == ["aaaaaa2", "aaaaaa3"] and len(last["pruned_now"]) == 1
    assert store.symbols().count() == 6 and store.prune("acme/code", 0) != [] and len(store.indexes()) == 1


# --- prose files


def test_budget_of_files_is_a_walk(spark):
    rng = random.Random(5)
    for budget, each in ((5000, 100), (300, 37), (0, 10), (10**6, 1000), (50, 1)):
        files = [(f"p{rng.randrange(10**6):07d}-{k}", rng.choice([0, 3, 40, 90, 400, 2000])) for k in range(1000 if each > 1 else 30)]
        left, want = budget, set()
        for path, size in sorted(files):
            if left <= 0:
                break
            if size <= left:
                want.add(path)
                left -= size
        got = prose_files.chosen(spark.createDataFrame(files, "path string, size long").repartition(4), budget, each)
        assert {r["path"] for r in got.collect()} == want


def test_prose_files_are_found_once_and_read_as_lines(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_bytes(b"one\r\ntwo\n\nlast")
    (tmp_path / "docs" / "sub" / "b.TXT").write_bytes(b"x")
    (tmp_path / "docs" / "c.rs").write_bytes(b"fn main() {}")
    (tmp_path / "docs" / "bad.md").write_bytes(b"\xff\xfe broken")
    files = prose_files.found(spark, [str(tmp_path / "docs"), str(tmp_path / "docs" / "sub")])
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.md", "b.TXT", "bad.md"]
    rows = prose_files.lines(spark, files).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["line"], r["text"]) for r in rows) == [("a.md", 1, "one"), ("a.md", 2, "two"), ("a.md", 3, ""), ("a.md", 4, "last"), ("b.TXT", 1, "x")]


# --- recall


TURNS = [
    (1, 1, 0, "human", "we logged in on B1 at 16.57"), (2, 1, 1, "agent", "The batch took 1,400 ms on qtip2b"), (3, 1, 2, "human", "what about login?"), (4, 2, 0, "human", "nothing here"), (5, 2, 1, "agent", "foo/bar_baz: the batch ran, the batch ended"), (6, 3, 0, "human", "x" * 900 + " batch"),
]


def _turns(spark):
    rows = [(i, s, q, r, x, DAY + datetime.timedelta(hours=i), 0, None) for i, s, q, r, x in TURNS]
    return spark.createDataFrame(rows, "id long, session long, seq long, role string, text string, occurred_at timestamp_ntz, actor long, branch string")


@pytest.mark.parametrize("question", ["what of batch-1 and the batch?", "login", "1400", "bar_baz foo/bar", "zzz", "the of"])
@pytest.mark.parametrize("window", [None, (1, 4), (50, 60)])
def test_index_answers_as_a_scan_does(spark, tmp_path, question, window):
    turns = _turns(spark)
    index = recall.Index(spark, str(tmp_path / "index"))
    assert index.ingest(turns.where("id < 4"), "one") == 3 and index.ingest(turns, "two") == 3 and index.ingest(turns, "two") == 3
    span = window and tuple(F.lit(DAY + datetime.timedelta(hours=h)).cast("timestamp_ntz") for h in window)
    keep = ["id", "session", "seq", "occurred_at", "matched", "score", "tier"]
    want = episodes.recalled(turns, question, span).select(*keep).collect()
    assert index.recalled(question, span).hits.select(*keep).collect() == want


def test_index_reads_no_text_and_notes_say_what_was_done(spark, tmp_path):
    turns, index = _turns(spark), recall.Index(spark, str(tmp_path / "index"))
    assert index.recalled("batch").note() == "absent from corpus: batch; no usable terms and no date in the question" and index.recalled("batch").hits.count() == 0
    index.ingest(turns, "all")
    answer = index.recalled("login batch-1 zzz")
    assert "text" not in {a for c in index.TABLES.values() for a in c.split()} and [p["via"] for p in answer.plan if p["probe"] == "b1"] == ["abbrev"]
    assert answer.note().endswith("absent from corpus: zzz") and "batch-1->b1[abbrev]" in answer.note()
    assert {r["id"] for r in answer.nearby(turns).where("hit = 3").collect()} == {2}
    assert answer.texts(turns).where("id = 3").first()["text"] == "what about login?"
    span = tuple(F.lit(DAY + datetime.timedelta(hours=h)).cast("timestamp_ntz") for h in (1, 4))
    assert index.recalled("zzz", span).note("that day") == "window that day; absent from corpus: zzz; no term matched - this is all 3 said in that window"
    later = tuple(F.lit(DAY + datetime.timedelta(days=d)).cast("timestamp_ntz") for d in (90, 91))
    assert "that window was empty" in index.recalled("batch", later).note()


def test_spellings_of_terms():
    forms = lambda t: dict(episodes.variants(t))
    assert forms("batch-1") == {"batch-1": "exact", "batch1": "abbrev", "b1": "abbrev", "batch": "split"}
    assert forms("fp8") == {"fp8": "exact", "fp-8": "abbrev"}
    assert forms("1,400") == {"1,400": "exact", "1400": "numeric"} and forms("757.5") == {"757.5": "exact", "757.50": "numeric"}
    assert forms("login")["log"] == "stem" and forms("logged")["log"] == "stem" and "tra" not in forms("train") and forms("status") == {"status": "exact"}
    assert episodes.content_terms("What did you say on 14 Aug about the 3rd qtip2b_gemm?") == ["say", "qtip2b_gemm"]


# --- trigrams, doctrine, the log


def test_similarity_is_that_of_the_best_stretch(spark):
    rng = random.Random(6)
    words = ["data", "date", "base", "the", "bat", "databse", "eror", "error", "term"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "...", "two words"]

    def brute(needle, text):
        want, grams = set(similar.trigrams_of(needle)), similar.trigrams_of(text or "")
        return max((len(want & set(grams[i:j])) / len(want | set(grams[i:j])) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)), default=0.0)

    assert abs(brute("word", "two words") - 0.8) < 1e-9
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for needle in ("databas error", "word", "tha dat"):
        got = {r["id"]: r["similarity"] for r in similar.similar(rows, needle).collect()}
        want = {i: s for i, x in enumerate(texts) if (s := brute(needle, x)) >= similar.THRESHOLD}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert similar.similar(rows, "...").count() == 0


def test_python_gets_the_words_of_texts_and_no_lists_of_trigrams(spark):
    rows = spark.createDataFrame([(1, "A Databse, eror\u00e9"), (2, "\u0130x databas_error")], "id long, text string")
    found = similar.similar(rows, "databas error")
    assert found._jdf.queryExecution().analyzed().children().apply(0).schema().simpleString() == "struct<id:bigint,_w:string>"
    assert {r["id"]: round(r["similarity"], 4) for r in found.collect()} == {2: 1.0}


def test_words_are_cut_once_a_turn(spark):
    """Not in the lambda, once for every shingle, which takes time with the square of a turn's length."""
    turns = spark.createDataFrame([(1, 1, 1, "agent", "a b c d e f g h i j k l m n"), (2, 1, 2, "human", "b c d e f g h i j k l m n o")], "id long, session long, seq long, role string, text string")
    found = episodes.quoted(turns, 10, 2)
    assert "slice(filter(split" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(2, 5, 4)]


def test_doctrine_is_about_the_nearest_token(spark):
    text = ["Build `--features \"cuda flash-attn\"`; never `cudnn` in CI.", "`greedy` is banned.", "It has never been `run`.", "~~Never use `old`~~ now.", "NO DEGRADED ARTIFACTS", "You must be careful.", "Set W=256 or it must not bake, e.g. Never."]
    rows = spark.createDataFrame([(1, 2 * k + 1, x) for k, x in enumerate(text)], "doc_id long, line long, text string")
    said = doctrine.sentences(doctrine.blocks(rows)).withColumn("path", F.lit("docs/doctrine.md"))
    got = {r["line"]: (r["target"], r["strength"], r["enforced"]) for r in doctrine.scan(said, doctrine.corpus(spark.createDataFrame([("deny greedy/x", True), ("cudnn", False)], "text string, binding boolean"))).collect()}
    assert got == {1: ("cudnn", "absolute", False), 3: ("greedy", "absolute", True), 9: ("degraded", "prohibition", False), 13: ("w=256", "absolute", False)}
    found = doctrine.findings(doctrine.scan(said, spark.createDataFrame([], "token string")))
    assert [r["subject"] for r in doctrine.to_record(found, "a", 1).orderBy("id").collect()][0] == "cudnn"


def test_a_version_is_committed_once(spark, tmp_path):
    first, second = log.Log(spark, str(tmp_path / "log")), log.Log(spark, str(tmp_path / "log"))
    assert first.commits() == []
    first.commit({"version": 1, "by": "first"})
    with pytest.raises(log.Conflict):
        second.commit({"version": 1, "by": "second"})
    second.commit({"version": 2, "by": "second"})
    assert [c["by"] for c in first.commits()] == ["first", "second"]

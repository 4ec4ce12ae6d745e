"""Periodic runs, prefix-free parsing and fill-in-middle against brute force on odd cases and on the given documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import infill, parsing, periods, queries
from factloom.llm.common import table
from tests.llm import cases
from tests.oracle import assert_same, connection

SMALL = "/root/testdata/sf0.001"
ROWS = cases.documents()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return cases.write_documents(tmp_path_factory.mktemp("odd"), ROWS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _given(spark) -> list[tuple]:
    return [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]


# --- periodic runs


def brute_runs(w: list) -> list[tuple]:
    """start, length and period of all runs, each lag tried; a period is kept if no smaller one fits its stretch."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periods(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text, *_ in rows:
        w = cases.WORD.findall(text or "")
        if doc_id is not None and w:
            h = zlib.crc32(str(doc_id).encode())
            if h % 10 == 0:
                g, n = h // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        found = brute_runs(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        out.append((doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, _sha(lines), _sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


PERIODIC = [
    (1, "a b " * 30, None), (2, "x " * 6, None), (3, "x " * 5, None), (4, "a a a b " * 5 + "a a", None), (5, "q " + "a b c " * 4 + "r", None), (6, "q " + "a b c " * 3 + "a b r", None),
    (7, "k " * 400 + "a b c d " * 50, None), (8, ("u " * 9 + "v ") * 7, None), (9, None, None), (10, "", None), (11, "a b a b a b a b c a b a b a b a b", None), (None, "z " * 40, None), (7, "k " * 400 + "a b c d " * 50, None),
]


def test_op11_periodic_texts(spark, tmp_path):
    rows = [(i, t, "en", s, 0) for i, t, s in PERIODIC]
    got = periods.op11_periods(spark, cases.write_documents(tmp_path, rows)).collect()
    cases.same(got, brute_periods(rows))


def test_op11_given_documents(spark):
    rows = [r for r in _given(spark)]
    got = {r[0]: tuple(r) for r in periods.op11_periods(spark, SMALL).collect()}
    few = [r for r in rows if r[1] is None or len(r[1]) < 4000 or zlib.crc32(str(r[0]).encode()) % 10 == 0 and len(r[1]) < 12_000]
    assert len(got) == len(rows) and len(few) > 150
    cases.same([got[r[0]] for r in few], brute_periods(few))


def test_op11_odd_cases(spark, odd):
    rows = [r for r in ROWS if r[1] is None or len(r[1]) < 20_000]
    got = [r for r in periods.op11_periods(spark, odd).collect() if r["doc_id"] not in (3, 4, 5)]
    cases.same(got, brute_periods([r for r in rows if r[0] not in (3, 4, 5)]))


def test_op11_counts_are_exact_for_heavy_and_light_words():
    rng = np.random.default_rng(1)
    texts = [np.minimum(rng.zipf(1.4, n), 500).astype(np.uint64) for n in (0, 1, 7, 300, 5000, 40)]
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    counts, base = periods.lag_counts(np.concatenate(texts), bounds)
    assert len(texts[4]) > 0 and np.bincount(texts[4].astype(int)).max() > periods._heavy(np.array([5000]))[0]
    for t, w in enumerate(texts):
        mine = counts[base[t] : base[t + 1]]
        assert all(mine[q] == (w[:-q] == w[q:]).sum() for q in range(1, len(w) // 4 + 1))


def test_op11_random_words_of_few_kinds():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(60))] for _ in range(4)]
        bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        found = periods.runs(np.array(sum(texts, []), dtype=np.uint64), bounds)
        got = [[] for _ in texts]
        for t, *r in zip(*(x.tolist() for x in found), strict=True):
            got[t].append(tuple(r))
        assert got == [brute_runs(t) for t in texts]


def test_op11_very_long_text(spark, tmp_path):
    rng = random.Random(2)
    block = [f"w{rng.randrange(900)}" for _ in range(700)]
    words = [f"v{rng.randrange(300)}" for _ in range(60_000)] + block * 5 + ["the"] * 3000
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    out = periods.periodic_runs(docs).first()
    assert (60_000, 3500, 700) in [tuple(r) for r in out["runs"]] and (63_500, 3000, 1) in [tuple(r) for r in out["runs"]]
    assert len(out["collapsed"].split()) == 60_700 + 1 - sum(r[1] - r[2] for r in out["runs"] if r[0] + r[1] <= 60_000)


def test_op11_hashes_that_deceive_are_found(monkeypatch, spark):
    monkeypatch.setattr(periods.Slice, "word_hashes", lambda self: np.zeros(len(self.starts), dtype=np.uint64))
    piece = next(periods.slices(__import__("pyarrow").array(["a b c d e f g h " * 5, "x x x x x x y"])))
    found = periods._exact(piece, *periods.joined_words(piece))
    assert [x.tolist() for x in found] == [[0, 1], [0, 0], [40, 6], [8, 1]]


# --- prefix-free parsing


def brute_parsing(rows: list[tuple]) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    texts = [(r[1] or "").encode() for r in rows]
    first: dict[bytes, int] = {}
    for r, t in zip(rows, texts, strict=True):
        if r[0] is not None:
            for i in range(len(t) - 49):
                k = t[i : i + 50]
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        if r[0] is not None:
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < r[0]:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_op12_odd_cases(spark, odd):
    cases.same(parsing.op12_parsing(spark, odd).collect(), brute_parsing(ROWS))


def test_op12_given_documents(spark):
    cases.same(parsing.op12_parsing(spark, SMALL).collect(), brute_parsing(_given(spark)))


def _repetitive() -> list[tuple]:
    """A passage among different words in every text, one of few kinds of letters, copies, cut passages, and ids that are not unique."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = [(k, f"{' '.join(word() for _ in range(12))} {passage} é{k} {' '.join(word() for _ in range(12))}") for k in range(150)]
    rows += [(k, "".join(rng.choice("ab") for _ in range(600))) for k in range(150, 160)]
    rows += [(160, "ab" * 900), (161, "ab" * 700 + "c"), (162, "a" * 3000), (163, "a" * 49), (164, "a" * 50), (165, passage[30:120]), (7, passage + " other row of this id"), (7, passage + " other row of this id"), (None, passage)]
    rows += [(200 + k, rows[3][1]) for k in range(30)] + [(-5, rows[4][1][40:200]), (166, "\0" * 120), (167, "\0" * 60 + "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("hot", "few"), [(64, 400_000), (1, 0)])
def test_op12_repetitive_texts(spark, monkeypatch, hot, few):
    """Also with every gram of a passage hot, and with all spans shuffled."""
    rows = _repetitive()
    monkeypatch.setattr(parsing, "HOT_SHARE", hot)
    out = parsing.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), few=few)
    cases.same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute_parsing(rows))


def test_op12_hot_grams_are_found(spark, monkeypatch):
    """A common string of 45 bytes among different words: its grams are minimisers of no other string, so no bucket gets all texts."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(k, f"{word()} {word()} {word()} the same string in every text of these {word()} {word()} {word()}") for k in range(4000)]
    monkeypatch.setattr(parsing, "HOT_SHARE", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0).cast("long"))
    assert parsing.repeated_bytes(docs).count() == 0
    data = np.frombuffer("".join(t for _, t in rows).encode(), dtype=np.uint8)
    grams, n = np.unique(parsing._hashes(parsing._sums(data), parsing.GRAM) >> np.uint64(1), return_counts=True)
    common = np.sort(grams[n > 3000])
    assert len(common) >= 20
    least = parsing._sliding_min(parsing.ranked(parsing._hashes(parsing._sums(data), parsing.GRAM), common), parsing.LENGTH - parsing.GRAM + 1)
    strings = least[np.concatenate(([True], least[1:] != least[:-1]))]
    assert np.unique(strings, return_counts=True)[1].max() < 600


def test_op12_phrases_hold_every_string_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in (0, 3, 49, 50, 51, 4000, 0, 700)]
    data, bounds = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, begin, own, end = parsing.phrases(parsing._hashes(parsing._sums(data), parsing.GRAM), bounds)
    assert len(begin) > 10
    covered = np.concatenate([np.arange(a, b) for a, b in zip(begin, own, strict=True)])
    assert covered.tolist() == list(range(len(data)))
    assert all(e == min(o + 49, bounds[t + 1]) and bounds[t] <= b for t, b, o, e in zip(text, begin, own, end, strict=True))


def test_op12_a_phrase_between_two_that_go_is_still_a_source(spark):
    """Strings across two phrases of smaller ids are the dictionary's."""
    rng = random.Random(12)
    parts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)) for _ in range(12)]
    rows = [(k, p) for k, p in enumerate(parts)]
    rows += [(100 + k, parts[k][rng.randrange(60) :] + parts[k + 1][: 240 + rng.randrange(60)]) for k in range(11)]
    rows += [(200 + k, rows[12 + k][1]) for k in range(11)] + [(300 + k, "x" + rows[12 + k][1][9:]) for k in range(11)]
    out = parsing.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    cases.same(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect(), brute_parsing(rows))


def test_op12_suffixes_are_in_order():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    at = np.append(rng.integers(0, 2950, 400), [7, 7, 7])
    doc = rng.integers(0, 9, len(at))
    by, new = parsing.suffixes(data, at, doc)
    keys = [(data[at[x] : at[x] + 50].tobytes(), doc[x]) for x in by]
    assert keys == sorted(keys) and [k for k, x in enumerate(new) if x] == [k for k in range(len(keys)) if not k or keys[k][0] != keys[k - 1][0]]


# --- fill-in-middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_infill(rows: list[tuple]) -> list[tuple]:
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        tokens = TOKEN.findall(text)
        h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        x, y, z, u = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
        a, b = sorted((x % (len(tokens) + 1), y % (len(tokens) + 1)))
        p, m, s = ("".join(tokens[i:j]) for i, j in ((0, a), (a, b), (b, None)))
        form = "plain" if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or z % 100 >= 50 else "spm" if u % 100 < 80 else "psm"
        made = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        out.append((doc_id, len(tokens), form, *((None, None) if form == "plain" else (len(p), len(m))), _sha(made), _sha(text)))
    return out


def test_op13_odd_cases(spark, odd):
    cases.same(infill.op13_infill(spark, odd).collect(), brute_infill(ROWS))


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_op13_chunks_of_any_size(spark, chunk):
    rows = [(k, t) for k, t in enumerate(["a", " a", "a ", "  ", "é\U0001f600 ü  ßx\n", "x <M> y", "<", "S> <P", "one two  three\t\n four ", "a b c d e f g h i j " * 9] * 6)] + [(None, "null id here"), (3, "same id"), (3, "same id"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = infill.fill_in_middle(docs, chunk=chunk).withColumn("back", F.sha2(infill.restored("output", "form"), 256))
    got = out.select("doc_id", "n_tokens", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), "back").collect()
    cases.same(got, brute_infill(rows))


def test_op13_draws_follow_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"))
    n = {r["form"]: r["count"] for r in infill.fill_in_middle(docs, rate=90, spm=25, seed=7).groupBy("form").count().collect()}
    assert 300 < n["plain"] < 500 and 800 < n["spm"] < 1000


def test_op13_very_long_text_of_many_lines(spark):
    rows = [(k, f"line {k} of text\n" * 30_000) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("mine"))
    out = infill.fill_in_middle(docs).withColumn("back", infill.restored("output", "form"))
    assert out.where("back <> text OR key <> 'mine'").count() == 0 and out.count() == 6
    cases.same([(r["doc_id"], r["n_tokens"], r["prefix_chars"]) for r in out.collect()], [(r[0], r[1], r[3]) for r in brute_infill(rows)])


def test_op13_against_sql(spark, odd):
    for d in (SMALL, odd):
        assert assert_same(infill.op13_infill(spark, d), connection(d), queries.ORACLES["op13_infill"]) > 100


# --- many lines, many matches


def test_op7_many_lines_in_seconds(spark):
    """A licence text far into a text of 16,000 lines; every line could begin a unit."""
    import time

    from factloom.llm import licenses

    rng = random.Random(4)
    gpl = dict(licenses.all_templates())["GPL-3"]
    junk = lambda n: "\n".join(f"w{rng.randrange(900)} the program v{rng.randrange(900)}" for _ in range(n))
    rows = [(1, junk(10)), (2, f"{junk(12_000)}\n{gpl}\n{junk(3_300)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    licenses.license_hits(docs.where("doc_id = 1")).count()
    began = time.time()
    found = {r["license"]: r for r in licenses.license_hits(docs).collect()}
    assert time.time() - began < 60
    first = 12_001 + next(i for i, x in enumerate(gpl.split("\n")) if re.search("[a-zA-Z0-9]", x))
    assert found["GPL-3"]["dice"] == 1.0 and found["GPL-3"]["first_line"] == first


def test_op9_many_matches(spark, tmp_path):
    from factloom.llm import secrets

    text = "\n".join(f"password = hunter{k:06d} AKIAABCDEFGH{k:08d} {k:032x}" for k in range(3000))
    rows = [(1, text, "en", "s", len(text))]
    got = secrets.op9_secrets(spark, cases.write_documents(tmp_path, rows)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    cases.same(got, cases.secrets(rows))


def test_op3_many_lines(spark, tmp_path):
    from factloom.llm import quality

    rng = random.Random(8)
    text = "\n".join(f"w{rng.randrange(99)} x{rng.randrange(99)} y{rng.randrange(9999)}" for _ in range(20_000))
    rows = [(1, text, "en", "s", len(text)), (2, "a b c d e f g h i j k l", "en", "s", 0)]
    got = quality.op3_quality(spark, cases.write_documents(tmp_path, rows)).drop("n_removed_words").collect()
    cases.same(got, cases.quality(rows))


# --- repeated rows and clashing names of archives and vectors


def test_op8_clashing_columns_and_very_long_payloads(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from factloom.llm import warc

    long = "<p>" + "x\n" * 400_000
    rows = [(1, long), (2, long), (3, "y" * 1000), (4, "y" * 999), (5, "y" * 999), (6, None), (7, "")]
    columns = {"page_id": [i for i, _ in rows], "url": [f"http://h/{i}" for i, _ in rows], "html": [h for _, h in rows], **{c: [c] * len(rows) for c in ("payload", "digest", "type", "headers", "record_id", "n")}}
    pq.write_table(pa.table(columns), f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.op8_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()}
    n = len(long)
    assert got == {1: (n, "revisit", 2), 2: (n, "response", None), 3: (1000, "response", None), 4: (999, "response", None), 5: (999, "response", None), 6: (0, "response", None), 7: (0, "response", None)}


def test_op10_repeated_rows_count_once(spark):
    from factloom.llm import ann

    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=16)]) for i in range(60)]
    nearest = lambda x: sorted(map(tuple, ann.nearest(spark.createDataFrame(x, "vec_id long, embedding array<float>"), "vec_id", "embedding", lambda i: i % 20 == 0, k=5).collect()))
    once = nearest(rows)
    assert len(once) == 15 and nearest(rows + rows[:25] + rows[:3] + [(None, rows[0][1])]) == once

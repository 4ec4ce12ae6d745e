"""The pipeline stage by stage against brute-force versions of its decisions."""

from collections import Counter

import corpus_pipeline
from factloom.llm import pieces
from factloom.llm.common import table
from tests.llm import cases

ROWS = cases.documents()


def _stage(k, spark, docs, folder):
    return corpus_pipeline.STAGES[k][1](spark, docs, folder)


def test_stages_in_order_keep_the_columns(spark, tmp_path):
    folder = cases.write_documents(tmp_path, ROWS, extra=True)
    docs = table(spark, folder, "documents")
    before = {(r["doc_id"], r["text"]): r.asDict() for r in docs.collect()}
    want = docs.columns

    kept = _stage(0, spark, docs, folder)
    assert kept.columns == want and kept.schema == docs.schema
    verdicts = {(r[0], r[1]) for r, v in zip(ROWS, cases.quality(ROWS), strict=True) if v[7]}
    got = [r.asDict() for r in kept.collect()]
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((r[0] or -1) for r, v in zip(ROWS, cases.quality(ROWS), strict=True) if v[7])
    assert all("common footer" not in r["text"] for r in got)
    by_id = {k[0]: v for k, v in before.items()}
    assert all(r[c] == by_id[r["doc_id"]][c] for r in got for c in cases.CLASHING)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and verdicts

    once = _stage(1, spark, kept, folder)
    assert once.columns == want
    rows = [(r["doc_id"], r["text"]) for r in got]
    groups = Counter(c for _, n, c in cases.jaccard(rows) if n)
    assert once.count() == len(groups)
    assert {r["doc_id"] for r in once.collect()} == set(groups)

    clean = _stage(2, spark, once, folder)
    assert clean.columns == want and clean.count() == once.count()
    assert not any(v[1] + v[2] + v[3] for v in cases.secrets([(r["doc_id"], r["text"]) for r in clean.collect()]))

    mix = _stage(3, spark, clean, folder)
    assert mix.columns == want and mix.groupBy("doc_id").count().where("count > 3").count() == 0

    model = pieces.default_model()
    last = _stage(4, spark, mix, folder)
    assert last.count() == mix.count() and set(last.columns) >= {"doc_id", "ids", "n_pieces"}
    back = pieces.decoded(last.select("doc_id", "ids"), model).select("doc_id", "decoded").collect()
    assert last.where("round_trip").count() == last.count() and last.where("size(next_scores) = 3").count() > 0
    texts = {r["doc_id"]: r["text"] for r in mix.collect()}
    assert all(r["decoded"] == texts[r["doc_id"]] for r in back)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, cases.write_documents(tmp_path, [])).count() == 0


def test_given_documents(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0

"""The dataset build on a small corpus: what is left out, rows by family, negatives, report."""

import pytest

from tessera.operators import builds as B
from tessera.operators import training as TR

CORPUS = "doc long, title string, text string, metadata map<string,string>, twin string, codes array<int>, ordinal long, found string"
CANDS, LOGS, POOLS = "doc long, pos long, text string, found boolean", "doc long, qid long, text string, ts long", "doc long, row_id string, source string, other long, pos int"


@pytest.fixture(scope="module")
def made(spark):
    docs = [(i, f"Title {i}", f"text of document number {i} with some words", {"lang": "en", "chunk": "3", "none": None}, None, [i % 4, 0, 0, 0], i, "x") for i in range(60)]
    docs[3] = (3, None, None, None, "same", [3, 0, 0, 0], 3, "x")
    docs[4] = (4, "", "", {"chunk": "1"}, "same", [0, 0, 0, 0], 4, "x")
    corpus = spark.createDataFrame(docs, CORPUS)
    held = {r.doc for r in corpus.where(TR.held_out(B.F.col("doc"))).collect()}
    out = min(held)
    a, b = [i for i in range(5, 60) if i not in held][:2]
    cands = [(a, 0, "how to open a gate", True), (a, 1, "How to  open a GATE", True), (a, 2, f"text of document number {a} with some words", True), (a, 3, "never found again", False), (out, 0, "kept from training", True), (999, 0, "no such document", True), (b, 0, None, True)]
    logs = [(a, 1, "early", 1), (a, 2, "late", 9), (a, 3, "no time", None), (out, 4, "held", 1), (999, 5, "gone", 1)]
    pools = [(a, None, "prefix_sibling", x, 0) for x in (a, b, 3, 999)] + [(a, "synthetic_query-0", "bm25", 4, 1), (3, None, "random", 4, 0), (3, None, "random", b, 0)]
    rows, report = B.build(corpus, spark.createDataFrame(cands, CANDS), spark.createDataFrame(logs, LOGS), spark.createDataFrame(pools, POOLS), before=B.F.lit(5), least=3)
    return {(r.doc_id, r.row_id): r for r in rows.collect()}, {r.name: r.value for r in report.collect()}, held, a, b


def test_rows(made):
    rows, report, held, a, b = made
    assert held and not {d for d, _ in rows} & held and report["held_out_docs"] == len(held)
    assert {k for d, k in rows if d == a} == {"title", "content_prefix", "metadata", "synthetic_query-0", "real_query-1"}
    assert {k for d, k in rows if d in (3, 4)} == {"content_prefix"}
    assert rows[a, "metadata"].input == "query: lang: en" and rows[a, "real_query-1"].input == "query: early"
    assert rows[a, "content_prefix"].input.startswith("document: text of document") and rows[3, "content_prefix"].input == "document: "
    assert (rows[a, "title"].codes, rows[a, "title"].ordinal) == ([a % 4, 0, 0, 0], a)
    assert (report["generated"], report["accepted"], report["duplicate"], report["leaked"], report["round_trip_failed"]) == (5, 2, 1, 1, 1)
    assert report["rows"] == len(rows) and report["units_below_floor"] == 2


def test_negatives_and_weights(made):
    rows, report, _, a, b = made
    assert [n.doc for n in rows[a, "title"].negatives] == [3, b]  # neither itself nor a document that is not there
    assert [n.doc for n in rows[a, "synthetic_query-0"].negatives] == [3, b, 4] and rows[a, "content_prefix"].negatives == []
    assert rows[3, "content_prefix"].negatives == []
    total = sum(r.weight for r in rows.values())
    for source, ratio in B.RATIOS.items():
        share = sum(r.weight for r in rows.values() if r.source == source) / total
        assert abs(share - ratio) < 1e-9 and abs(report[f"share_{source}"] - share) < 1e-5


def test_copies_are_no_negatives_and_empty_tables(spark):
    corpus = spark.createDataFrame([(3, "t", "x", None, "same", [0, 0, 0, 0], 0, "y"), (4, "t", "x", None, "same", [0, 0, 0, 0], 1, "y"), (5, "t", "x", None, None, [0, 0, 0, 0], 2, "y")], CORPUS)
    assert B.known(corpus).count() == 3
    none = [spark.createDataFrame([], s) for s in (CANDS, LOGS, POOLS)]
    pool = spark.createDataFrame([(3, None, "random", 4, 0), (3, None, "random", 5, 0)], POOLS)
    rows, report = B.build(corpus, none[0], none[1], pool)
    assert {(r.doc_id, r.source): [n.doc for n in r.negatives] for r in rows.collect()}[3, "title"] == [5]
    rows, report = B.build(corpus.limit(0), *none)
    assert rows.count() == 0 and {r.name: r.value for r in report.collect()}["rows"] == 0
    pairs = B.random_pool(corpus).collect()
    assert all(r.doc != r.other for r in pairs)

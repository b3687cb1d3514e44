"""The chain of a request, ingestion and artefacts on small tables."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import decode as D
from tessera.operators import quantize as Q
from tessera.operators import requests as A2
from tessera.plans import serving as S
from tessera.sources import artifacts as A


def _books(dim=6, k=4):
    r = np.random.default_rng(0)
    return [r.normal(size=(k, dim)) / (n + 1) for n in range(4)]


def test_hash_embedding(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "A  b, a")], "doc long, text string")
    got = {r.doc: r.vec for r in S.hash_embedding(docs, 8).collect()}
    assert got[1] == got[4] and got[2] == got[3] == [0.0] * 8
    assert math.fsum(x * x for x in got[1]) == pytest.approx(1.0)


def test_retrieve(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(r.choice(words, 12))) for i in range(40)]
    vec = r.normal(size=(40, 6))
    books = _books()
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)], "doc long, vec array<double>")
    issued = Q.allocate(Q.encode(v, books)).cache()
    k = F.col("doc")
    docs = issued.select("doc", "sid", F.when(k % 5 == 0, "TOMBSTONED").otherwise("ACTIVE_LEARNED").alias("state"), F.when(k % 7 == 0, "b").otherwise("a").alias("tenant"), F.array().cast("array<string>").alias("roles"), F.lit("v1").alias("schema"))
    b = A2.Backends(docs, spark.createDataFrame(texts, "doc_id long, text string"), issued, D.router(spark, books), D.DecodeConfig(beam=4, widened_beam=6))
    asked = spark.createDataFrame([(1, "w1 w2 w3", vec[1].tolist()), (2, '"w4 w5" w6', vec[2].tolist()), (3, "nothing known", vec[3].tolist())], "qid long, text string, vec array<double>")
    got = A2.answer(asked, b, A2.Policy(k=5))
    best, dropped = got.results, got.dropped
    rows = best.orderBy("qid", "rank").collect()
    by = {q: [x for x in rows if x.qid == q] for q in (1, 2, 3)}
    assert all([x.rank for x in by[q]] == list(range(1, len(by[q]) + 1)) and len(by[q]) <= 5 for q in by)
    assert all(x.doc % 5 and x.doc % 7 for x in rows)
    assert all(x.channel == "full_lexical" for x in by[2]) and all(x.channel == "generative" for x in by[3]) and by[2] and by[3]
    assert all(by[q][i].final >= by[q][i + 1].final for q in by for i in range(len(by[q]) - 1))
    assert {x.reason for x in dropped.select("reason").distinct().collect()} <= {"tombstoned", "acl"}
    assert A2.answer(asked.limit(0), b).results.count() == 0


def test_ingest(spark):
    long = "Plain words of prose and more of them. " * 20
    pages = spark.createDataFrame([(1, "a", long), (2, "a", long), (3, "b", long), (4, "a", "short"), (5, "a", None), (6, "a", "#" * 80)], "doc long, tenant string, text string")
    units, away = S.ingest(pages, _books(8))
    got = units.collect()
    assert {r.doc for r in got} == {1, 3} and len({r.sid for r in got}) == len(got)
    assert {(r.doc, r.reason) for r in away.collect()} == {(4, "too_short"), (5, "too_short"), (6, "mostly_symbols")}


def test_codebooks(spark, tmp_path):
    books = _books()
    digest = A.save_codebooks(spark, books, str(tmp_path), "v1", "s1")
    back, schema = A.load_codebooks(spark, str(tmp_path), "v1", digest)
    assert schema == "s1" and all((x == y).all() for x, y in zip(books, back, strict=True))
    with pytest.raises(ValueError, match="digest"):
        A.load_codebooks(spark, str(tmp_path), "v1", "other")
    with pytest.raises(Exception, match="exist"):
        A.save_codebooks(spark, books, str(tmp_path), "v1", "s1")


def test_tries(spark, tmp_path):
    r = np.random.default_rng(2)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(50, 6)))], "doc long, vec array<double>")
    issued = Q.allocate(Q.encode(v, _books())).cache()
    ok = A.publish_trie(issued, issued, str(tmp_path), "cs_1", "s1")
    assert ok["valid"] and ok["leaves"] == 50
    bad = A.publish_trie(issued.where("doc < 40"), issued, str(tmp_path), "cs_2", "s1")
    assert not bad["valid"] and bad["missing"] == 10
    trie = A.latest_trie(spark, str(tmp_path), "s1")
    assert trie.count() == 50 and Q.ids_digest(trie.repartition(7)).first()["digest"] == ok["digest"] != bad["digest"]
    with pytest.raises(ValueError, match="schema"):
        A.latest_trie(spark, str(tmp_path), "s2")
    one = issued.first()
    assert Q.find(issued, list(one.codes)).first().leaves >= 1 and Q.find(issued, [99]).count() == 0 and Q.find(issued, []).first().leaves == 50
    held = {x.sid: x.held for x in Q.contains(issued.where("doc < 40"), issued).collect()}
    assert sum(held.values()) == 40
    epochs = spark.createDataFrame([(7,), (9,)], "epoch long")
    assert [A.due(epochs, e, "2026-01-01 00:00:00", now, most=5).first().due for e, now in ((9, "2026-01-02 00:00:00"), (8, "2026-01-01 00:10:00"), (8, "2026-01-01 00:15:00"), (4, "2026-01-01 00:00:01"))] == [False, False, True, True]


def test_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i % 5}", [i, None]) for i in range(23)] + [(3, "t3", [3, None])], "n long, t string, a array<long>")
    wire = A.to_wire(rows)
    assert sorted(map(str, A.from_wire(wire, "n long, t string, a array<long>").collect())) == sorted(map(str, rows.collect()))
    b = A.batches(rows, 5, seed=1)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [4, 5, 5, 5, 5]
    again = A.batches(rows.repartition(7), 5, seed=1)
    key = lambda df: sorted((r.batch, r.n) for r in df.collect())
    assert key(b) == key(again) != key(A.batches(rows, 5, seed=1, epoch=1))
    assert A.batches(rows.limit(0), 5).count() == 0
    (tmp_path / "a.json").write_text('{"x": {"y": 1, "z": 2}, "w": [1]}')
    (tmp_path / "b.json").write_text('{"x": {"y": 5}, "w": [2]}')
    assert A.load_options(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")) == {"x": {"y": 5, "z": 2}, "w": [2]}
    c = spark.createDataFrame([("a", True), ("a", True), ("a", False), (None, True)], "text string, trusted boolean")
    assert sorted(r.uri.split("/")[0] for r in A.contents(c).collect()) == ["blobs", "quarantine"]


def test_hash_embedding_by_the_definition_and_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 3)
    r = np.random.default_rng(2)
    texts = ["", None, "...", "Ärger Straße x_1 ΑΣ 東京", *(" ".join(f"W{i}," for i in r.integers(0, 30, r.integers(1, 200))) for _ in range(20)), ""]
    got = S.hash_embedding(spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(2), 16)
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    got = {r.doc: r.vec for r in got.collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        want = [0] * 16
        for w in re.findall(r"\w+", (t or "").lower()):
            h = hashlib.sha256(w.encode()).hexdigest()
            want[int(h[:15], 16) % 16] += -1 if int(h[15], 16) % 2 else 1
        n = max(math.sqrt(sum(x * x for x in want)), 1e-9)
        assert got[i] == [x / n for x in want]

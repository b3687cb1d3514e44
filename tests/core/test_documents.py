"""Documents, requests and curation on small hand-made tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import curation as C
from tessera.operators import documents as G
from tessera.operators import retrieve as R
from tessera.plans import more as MORE
from tessera.plans import registry as REG


def _docs(spark):
    rows = [(i, "t", f"1.2.3.{i}.0", "v1", s, f"h{i}", "u", f"title{i}", "s", ["staff"] if i == 2 else [], {"chunk": str(9 - i)}, 7 if i < 3 else None, i, None) for i, s in enumerate(["ACTIVE_LEARNED", "ACTIVE_COLD_START", "ACTIVE_LEARNED", "TOMBSTONED", "QUARANTINED"])]
    return spark.createDataFrame(rows, G.empty_documents(spark).schema)


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc long")


def test_changes(spark):
    docs = _docs(spark)
    by = lambda df: {r.doc: r for r in df.collect()}
    assert by(G.set_state(docs, _ids(spark, 1, 3, 99), "LOW_COVERAGE"))[1].state == "LOW_COVERAGE"
    assert by(G.set_state(docs, _ids(spark, 3), "LOW_COVERAGE"))[3].state == "TOMBSTONED"
    dead = by(G.tombstone(docs, _ids(spark, 0, 2), "2026-01-02 00:00:00"))
    assert [dead[i].state for i in (0, 2)] == ["TOMBSTONED"] * 2 and [dead[i].epoch for i in range(5)] == [5, 1, 6, 3, 4]
    gone = by(G.hard_delete(docs, _ids(spark, 0), "2026-01-02 00:00:00"))[0]
    assert (gone.title, gone.uri, gone.metadata, gone.roles, gone.sid, gone.state) == (None, "", {}, [], "1.2.3.0.0", "TOMBSTONED")
    new = spark.createDataFrame([(0, None, {"a": "b", "chunk": "1"}, ["x"]), (1, "new", None, None)], "doc long, title string, metadata map<string,string>, roles array<string>")
    got = by(G.patch(docs, new))
    assert (got[0].title, got[0].metadata, got[0].roles, got[0].epoch) == ("title0", {"a": "b", "chunk": "1"}, ["x"], 0) and got[1].title == "new" and got[1].metadata == {"chunk": "8"}
    log = {(r.doc, r.op, r.before.state, r.after.state) for r in G.audit(docs, G.tombstone(docs, _ids(spark, 1), "2026-01-02 00:00:00"), "api", "tombstone").collect()}
    assert log == {(1, "tombstone", "ACTIVE_COLD_START", "TOMBSTONED")}
    assert G.tombstone(docs.limit(0), _ids(spark, 1), "2026-01-02 00:00:00").count() == 0


def test_reads(spark):
    docs = _docs(spark)
    assert [r.doc for r in G.children(docs, 7).collect()] == [2, 1, 0]
    assert {r.sid for r in G.snapshot_ids(docs).collect()} == {f"1.2.3.{i}.0" for i in (0, 1, 2)}
    assert G.get(docs, 4).count() == 1 and G.records(docs, ["TOMBSTONED"]).count() == 1 and G.snapshot_ids(docs, "v2").count() == 0
    assert {r.doc for r in G.without_tombstones(docs.select("doc"), docs).collect()} == {0, 1, 2, 4}
    cap = G.hot_cap(docs).first()
    assert (cap.live, cap.status) == (3, "alarm") and cap.hot_ratio == pytest.approx(1 / 3, abs=1e-6)
    learned = G.mark_learned(docs, _ids(spark, 1), "2026-01-01 00:00:00")
    hot = docs.select("sid")
    assert G.sweep_hot(learned, hot, "2026-01-07 23:00:00").count() == 5
    assert {r.sid for r in hot.subtract(G.sweep_hot(learned, hot, "2026-01-08 00:00:00")).collect()} == {"1.2.3.1.0"}


def test_bloom(spark):
    m, k = G.bloom_shape(1000, 1e-3)
    keys = spark.range(500).select(F.col("id").alias("doc"))
    bits = G.bloom(keys, "doc", m, k)
    got = {r.doc: r.maybe for r in G.maybe_in(spark.range(10500).select(F.col("id").alias("doc")), "doc", bits, m, k).collect()}
    assert all(got[i] for i in range(500)) and sum(got[i] for i in range(500, 10500)) < 20


def test_filters_and_channels(spark):
    rows = spark.createDataFrame([(1, {"lang": ["de", "en"], "kind": ["a"]}), (2, {"lang": ["fr"]}), (3, None)], "doc long, m map<string,array<string>>")
    assert [r.doc for r in rows.where(G.passes(F.col("m"), {"metadata.lang": ["en"], "kind": ["a", "b"]})).collect()] == [1]
    kept = spark.createDataFrame([(0, 1, "full_lexical", None, 2.0, 0), (0, 1, "generative", -1.0, None, 3), (0, 2, "hot_lexical", None, 1.0, 1), (0, 2, "full_lexical", None, 4.0, 2)], "qid long, doc long, channel string, gen double, bm25 double, pos int")
    got = {r.doc: (r.channel, r.gen, r.bm25, r.pos, r.extra) for r in G.merge_channels(kept).collect()}
    assert got == {1: ("generative", -1.0, 2.0, 0, 1), 2: ("hot_lexical", None, 4.0, 1, 1)}
    order = G.preliminary(kept.withColumn("sid", F.col("doc").cast("string"))).orderBy("rank")
    assert [(r.channel, r.bm25) for r in order.collect()] == [("generative", None), ("hot_lexical", 1.0), ("full_lexical", 4.0), ("full_lexical", 2.0)]
    near = spark.createDataFrame([(0, 1, 1, 5), (0, 2, 2, 5), (0, 3, 3, None), (0, 5, 4, None)], "qid long, doc long, rank long, near_dup_group long")
    assert [r.doc for r in G.collapse(near).orderBy("rank").collect()] == [1, 3, 5]


def test_migration(spark):
    docs = _docs(spark)
    alias = spark.createDataFrame([("v1", "1.2.3.0.0", 77, "CONTENT_DRIFT"), ("v2", "9.9.9.9.0", 1, "SCHEMA_MIGRATION")], "schema string, sid string, doc long, reason string").withColumn("expires_at", F.lit("2027-01-01").cast("timestamp_ntz"))
    mapping = spark.createDataFrame([(0, "9.9.9.9.0"), (1, "9.9.9.9.1")], "doc long, new_sid string")
    staged = G.prepopulate(alias, mapping, "v2", "2026-01-01")
    assert sorted((r.schema, r.sid, r.doc) for r in staged.collect()) == [("v1", "1.2.3.0.0", 77), ("v2", "9.9.9.9.0", 0), ("v2", "9.9.9.9.1", 1)]
    history = docs.select("doc", "sid", "schema", F.lit("2025-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    counters = spark.createDataFrame([("v2", "9.9.9.9", 5), ("v1", "1.2.3.0", 1)], "schema string, prefix string, next_ordinal long")
    out = G.cutover(docs, staged, history, counters, mapping, spark.createDataFrame([("9.9.9.9", 2), ("8.8.8.8", 1)], "prefix string, next_ordinal long"), "v2", "2026-02-01")
    assert {(r.doc, r.sid, r.schema) for r in out["docs"].where("doc < 3").collect()} == {(0, "9.9.9.9.0", "v2"), (1, "9.9.9.9.1", "v2"), (2, "1.2.3.2.0", "v1")}
    assert sorted((r.schema, r.sid, r.doc) for r in out["aliases"].collect()) == [("v1", "1.2.3.0.0", 77), ("v1", "1.2.3.1.0", 1)]
    assert out["history"].where("valid_to IS NULL").count() == 5 and out["history"].count() == 7
    assert {(r.schema, r.prefix): r.next_ordinal for r in out["counters"].collect()} == {("v2", "9.9.9.9"): 5, ("v1", "1.2.3.0"): 1, ("v2", "8.8.8.8"): 1}


def test_diagnose(spark):
    docs = _docs(spark)
    wanted = spark.createDataFrame([(0, i) for i in (0, 1, 2, 3, 50)] + [(1, 0), (2, 0), (3, 1), (4, 0)], "qid long, doc long")
    results = spark.createDataFrame([(0, 0)], "qid long, doc long")
    pool = spark.createDataFrame([(1, 0, 0.2), (2, 0, 0.9), (3, 1, 0.9)], "qid long, doc long, ce double")
    survivors = spark.createDataFrame([(4, 1, "1"), (4, 2, "1.2"), (4, 4, "1.2.3.0")], "qid long, level int, prefix string")
    got = {(r.qid, r.doc): (r.reason, r.survived) for r in G.diagnose(wanted, docs, results, docs.select("sid"), pool, survivors, "t", ["guest"]).collect()}
    assert got == {(0, 0): ("retrieved", None), (0, 1): ("pruned", 0), (0, 2): ("filtered_acl", None), (0, 3): ("filtered_tombstone", None), (0, 50): ("not_in_trie", None), (1, 0): ("low_relevance", None), (2, 0): ("reranked_below_k", None), (3, 1): ("cold_start_outranked", None), (4, 0): ("pruned", 2)}


def test_requests(spark):
    calls = spark.createDataFrame([("a", float(t), t, t < 6) for t in range(9)] + [("a", 15.0, 20, True), ("a", 16.0, 21, False), ("a", 26.0, 22, False), ("a", 27.0, 23, False), ("b", 0.0, 1, True)], "key string, at double, id long, failed boolean")
    got = {(r.key, r.id): r.open for r in G.breaker(calls).collect()}
    assert [got["a", i] for i in (*range(9), 20, 21, 22, 23)] == [False] * 5 + [True] * 4 + [False, True, False, False] and not got["b", 1]
    asked = spark.createDataFrame([("t", 0.0, i) for i in range(4)] + [("t", 0.4, 9), ("t", 0.6, 10), ("t", 0.7, 11)], "key string, at double, id long")
    ok = {r.id: r.allowed for r in G.rate_limit(asked, 2.0).collect()}
    assert [ok[i] for i in (0, 1, 2, 3, 9, 10, 11)] == [True, True, False, False, False, True, False]


def test_bundles(spark):
    log = spark.createDataFrame([(1, "x", "ann"), (2, "x", "ann"), (3, "x", "bob"), (4, "y", "ann"), (5, "y", "cy"), (6, "x", "bob"), (7, "x", "cy")], "at long, bundle string, operator string")
    active = G.approvals(log)
    assert [(r["at"], r.bundle) for r in active.orderBy("place").collect()] == [(3, "x"), (5, "y"), (7, "x")]
    assert [r.bundle for r in G.hot_bundles(active).collect()] == ["x", "y"]
    bundle = spark.createDataFrame([("b", "m", "a1", "v1", "c1", "s1", "t1", "s2")], "bundle_id string, backbone string, adapter string, id_schema string, codebooks string, codebook_sha256 string, trie_snapshot string, trie_sha256 string")
    book = spark.createDataFrame([("c1", "s1", "v1")], "version string, sha256 string, id_schema string")
    trie = spark.createDataFrame([("t1", "bad", "v1", "cs_2026_03_01")], "version string, sha256 string, id_schema string, corpus_snapshot string")
    adapter = spark.createDataFrame([("a1", "other", "cs_2026_02_20")], "version string, backbone string, trained_on_snapshot string")
    assert {r.problem for r in G.compatible(bundle, book, trie, adapter).collect()} == {"trie sha256", "adapter backbone", "warning: old adapter"}
    day = spark.sql("SELECT DATE '2026-03-01' AS d").select(G.snapshot_name(F.col("d")).alias("n")).select("n", G.snapshot_date(F.col("n")).alias("d")).first()
    assert day.n == "cs_2026_03_01" and str(day.d) == "2026-03-01"


def test_filter_queries(spark):
    texts = ["what is a red fox", "What is a RED fox", "the fox said no", None, "hi", "hi", "one two three four"]
    rows = spark.createDataFrame([(1, i, t, i == 2, i != 3) for i, t in enumerate(texts)], "doc long, pos long, text string, leaks boolean, found boolean")
    got = {r.pos: r.verdict for r in C.filter_queries(rows, keep=2).collect()}
    assert got == {0: "accepted", 1: "duplicate", 2: "leaked", 3: "round_trip_failed", 4: "accepted", 5: "unseen", 6: "unseen"}
    s = C.filter_stats(C.filter_queries(rows)).first()
    assert (s.generated, s.duplicate, s.leaked, s.round_trip_failed, s.accepted) == (7, 2, 1, 1, 3)
    state = spark.createDataFrame([(8, 0), (7, 1), (7, 2)], "a int, t int").select(C.coverage_state(F.col("a"), F.col("t")).alias("s"))
    assert [r.s for r in state.collect()] == ["ok", "regenerate", "LOW_COVERAGE"]
    kinds = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabcab")], "doc long, pos long, kind string")
    assert "".join(r.kind for r in C.interleave(kinds).orderBy("place").collect()) == "abcaba"


def test_negatives(spark):
    neg = spark.createDataFrame([(0, 1, 2, 0.1, 0.9), (0, 1, 3, 0.1, 0.9), (0, 1, 4, 0.75, 0.9), (0, 1, 5, 0.65, 0.7), (0, 1, 6, None, 0.9)], "qid long, positive long, doc long, score double, positive_score double")
    links = spark.createDataFrame([(2, 1)], "a long, b long")
    got = C.drop_false_negatives(neg, links)
    assert {r.doc: r.verdict for r in got.collect()} == {2: "near_dup", 3: "kept", 4: "score", 5: "score", 6: "score"}
    assert tuple(C.discard_rate(got).first()) == (5, 3, 1, 0.8)
    assert C.drop_false_negatives(neg, links, scored=False).where("verdict = 'kept'").count() == 4
    pools = [("a", "xyzuv"), ("b", "xpq"), ("c", "")]
    rows = spark.createDataFrame([(0, s, d, i) for s, p in pools for i, d in enumerate(p)], "qid long, source string, doc string, pos long")

    def plain(shares, total):
        order, out = sorted(shares, key=lambda s: -shares[s]), []
        pool = dict(pools)
        for s in order:
            out += [d for d in pool.get(s, "") if d not in out][: round(shares[s] * total)]
        out += [d for s in order for d in pool.get(s, "") if d not in out]
        return set(list(dict.fromkeys(out))[:total])

    for shares, total in (({"a": 0.5, "b": 0.25, "c": 0.25}, 4), ({"b": 0.6, "a": 0.4}, 5), ({"a": 0.1, "b": 0.1}, 20)):
        assert {r.doc for r in C.assemble(rows, shares, total).collect()} == plain(shares, total)


def test_canonical(spark):
    copies = spark.createDataFrame([(1, 1), (11, 1), (2, 2), (3, 3), (4, 4), (5, 5)], "doc long, canonical long")
    links = spark.createDataFrame([(1, 2, 0.995), (2, 3, 1.0), (3, 4, 0.9), (1, 3, 0.9), (4, 5, 0.86)], "a long, b long, j double")
    groups, rest = C.canonical(copies, links)
    assert {r.doc: r.canonical for r in groups.collect()} == {1: 1, 11: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert sorted((r.a, r.b) for r in rest.collect()) == [(1, 4), (4, 5)]


def test_losses(spark):
    r = np.random.default_rng(0)
    logits = r.normal(size=(3, 5, 7))
    target, neg = r.integers(0, 7, (3, 5)), r.integers(0, 7, (3, 4, 5))
    neg[0, 0] = target[0]
    neg[1, 1, :3] = target[1, :3]
    lp = logits - np.log(np.exp(logits).sum(-1, keepdims=True))
    w = [1.0, 2.0, 0.5]
    want = sum(w[i] * sum(C.LEVEL_WEIGHTS[n] * (-(1 - (0.1 if n < 4 else 0)) * lp[i, n, target[i, n]] - (0.1 if n < 4 else 0) * lp[i, n].mean()) for n in range(5)) for i in range(3)) / sum(w)
    rows = spark.createDataFrame([(i, n, logits[i, n].tolist(), int(target[i, n]), w[i]) for i in range(3) for n in range(5)], "id int, level int, logits array<double>, target int, weight double")
    assert C.sequence_loss(rows).first().loss == pytest.approx(want, abs=1e-6)
    hinges = []
    for i in range(3):
        for j in range(4):
            at = next((n for n in range(5) if neg[i, j, n] != target[i, n]), 5)
            if at < 5:
                hinges.append(max(0.0, C.MARGINS[at] - lp[i, at, target[i, at]] + lp[i, at, neg[i, j, at]]))
    table = spark.createDataFrame([(i, logits[i].tolist(), target[i].tolist(), neg[i, j].tolist(), True) for i in range(3) for j in range(4)] + [(9, logits[0].tolist(), target[0].tolist(), neg[0, 1].tolist(), False)], "id int, logits array<array<double>>, pos array<int>, neg array<int>, real boolean")
    got = C.rank_loss(table).first()
    assert got.n == len(hinges) and got.loss == pytest.approx(math.fsum(hinges) / len(hinges), abs=1e-6)
    p = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "name string, value double")
    assert C.proximal(p, p.withColumn("value", F.col("value") + 2)).first().distance == 8.0


def test_query_filter_takes_all_sentences(spark, tmp_path):
    few = " ".join(f"word{i} only{i}." for i in range(14))
    many = " ".join(["same words here."] * 3 + [f"plain{i} here." for i in range(30)] + ["a sentence of more than six words leaks."])
    rows = [(0, few), (50, many), (100, None), (150, ""), (7, "word0 word0 word0 only0")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc: tuple(r)[1:] for r in REG.query_filter(spark, str(tmp_path)).collect()}
    assert got == {0: (14, 0, 0, 0, 10), 50: (34, 2, 0, 0, 10), 150: (1, 0, 0, 1, 0)}
    leak = spark.createDataFrame([(1, "a b c d e f g", ["a b c d e f", "a b", None, "x b c d e f y"])], "doc long, body string, parts array<string>")
    assert [(r.n_tokens, r.leaks) for r in C.leaking(leak).orderBy("pos").collect()] == [(6, True), (2, False), (None, None), (7, False)]


def test_round_trip_is_that_of_the_search(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(words, range(1, 61), k=r.randint(1, 30))) for _ in range(300)]
    texts += [texts[5]] * 9 + [None, "", "Straße ÉTÉ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asks = [(f"{i}-{n}", i, " ".join((t or "none").split()[:n])) for i, t in enumerate(texts) for n in (1, 3, 8)] + [("other", 4, "not there"), ("strange", 999, "w1")]
    q = spark.createDataFrame(asks, "qid string, doc long, text string")
    for k in (1, 5, 50):
        found = R.bm25(q.select("qid", "text"), docs, k).withColumnRenamed("doc", "got").join(q, "qid").where("doc = got")
        assert {x.qid for x in R.round_trip(q, docs, k).collect()} == {x.qid for x in found.collect()}


def test_query_checks_takes_all_documents(spark, tmp_path):
    rows = [(1, "one two three four five six seven\nrest"), (2, "short line\nmore"), (3, ""), (4, None), (50, "fifty\nx"), (None, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in MORE.query_checks(spark, str(tmp_path)).collect()}
    assert got == {(1, 7, True, True), (2, 2, False, True), (3, 0, False, False), (4, None, None, False), (50, 1, False, True)}

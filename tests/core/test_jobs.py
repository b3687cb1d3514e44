"""Requests, approximate search, history, unit updates, the registry's stream and staged migration on small tables."""

import datetime as dt
import itertools
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog  # noqa: F401  (the plans register themselves)
from tessera.functions import text as T
from tessera.operators import approximate as X
from tessera.operators import fit as FIT
from tessera.operators import history as H
from tessera.operators import migration as M
from tessera.operators import negatives as N
from tessera.operators import quantize as Q
from tessera.operators import registry as REG
from tessera.operators import requests as A
from tessera.operators import retrieve as R
from tessera.operators import decode as D
from tessera.streaming.registry import Registry

DOCS = "doc long, sid string, state string, tenant string, roles array<string>, schema string, near_dup_group long"


def _books(dim=6, k=4):
    r = np.random.default_rng(3)
    return [r.normal(size=(k, dim)) * s for s in (1, 0.5, 0.25, 0.12)]


def _setup(spark):
    """Ten documents with vectors and texts, four without vectors."""
    r, books = np.random.default_rng(5), _books()
    vecs = [v.tolist() for v in r.normal(size=(10, 6))]
    issued = Q.allocate(Q.encode(spark.createDataFrame(list(enumerate(vecs)), "doc long, vec array<double>"), books)).cache()
    sids = {x.doc: x.sid for x in issued.collect()}
    texts = [(i, f"alpha w{i} w{i % 3}") for i in range(14)] + [(20, None)]
    rows = [(i, sids.get(i), "ACTIVE_COLD_START" if i == 12 else "ACTIVE_LEARNED", "a", [], "v1", 77 if i in (10, 11) else None) for i in range(14)] + [(20, None, None, None, None, None, None)]
    b = A.Backends(spark.createDataFrame(rows, DOCS), spark.createDataFrame(texts, "doc_id long, text string"), issued, D.router(spark, books), D.DecodeConfig(beam=4, widened_beam=6, candidate_cap=8, adaptive_candidate_cap=False))
    asked = spark.createDataFrame([(1, "alpha w1", vecs[1]), (2, 'the "w2" here', vecs[2]), (3, "alpha w3", None), (4, None, vecs[4])], "qid long, text string, vec array<double>")
    return b, asked


def _log(a):
    return {r.qid: r for r in a.requests.collect()}


def test_requests_say_why_they_fell_back(spark):
    b, asked = _setup(spark)
    sure = A.Policy(k=2, tau_conf=0.0, tau_margin=0.0, tau_relevant=0.0)
    log = _log(A.answer(asked, b, sure))
    assert log[2].reason == A.IDENTIFIER and log[2].full_lexical and log[2].route == "lexical"
    assert log[3].reason == A.NO_ANSWER and log[3].degraded and log[3].full_lexical
    assert log[1].reason is None and not log[1].full_lexical and not log[1].widened
    low = A.answer(asked, b, replace(sure, tau_conf=1.1))
    log = _log(low)
    assert log[1].reason == log[4].reason == A.LOW_CONFIDENCE and log[1].widened
    best = {(r.qid, r.rank): r for r in low.results.collect()}
    assert best[1, 1].doc == 1 and all(r.rank <= 2 for r in best.values()) and {r.qid for r in best.values()} == {1, 2, 3, 4}
    dead = replace(b, docs=b.docs.withColumn("state", F.when(F.col("doc") < 10, "TOMBSTONED").otherwise(F.col("state"))))
    a = A.answer(asked, dead, sure)
    assert _log(a)[1].reason == A.DROPPED
    assert all(r.reason == "tombstoned" for r in a.dropped.where("channel = 'generative'").collect()) and not a.results.where("doc < 10").count()


def test_requests_margins_relevance_and_no_fallback(spark):
    b, asked = _setup(spark)
    assert _log(A.answer(asked, b, A.Policy(k=2, tau_conf=0.0, tau_margin=1000.0, tau_relevant=0.0)))[1].reason == A.LOW_MARGIN
    weak = _log(A.answer(asked, b, A.Policy(k=1, tau_conf=0.0, tau_margin=0.0, tau_relevant=1.1)))
    assert weak[1].reason == A.WEAK and weak[1].weak and weak[1].full_lexical
    few = _log(A.answer(asked, b, A.Policy(k=100, tau_conf=0.0, tau_margin=0.0, tau_relevant=0.0)))
    assert few[1].reason == A.TOO_FEW
    alone = A.answer(asked, b, A.Policy(k=5, tau_conf=1.1, fallback=False))
    assert not any(r.full_lexical for r in _log(alone).values()) and not alone.results.where("channel = 'full_lexical'").count()
    # near duplicates stand for each other, a document that the registry has only nulls for is never returned
    wide = A.answer(asked, b, A.Policy(k=14, tau_conf=1.1))
    got = [r.doc for r in wide.results.where("qid = 3").collect()]
    assert len({10, 11} & set(got)) == 1 and 20 not in got
    assert A.answer(asked.limit(0), b).results.count() == 0


def test_null_tenants_and_schemas_are_dropped(spark):
    reg = spark.createDataFrame([(1, "ACTIVE_LEARNED", None, None, "v1"), (2, "ACTIVE_LEARNED", "a", None, "v1"), (3, "ACTIVE_LEARNED", "a", ["x"], None), (4, None, "a", [], "v1")], "doc long, state string, tenant string, roles array<string>, schema string")
    got = {r.doc: r.reason for r in REG.tier1(spark.range(1, 6).withColumnRenamed("id", "doc"), reg, "a", ["x"], "v1").collect()}
    assert got == {1: "acl", 2: "kept", 3: "schema", 4: "missing", 5: "missing"}


def test_balanced_assignment_ends_with_vectors_that_are_no_numbers(spark):
    rows = [(i, [float("nan"), 1.0] if i % 3 == 0 else [float(i), 1.0]) for i in range(12)] + [(20, [float("inf"), 0.0]), (21, None)]
    got = FIT.balanced_assign(FIT.usable(spark.createDataFrame(rows, "doc long, vec array<double>")), np.eye(2), 1.25).collect()
    assert sorted(r.doc for r in got) == [i for i in range(12) if i % 3]


def test_index_of_terms_counts_lengths_as_they_pass(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a c")], "qid long, text string")
    (post, stats), (plain, plain_stats) = R.index(asked, docs), R.index(asked, docs, keep=False)
    assert sorted(post.collect()) == sorted(plain.collect()) and stats.first() == plain_stats.first() == (4, 1.0)
    assert R.bm25(asked, docs.limit(0)).count() == 0


# ------------------------------------------------------------ approximate search


def test_approximate_search_finds_what_the_exact_one_does(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    x = centres[r.integers(0, 12, 900)] + 0.4 * r.normal(size=(900, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (5, x[5].tolist())] + [(3000 + i, x[0].tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "doc long, vec array<double>")
    asked = v.where("doc % 30 = 0 AND doc < 1000 OR doc = 2000").withColumnRenamed("doc", "qid")
    index = X.build(v, cells=16, rounds=5)
    assert sum(len(t.docs) for t in index.tiles.select("docs").collect()) == 900 + 1 + 300  # every usable row
    probes = X.tune(index, v, target=0.95)
    exact = R.dense(asked, v.where(X.USABLE))
    assert probes < 16 and X.recall(X.search(asked, index, 10, probes), exact).first().recall >= 0.9
    all_ = sorted(map(tuple, X.search(asked, index, 10, 16).collect()))
    assert all_ == sorted(map(tuple, exact.collect()))
    X.save(index, str(tmp_path / "ix"))
    back = X.load(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, X.search(asked, back, 10, 16).collect())) == all_
    none = X.build(v.where("doc = 2000"))
    assert X.search(asked, none).count() == 0 and X.tune(none, v.limit(0)) == 1


# ------------------------------------------------------------ history


def test_holders_at_an_instant(spark):
    r = random.Random(4)
    day = lambda n, h=0: dt.datetime(2020, 1, 1) + dt.timedelta(days=n, hours=h)
    hist = [(r.choice("abc"), i, None if r.random() < 0.05 else day(r.randint(0, 900), r.randint(0, 23)), None if r.random() < 0.2 else day(r.randint(0, 1200), 5)) for i in range(150)]
    hist += [("a", 900, day(40000), None), ("b", 901, dt.datetime(1950, 1, 1), dt.datetime(1960, 1, 1)), (None, 902, day(1), None)]
    asked = [(r.choice("abcd"), day(r.randint(-5, 1300), r.randint(0, 23))) for _ in range(300)] + [("a", day(48000)), ("b", dt.datetime(1955, 5, 5)), (None, day(5)), ("a", None)]
    got = {(x.sid, x["at"]): x.doc for x in H.held_at(spark.createDataFrame(asked * 2, "sid string, at timestamp_ntz"), spark.createDataFrame(hist, "sid string, doc long, valid_from timestamp_ntz, valid_to timestamp_ntz")).collect()}
    for sid, at in set(asked):
        ok = [(f is not None, f or at, d) for s, d, f, t in hist if sid is not None and at is not None and s == sid and (f is None or f <= at) and (t is None or at < t)]
        assert got[sid, at] == (max(ok)[2] if ok else None), (sid, at)
    assert len(got) == len(set(asked))


def test_changes_of_units(spark):
    books = [np.array([[0.0, 0.0], [4.0, 0.0]]), np.array([[0.0, 0.0], [0.0, 1.0]])]
    unit = "parent long, doc long, chunk int, state string, hash string, alias_depth int, c1 int, c2 int"
    old = [(1, 10, 0, "ACTIVE_LEARNED", "h0", 0, 0, 0), (1, 11, 1, "TOMBSTONED", "h1", 0, 0, 0), (1, 12, 2, "ACTIVE_LEARNED", "h2", 0, 0, 0), (1, 13, 3, "ACTIVE_LEARNED", "h3", 2, 0, 0), (1, 14, 4, "ACTIVE_LEARNED", None, 0, 0, 0), (2, 20, 0, "ACTIVE_LEARNED", "k0", 0, 0, 0), (3, 30, 0, "ACTIVE_LEARNED", "l0", 0, 1, 1), (3, 31, 1, "ACTIVE_LEARNED", "l1", 0, 1, 1)]
    new = [(1, 0, "h0", [1.0, 0.0], 1, 0), (1, 1, "x", [1.0, 0.0], 1, 0), (1, 2, "y", [1.0, 0.0], 1, 0), (1, 3, "z", None, None, None), (1, 4, "n", [0.0, 1.0], 0, 1), (3, 0, "l0", [0.0, 1.0], 0, 1), (4, 0, "q", [0.0, 1.0], 0, 1)]
    rows = H.unit_changes(spark.createDataFrame(old, unit), spark.createDataFrame(new, "parent long, pos int, hash string, vec array<double>, n1 int, n2 int"), books, margin=-100.0).collect()
    got = {(r.parent, r.pos): (r.doc, r.action, r.reason, r.c1, r.c2) for r in rows}
    assert got == {
        (1, 0): (10, "kept", None, 0, 0), (1, 1): (12, "changed", "moved_past_margin", 1, 0), (1, 2): (13, "changed", "pinned_alias_depth", 0, 0), (1, 3): (14, "changed", "no_vector", 0, 0),
        (1, 4): (None, "new", None, 0, 1), (3, 0): (30, "kept", None, 1, 1), (3, 1): (31, "dropped", None, 1, 1), (4, 0): (None, "unknown", None, None, None),
    }


# ------------------------------------------------------------ the stream


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _events(r, n):
    kinds = ["signup", "click", "view", "purchase", "error", "strange"]
    at = dt.datetime(2024, 1, 1)
    return [(i, at + dt.timedelta(minutes=r.randint(0, 200)), r.choice([1, 2, 3, 4, 5, None]), r.choice(kinds), round(r.random(), 3)) for i in range(n)]


def test_the_stream_folds_as_the_whole_log_does(spark, tmp_path):
    rows = _events(random.Random(8), 160)
    whole = REG.fold(REG.mutations(spark.createDataFrame(rows, EVENTS)).where("doc IS NOT NULL"))
    want = sorted(map(str, whole.collect()))
    in_order = sorted(rows, key=lambda e: (e[1], e[0]))
    for name, log in (("in_order", in_order), ("as_it_comes", rows)):  # the second has late mutations in every batch
        kept = Registry(spark, str(tmp_path / name), "doc % 2")
        parts = [spark.createDataFrame(log[lo : lo + 40], EVENTS) for lo in range(0, 160, 40)]
        for batch, part in enumerate(parts):
            kept.merge(part, batch)
            if batch == 2:
                ids = sorted(kept.issued().collect())
                kept.merge(part, batch)  # a batch that is run again
                assert sorted(kept.issued().collect()) == ids
        assert sorted(map(str, kept.state().collect())) == want
        issued = kept.issued().collect()
        assert len({r.doc for r in issued}) == len(issued) == len({(r.prefix, r.ordinal) for r in issued}) == len(want)
        for _, own in itertools.groupby(sorted(issued, key=lambda r: r.prefix), key=lambda r: r.prefix):
            assert sorted(r.ordinal for r in own) == list(range(sum(1 for x in issued if x.prefix == _)))


def test_the_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = sorted(_events(random.Random(9), 60), key=lambda e: (e[1], e[0]))
    for lo in (0, 30):
        spark.createDataFrame(rows[lo : lo + 30], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        kept = Registry(spark, str(tmp_path / "t"), "'p'")  # a new process
        kept.run(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "c"))
    want = REG.fold(REG.mutations(spark.createDataFrame(rows, EVENTS)).where("doc IS NOT NULL"))
    assert sorted(map(str, kept.state().collect())) == sorted(map(str, want.collect()))
    assert Registry(spark, str(tmp_path / "none"), "'p'").state().count() == 0


# ------------------------------------------------------------ migration


def test_stages_can_be_run_again_and_gates_hold(spark, tmp_path):
    r = np.random.default_rng(0)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(r.normal(size=(30, 6)))] + [(40, None)], "doc long, vec array<double>")
    docs = spark.createDataFrame([(i, f"{i % 4}.0.0.0.{i}", "v1", "TOMBSTONED" if i == 7 else "ACTIVE_LEARNED") for i in [*range(30), 40]], "doc long, sid string, schema string, state string")
    hist = docs.select("doc", "sid", "schema", F.lit("2026-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    reg = {"docs": docs, "history": hist, "aliases": spark.createDataFrame([], "schema string, sid string, doc long, reason string, expires_at timestamp_ntz"), "counters": spark.createDataFrame([("v2", "0.0.0.0", 99)], "schema string, prefix string, next_ordinal long")}
    m = M.Migration(spark, str(tmp_path / "m"), "v2", "2026-02-01 00:00:00", balance_limit=9.0)
    with pytest.raises(M.Refused, match="after plan"):
        m.prepopulate(reg)
    report = m.plan(docs, v, _books()).first()
    assert (report.documents, report.without_vector) == (29, 1) and report.balance_ok and report.escape_ok
    assert m.plan(docs.limit(0), v, _books()).first() == report  # made before: nothing is planned anew
    with pytest.raises(M.Refused, match="after prepopulate"):
        m.cutover(["a", "b"])
    staged = m.prepopulate(reg)
    assert staged["aliases"].count() == 29 and staged["docs"].where("schema = 'v2'").count() == 0
    with pytest.raises(M.Refused, match="two"):
        m.cutover(["a", "a"])
    rows = lambda t: {k: sorted(map(str, x.collect())) for k, x in t.items()}
    once = rows(m.cutover(["a", "b"]))
    assert rows(m.cutover(["a", "c"])) == once == rows(M.Migration(spark, str(tmp_path / "m"), "v2", "2026-03-01 00:00:00", balance_limit=9.0).cutover(["x", "y"]))
    t = m.tables()
    assert t["docs"].where("schema = 'v2'").count() == 29 == t["aliases"].count() and t["docs"].where("doc = 7 AND schema = 'v1'").count() == 1
    assert t["history"].where("valid_to IS NULL").count() == 31 and t["history"].count() == 60
    assert t["counters"].where("prefix = '0.0.0.0'").first().next_ordinal == 99
    assert [x.op for x in m.audit().orderBy("op").collect()] == ["schema_migration:cutover", "schema_migration:plan", "schema_migration:prepopulate"]
    tight = M.Migration(spark, str(tmp_path / "tight"), "v2", "2026-02-01 00:00:00", balance_limit=0.5)
    tight.plan(docs, v, _books())
    with pytest.raises(M.Refused, match="balance"):
        tight.prepopulate(reg)


# ------------------------------------------------------------ tries and negatives


def test_numbers_of_trie_nodes(spark):
    r = random.Random(2)
    codes = [[r.randint(0, 3) for _ in range(4)] for _ in range(200)]
    rows = Q.numbered(spark.createDataFrame([(c,) for c in codes], "codes array<int>").repartition(5)).collect()
    by = {(x.depth, x.node): x for x in rows}
    sorted_ = sorted(codes)
    for depth in range(1, 5):
        nodes = sorted({tuple(c[:depth]) for c in codes})
        above = sorted({tuple(c[: depth - 1]) for c in codes})
        for n, prefix in enumerate(nodes):
            x = by[depth, n]
            assert (x.parent, x.code, x.leaves) == (above.index(prefix[:-1]), prefix[-1], sum(tuple(c[:depth]) == prefix for c in codes))
            assert x.first_leaf == next(i for i, c in enumerate(sorted_) if tuple(c[:depth]) == prefix)
            if depth < 4:
                own = [by[depth + 1, x.first_child + i] for i in range(x.children)]
                assert all(y.parent == n for y in own) and [y.code for y in own] == sorted({c[depth] for c in codes if tuple(c[:depth]) == prefix})
    assert by[0, 0].leaves == 200 and len(rows) == 1 + sum(len({tuple(c[:d]) for c in codes}) for d in range(1, 5))
    assert Q.numbered(spark.createDataFrame([], "codes array<int>")).count() == 0


def test_negatives_and_slices(spark):
    found = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.9), (1, 12, 3, 0.9), (2, 10, 1, 0.4), (2, 13, 2, 0.4), (3, None, 1, 0.5)], "qid long, doc long, rank long, confidence double")
    gold = spark.createDataFrame([(1, 12), (2, 99), (3, 5), (4, 7)], "qid long, doc long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(N.above_gold(found, gold)) == [(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 13, 2), (3, None, 1)]
    assert rows(N.above_gold(found, gold, 1)) == [(1, 10, 1), (2, 10, 1), (3, None, 1)]
    positives = spark.createDataFrame([(1, 10), (1, 10), (1, 12)], "qid long, doc long")
    asked = []
    got = N.searched(gold.select("qid"), positives, lambda q, k: asked.append(k) or found.select("qid", "doc", "rank"), 2)
    assert rows(got.select("qid", "doc", "rank")) == [(1, 11, 1), (2, 10, 1), (2, 13, 2), (3, None, 1)] and asked == [4]
    slices = {r.slice: r for r in N.by_slice(found, gold, spark.createDataFrame([(12,), (7,)], "doc long")).collect()}
    assert slices["all"].queries == 4 and slices["all"].recall == 0.25 and slices["all"].mrr == round(1 / 12, 4)
    assert slices["held_out"].queries == 2 and slices["held_out"].recall == 0.5 and slices["held_out"].confidence == 0.9 and slices["known"].first == 0.0


def test_words_of_a_text_are_its_tokens(spark):
    texts = ["", "It's A_b 9x\tOK\x1cgo\x00z", "Straße ÉTÉ ﬁne x² Ⅷ İstanbul", "naïvé 日本 ｆｕｌｌ １２", "ΣΑΣ ĳ ſt"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", "text", T.tokens(F.col("text")).alias("t")).collect()
    assert all([w.decode() for w in T.token_list(r.text)] == r.t for r in rows)


def test_lexical_search_takes_the_best_of_every_block(spark, monkeypatch):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, None if i % 50 == 7 else " ".join(r.choice(words, r.integers(0, 12)))) for i in range(300)], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(r.choice([*words, "none"], r.integers(0, 5)))) for i in range(40)], "qid long, text string")
    n, avgdl = docs.count(), docs.where("text IS NOT NULL").agg(F.avg(F.size(T.tokens(F.col("text"))))).first()[0]
    stats = spark.createDataFrame([(n, avgdl)], "n long, avgdl double")
    plain = R.top_k(R.bm25_scores(asked, docs, held=(R.index(asked, docs)[0], stats)).where("score > 0"), 7).select("qid", "doc", "score", "rank")
    for name, value in (("LEXICAL_BLOCK", 9), ("ASKED", 4), ("TILE", 16)):
        monkeypatch.setattr(R, name, value)
    got = R.bm25(asked, docs, 7)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pair of a query and a document is merged by a shuffle
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in plain.collect())
    twice = R.kept(asked, docs.union(docs.where("doc_id = 5")))
    assert twice.n == n + 1 and twice.rows.where("doc = 5").count() == 1


def test_trailing_share_reads_each_event_once(spark):
    r = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=30 * r.randrange(300)), r.choice(["error", "view", None])) for i in range(400)] + [(900, None, "error")]
    got = {x.event_id: (x.share, x.n) for x in REG.trailing_share(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string"), "event_type = 'error'").collect()}
    for i, at, _ in rows[:-1]:
        held = [k for _, t, k in rows[:-1] if dt.timedelta(0) <= at - t <= dt.timedelta(hours=24)]
        known = [k == "error" for k in held if k is not None]
        assert got[i] == (round(sum(known) / len(known), 6) if known else None, len(held))
    plan = REG.trailing_share(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string"), "event_type = 'error'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(got) == 400 and "RangeFrame" not in plan


def test_history_keeps_one_interval_a_stretch(spark):
    r = random.Random(6)
    at = lambda: r.choice([dt.datetime(1970, 1, 1), dt.datetime(1960, 5, 1), dt.datetime(2200, 1, 1), dt.datetime(2024, 1, 1) + dt.timedelta(hours=r.choice([0, 24, 24, 7]) * r.randrange(40))])
    hist = [("a", i, None if i % 9 == 0 else at(), None if i % 7 == 0 else at()) for i in range(300)]
    asked = [("a", at()) for _ in range(80)]
    h = spark.createDataFrame(hist, "sid string, doc long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    out = H.held_at(spark.createDataFrame(asked, "sid string, at timestamp_ntz"), h)
    low = dt.datetime.min
    for x in out.collect():
        holds = [(f is not None, f or low, d) for _, d, f, t in hist if (f is None or f <= x["at"]) and (t is None or x["at"] < t)]
        assert x.doc == (max(holds)[2] if holds else None)


def test_dense_search_apart_from_a_group(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(4).round(1).tolist(), None if i % 23 == 0 else i % 3) for i in range(700)]
    v = spark.createDataFrame(rows, "doc long, vec array<double>, label int").repartition(3)
    asked = v.where("doc % 50 = 0").withColumnRenamed("doc", "qid")
    got = R.dense(asked, v, 6, apart="label").collect()
    x = np.array([a for _, a, _ in rows])
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    for i in range(0, 700, 50):
        other = [j for j in range(700) if None not in (rows[i][2], rows[j][2]) and rows[i][2] != rows[j][2]]
        want = sorted(other, key=lambda j: (-round(float(x[i] @ x[j]), 9), j))[:6]
        assert [g.doc for g in sorted(got, key=lambda g: g.rank) if g.qid == i] == want


def test_entities_that_are_cut_off_stay(spark):
    rows = spark.createDataFrame([("<title>a &amp;&amp</title>&lt;&ampx; &#65;&#x42; &copy &nope; &amp;lt;",)], "x string")
    assert rows.select(T.html_to_text_closed(F.col("x"))).first()[0] == "a &&amp<&ampx; AB &copy &nope; &lt;"

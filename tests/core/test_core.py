"""Hand-computed cases of the core functions, and each catalogue query against DuckDB."""

import hashlib
import math
import os
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalog, sources
from tessera.functions import ids
from tessera.functions import text as T
from tessera.operators import evaluate as E
from tessera.operators import quantize as Q
from tessera.operators import retrieve as R

SF = "/root/testdata/sf0.001"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_clean_and_quality(spark):
    assert one(spark, "  a\t b\r\n\n\n\n c  ", T.clean) == "a b\n\nc"
    assert one(spark, "short", T.quality_reason) == "too_short"
    assert one(spark, "#" * 60, T.quality_reason) == "mostly_symbols"
    assert one(spark, None, T.clean) is None


def test_classify(spark):
    for q, want in [('find "exact words"', "lexical"), ("snake_case name", "lexical"), ("obj.method(", "lexical"), ("plain words here", "semantic")]:
        assert one(spark, q, T.classify) == want


def test_chunk_bounds(spark):
    units = one(spark, " ".join(f"w{i}." for i in range(300)), lambda x: T.chunk(x, 60))
    assert " ".join(units).split() == [f"w{i}." for i in range(300)]
    assert all(int(len(u.split()) * 1.3) + 1 <= 60 for u in units)
    assert one(spark, "", lambda x: T.chunk(x, 60)) == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp; b<script>x</p></script><br>c<!-- d --></p>", "\na & b\nc\n"),
        ("caf&eacute; &#39;x&#39; &#x263A; &copy 1", "café 'x' ☺ © 1"),
        ('<a title="x > y">t</a><DIV\nclass=q>u</DIV >v', "t\nu\nv"),
        ("<style>p > a {}</style>x<template>y<b>z</b></template>w", "xw"),
        ("1 < 2 and <!doctype html>", "1 < 2 and "),
        ("<noscript>a<noscript>b</noscript>c</noscript>d</script>e", "de"),
        ("<script>never closed <p>", ""),
        ("", ""),
        (None, None),
    ],
)
def test_html(spark, page, want):
    assert one(spark, page, T.html_to_text) == want


ODD = ["ﬁne ①② ｆｕｌｌ", "Straße ẞ ΣΑΣ ſ", "a\u00a0b\u2003c", "e\u0301 café É", "µ ª º ½ ²", "İstanbul ǰ ŉ", "日本 ㍿", "plain Ärger", "", None]


@pytest.mark.parametrize("text", ODD)
def test_normal_forms(spark, text):
    """Against the standard library."""
    form = None if text is None else unicodedata.normalize("NFKC", text)
    assert one(spark, text, T.nfkc) == form
    assert one(spark, text, T.casefold) == (None if text is None else text.casefold())
    assert one(spark, text, T.tokens) == (None if text is None else re.findall(r"\w+", form.casefold()))
    assert one(spark, text, T.normalize) == (None if text is None else " ".join(form.casefold().split()))
    if text:
        clean = re.sub(" +", " ", form).strip()
        assert one(spark, text, T.content_hash) == hashlib.sha256(clean.casefold().encode()).hexdigest()


def test_plain_functions(spark):
    assert one(spark, "A  B", T.format_document) == "document: a b"
    two = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in two.select(T.jaccard(F.col("a"), F.col("b"), F.lit(-1.0))).collect()] == [pytest.approx(1 / 3), -1.0]
    sid = spark.createDataFrame([("1.2.3.4.255.0",), ("x.2",)], "x string").select(ids.parse(F.col("x")).alias("p"))
    assert [r.p for r in sid.collect()] == [[1, 2, 3, 4, 255, 0], [None, 2]]
    t = spark.createDataFrame([(8,), (8 + 256 + 5,)], "t int")
    assert [tuple(r) for r in t.select(ids.token_level(F.col("t")), ids.token_code(F.col("t"))).collect()] == [(1, 0), (2, 5)]


def test_readers(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("q1\tsome text\twith tab\n\nq2\t\n")
    (tmp_path / "r.txt").write_text("q1 0 d1 2\n\nq1\t0\td2\t0\n")
    (tmp_path / "j.jsonl").write_text('{"a": 1, "z": 2}\n{"a": null}\n')
    assert [tuple(r) for r in sources.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "some text\twith tab"), ("q2", "")]
    assert [tuple(r) for r in sources.read_qrels(spark, str(tmp_path / "r.txt")).collect()] == [("q1", "d1", 2), ("q1", "d2", 0)]
    assert [r.a for r in sources.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()] == [1, None]


def test_identifiers(spark):
    df = spark.createDataFrame([(0,), (254,), (255,), (764,)], "n long").select("n", ids.tail(F.col("n")).alias("t"))
    assert {r.n: r.t for r in df.collect()} == {0: [0], 254: [254], 255: [255, 0], 764: [255, 255, 254]}
    assert [r[0] for r in df.select(ids.ordinal(F.col("t"))).collect()] == [0, 254, 255, 764]
    with pytest.raises(Exception, match="prefix capacity"):
        spark.createDataFrame([(765,)], "n long").select(ids.tail(F.col("n"))).collect()


@pytest.mark.parametrize(("groups", "n", "want"), [([7, 7, 7, 7, 7, 1, 2], 5, [0, 1, 2, 5, 6]), ([7] * 6, 5, [0, 1, 2, 3, 4])])
def test_quota(spark, groups, n, want):
    r = spark.createDataFrame([("q", i, g) for i, g in enumerate(groups)], "qid string, rank long, g int")
    got = sorted(x["rank"] for x in R.quota_select(r, F.col("g"), n, 0.4).collect())
    assert got == want


def test_metrics(spark):
    run = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("xaby")], "qid string, doc string, rank long")
    rel = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "z", 1), ("r", "a", 1)], "qid string, doc string, grade int")
    got = {r.qid: r for r in E.query_metrics(run, rel).collect()}
    assert got["r"].mrr_10 == 0 and got["q"].mrr_10 == 0.5
    ideal = 3 + 1 / math.log2(3) + 0.5
    assert got["q"].ndcg_10 == pytest.approx((3 / math.log2(3) + 0.5) / ideal)


def test_rrf_order(spark):
    runs = [spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(x)], "qid string, doc string, rank long") for x in ("abc", "bca")]
    assert R.rrf(runs).orderBy("rank").first()["doc"] == "b"


def test_counters_are_never_reused(spark):
    codes = spark.createDataFrame([(i, 1, 2, 3, 4) for i in range(3)], "doc long, c1 int, c2 int, c3 int, c4 int")
    first = Q.allocate(codes)
    more = Q.allocate(codes.withColumn("doc", F.col("doc") + 10), Q.counters(first))
    assert sorted(r.ordinal for r in more.collect()) == [3, 4, 5]


def test_dataset_versions(spark, tmp_path):
    rows = spark.createDataFrame([("q", [1, 2, 3, 4, 0], "d", "title", 1.0, "cs", "v1")], "input_text string, target_codes array<int>, doc_id string, source string, weight double, corpus_snapshot string, id_schema string")
    m = sources.write_dataset(rows, str(tmp_path), "one")
    assert m["rows"] == 1 and sources.read_dataset(spark, str(tmp_path), "one").first()["hard_negatives"] == []
    with pytest.raises(Exception, match="exist"):
        sources.write_dataset(rows, str(tmp_path), "one")
    with pytest.raises(ValueError, match="missing"):
        sources.check_rows(rows.drop("weight"))


def _cell(v):
    return str(round(v, 5) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    r = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_cell(x) for x in row) for row in r.fetchall())
    assert sorted(tuple(_cell(row[c]) for c in names) for row in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_full_prefix(spark):
    codes = spark.range(1000).select(F.col("id").alias("doc"), *[F.lit(3).alias(f"c{i}") for i in range(1, 5)])
    rows = Q.allocate(codes).select("doc", "sid", "tail", F.hex("packed").alias("raw"), ids.ordinal(F.col("tail")).alias("back"), ids.short_text(F.col("sid")).alias("short")).orderBy("doc").collect()
    assert [r.back for r in rows] == list(range(1000)) and len({r.sid for r in rows}) == len({r.raw for r in rows}) == 1000
    assert [r.tail for r in rows] == sorted(r.tail for r in rows) and max(len(r.tail) for r in rows) == 7
    assert rows[764].short == rows[764].sid == "3.3.3.3.255.255.254" and rows[800].short == "3.3.3.3.255.255.35"
    far = spark.createDataFrame([(765 + 255**4 - 1,)], "n long").select(ids.long_tail(F.col("n")).alias("t"))
    assert far.first().t == [255, 255, 255, 254, 254, 254, 254] and far.select(ids.ordinal(F.col("t"))).first()[0] == 765 + 255**4 - 1

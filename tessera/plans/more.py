"""Queries: near-duplicate links, survival of prefixes, query checks, miss reasons, false negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import text as T
from tessera.operators import curation as C
from tessera.operators import dedup as D
from tessera.operators import quantize as Q
from tessera.operators import retrieve as R
from tessera.plans import lifecycle as L
from tessera.plans import retrieval as P
from tessera.sources import table
from tessera.sources.lineage import cut


def signed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Content hashes (doc, h), and the signatures of the first document of each; texts are read once."""
    every = cut(D.signatures(table(s, d, "documents").select(F.col("doc_id").alias("doc"), "text")))
    first = every.groupBy("h").agg(F.min("doc").alias("doc"))
    return every.select("doc", "h"), every.join(first.select("doc"), "doc", "left_semi").select("doc", "key", "sig")


def near_dup_links(s: SparkSession, d: str) -> DataFrame:
    """Links of canonical documents: merged from 0.99 on, else linked."""
    return D.agreeing(signed(s, d)[1]).select("a", "b", F.round("j", 6).alias("j"), F.when(F.col("j") >= 0.99, "merge").otherwise("link").alias("kind"))


NEAR_SQL = rf"""
WITH c AS (SELECT min(doc_id) AS doc, arg_min(text, doc_id) AS text FROM documents GROUP BY {P.fold(P.clean_sql('text'))}),
w AS (SELECT doc, regexp_extract_all({P.fold('text')}, '\S+') AS w FROM c),
g AS (SELECT doc, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM w),
h AS (SELECT DISTINCT doc, CAST('0x' || substr(sha256(x), 1, 15) AS BIGINT) % {D.PRIME} AS h FROM (SELECT doc, unnest(g) AS x FROM g)),
p AS (SELECT i, (i * 48271 * 7919 + 1) % {D.PRIME} AS a, (i * 69621 * 104729 + 7) % {D.PRIME} AS b FROM (SELECT unnest(range(1, 129))::BIGINT AS i)),
s AS MATERIALIZED (SELECT doc, i, min((h * a + b) % {D.PRIME}) AS v FROM h, p GROUP BY doc, i),
k AS (SELECT doc, (i - 1) // 4 AS band, string_agg(v, '-' ORDER BY i) AS key FROM s GROUP BY doc, band),
q AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM k x JOIN k y ON x.band = y.band AND x.key = y.key AND x.doc < y.doc),
j AS (SELECT q.a, q.b, count(*) / 128 AS j FROM q JOIN s x ON x.doc = q.a JOIN s y ON y.doc = q.b AND y.i = x.i AND y.v = x.v GROUP BY q.a, q.b)
SELECT a, b, round(j, 6) AS j, CASE WHEN j >= 0.99 THEN 'merge' ELSE 'link' END AS kind FROM j WHERE j >= 0.85"""


def prefix_survival(s: SparkSession, d: str) -> DataFrame:
    """How deep the beam keeps the query's own codes: shares of queries by depth."""
    codes = L._codes(s, d)
    issued = Q.allocate(codes)
    v = L._vectors(s, d).where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vec")
    found = Q.beam(v, issued, L._books(s, d)).select("qid", F.split("prefix", r"\.").alias("p"))
    gold = codes.select(F.col("doc").alias("qid"), F.transform(F.array("c1", "c2", "c3", "c4"), lambda c: c.cast("string")).alias("g"))
    same = [F.max((F.slice("p", 1, n) == F.slice("g", 1, n)).cast("int")).alias(f"d{n}") for n in range(1, 5)]
    each = found.join(gold, "qid").groupBy("qid").agg(*same)
    return each.agg(*[F.round(F.avg(f"d{n}"), 6).alias(f"depth_{n}") for n in range(1, 5)], F.count("*").alias("n"))


def query_checks(s: SparkSession, d: str) -> DataFrame:
    """Each document's first line as a generated query: does it leak, and does it find its document?"""
    docs = table(s, d, "documents")
    line = F.split("text", "\n")[0]
    q = cut(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("doc"), line.alias("text")))
    leak = C.leaking(q.join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body")), "doc").select("doc", "body", F.array("text").alias("parts")))
    found = R.round_trip(q, docs, 50).select(F.col("qid").alias("doc"), F.lit(True).alias("round_trip"))
    return leak.join(found, "doc", "left").select(F.col("doc").alias("qid"), "n_tokens", "leaks", F.coalesce("round_trip", F.lit(False)).alias("round_trip"))


def miss_reason(s: SparkSession, d: str) -> DataFrame:
    """Why a wanted document was not returned: the first reason that holds."""
    reg = L.registry_fold(s, d).select("doc", "state")
    want = table(s, d, "customer").select(F.col("c_custkey").alias("doc"))
    pool = table(s, d, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.max("o_totalprice").alias("ce"))
    r = want.join(reg, "doc", "left").join(pool, "doc", "left")
    reason = (
        F.when(F.col("state").isNull(), "unknown_document")
        .when(F.col("state") == "TOMBSTONED", "tombstoned")
        .when(F.col("doc") % 4 == 0, "acl")
        .when(F.col("ce").isNull(), "not_in_pool")
        .when(F.col("ce") < 150000, "low_relevance")
        .when(F.col("state") == "ACTIVE_COLD_START", "cold_start")
        .otherwise("below_k")
    )
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


MISS_SQL = L.FOLD_SQL + """, p AS (SELECT o_custkey AS doc, max(o_totalprice) AS ce FROM orders GROUP BY 1),
r AS (SELECT CASE WHEN state IS NULL THEN 'unknown_document' WHEN state = 'TOMBSTONED' THEN 'tombstoned' WHEN c_custkey % 4 = 0 THEN 'acl' WHEN ce IS NULL THEN 'not_in_pool' WHEN ce < 150000 THEN 'low_relevance' WHEN state = 'ACTIVE_COLD_START' THEN 'cold_start' ELSE 'below_k' END AS reason FROM customer LEFT JOIN registry ON registry.doc = c_custkey LEFT JOIN p ON p.doc = c_custkey)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""


def lexical_negatives(s: SparkSession, d: str) -> DataFrame:
    """BM25 negatives without positives: documents of the top 20 that do not hold the passage,
    less those too like it for a scorer (overlap above 0.7)."""
    b, docs = P._bench(s, d), table(s, d, "documents")
    top = R.bm25(b, docs, 20)
    pos = P.leak_contamination(s, d).select("qid", F.col("doc_id").alias("doc"))
    neg = top.join(pos, ["qid", "doc"], "left_anti")
    t = neg.join(b.withColumnRenamed("text", "q"), "qid").join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc")
    return t.select("qid", "doc", F.round(T.overlap(F.col("q"), F.col("text")), 6).alias("v")).where("v <= 0.7")


NEG_SQL = f"WITH pos AS ({P.LEAK_SQL}), {P.bm25_sql('r', 20)}, q AS (SELECT item_id AS qid, list_distinct({P.toks('text')}) AS q FROM benchmark), x AS (SELECT doc_id AS doc, list_distinct({P.toks('text')}) AS t FROM documents), n AS (SELECT qid, doc, round(len(list_intersect(q, t)) / greatest(len(q), 1), 6) AS v FROM r JOIN q USING (qid) JOIN x USING (doc) WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.qid = r.qid AND pos.doc_id = r.doc)) SELECT qid, doc, v FROM n WHERE v <= 0.7"
_LINES = "(SELECT doc_id AS item_id, string_split(text, chr(10))[1] AS text FROM documents)"
CHECK_SQL = "WITH " + P.bm25_sql("r", 50).replace("FROM benchmark", f"FROM {_LINES}") + rf""", a AS (SELECT item_id AS qid, {P.toks('text')} AS t FROM {_LINES}), b AS (SELECT doc_id AS qid, {P.toks('text')} AS u FROM documents),
g AS (SELECT qid, len(t) AS n_tokens, list_distinct(list_transform(range(1, greatest(len(t) - 4, 1)), lambda i: array_to_string(t[i:i + 5], ' '))) AS ga, list_distinct(list_transform(range(1, greatest(len(u) - 4, 1)), lambda i: array_to_string(u[i:i + 5], ' '))) AS gb FROM a JOIN b USING (qid))
SELECT qid, n_tokens, CASE WHEN len(ga) = 0 THEN false ELSE len(list_intersect(ga, gb)) / len(ga) > 0.5 END AS leaks, EXISTS (SELECT 1 FROM r WHERE r.qid = g.qid AND r.doc = g.qid) AS round_trip FROM g"""
SURVIVAL_SQL = L._beam_sql().rsplit(" SELECT qid", 1)[0] + ", o AS (SELECT w4.qid, " + ", ".join(f"max((list_slice(string_split(prefix, '.'), 1, {n}) = list_slice([CAST(c1 AS VARCHAR), CAST(c2 AS VARCHAR), CAST(c3 AS VARCHAR), CAST(c4 AS VARCHAR)], 1, {n}))::INT) AS d{n}" for n in range(1, 5)) + " FROM w4 JOIN codes ON codes.doc = w4.qid GROUP BY w4.qid) SELECT " + ", ".join(f"round(avg(d{n}), 6) AS depth_{n}" for n in range(1, 5)) + ", count(*) AS n FROM o"

register("near_dup_links", near_dup_links, NEAR_SQL)
register("prefix_survival", prefix_survival, SURVIVAL_SQL)
register("query_checks", query_checks, CHECK_SQL)
register("miss_reason", miss_reason, MISS_SQL)
register("lexical_negatives", lexical_negatives, NEG_SQL)

"""Queries: a training dataset built in one job, and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import text as T
from tessera.operators import builds as B
from tessera.operators import quantize as Q
from tessera.operators import retrieve as R
from tessera.operators import training as TR
from tessera.plans import lifecycle as L
from tessera.plans import retrieval as P
from tessera.sources import table
from tessera.sources.lineage import cut

MOST, LEAST = 5, 3


def _build(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents with an identifier; passages and their first sentences as queries of a document that they find; user turns
    before the fifth as logs; negatives by prefix, by BM25 and by chance."""
    docs = table(s, d, "documents")
    issued = cut(Q.allocate(L._codes(s, d)).select("doc", "c1", "c2", "c3", "c4", "codes", "ordinal"))
    corpus = docs.select(
        F.col("doc_id").alias("doc"), F.split("text", "\n")[0].alias("title"), "text", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang").alias("metadata"), T.content_hash(F.col("text")).alias("twin"),
    ).join(issued.select("doc", "codes", "ordinal"), "doc")
    bench = table(s, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    hits = cut(R.bm25(bench, docs, 50).select("qid", "doc", "rank"))
    asked = bench.join(hits.where("rank = 1 + qid % 3").select("qid", F.col("doc").alias("home")), "qid")
    each = asked.select("qid", F.col("home").alias("doc"), F.posexplode(F.array("text", F.regexp_extract("text", r"^[^.]*", 0))).alias("n", "text"))
    cands = each.select("doc", (F.col("qid") * 2 + F.col("n")).alias("pos"), "text", (F.col("qid") % 7 != 0).alias("found"))
    turns = table(s, d, "conversations").where("role = 'user'")
    logs = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("qid"), "text", F.col("turn").alias("ts"))
    every = F.lit(None).cast("string").alias("row_id")
    near = cut(TR.siblings(issued)).select("doc", every, F.lit("prefix_sibling").alias("source"), F.col("sibling").alias("other"), (F.lit(3) - F.col("level")).alias("pos"))
    alike = each.select("qid", F.col("doc").alias("home"), (F.col("qid") * 2 + F.col("n")).alias("p")).join(hits.where("rank <= 20"), "qid")
    lexical = alike.select(F.col("home").alias("doc"), F.concat(F.lit("synthetic_query-"), "p").alias("row_id"), F.lit("bm25").alias("source"), F.col("doc").alias("other"), F.col("rank").alias("pos"))
    pools = near.unionByName(lexical).unionByName(B.random_pool(issued))
    return B.build(corpus, cands, logs, pools, before=F.lit(5), least=LEAST, most=MOST)


def training_build(s: SparkSession, d: str) -> DataFrame:
    rows = _build(s, d)[0]
    target = F.concat_ws(".", F.array_join(F.transform("codes", lambda c: c.cast("string")), "."), "ordinal")
    return rows.select("doc_id", "row_id", "source", F.sha2("input", 256).alias("input_hash"), target.alias("target"), F.round("weight", 6).alias("weight"), F.array_join(F.transform("negatives", lambda n: n["doc"].cast("string")), ",").alias("negatives"))


def training_report(s: SparkSession, d: str) -> DataFrame:
    return _build(s, d)[1]


def _norm(x: str) -> str:
    return rf"trim(regexp_replace({P.fold(x)}, '\s+', ' ', 'g'))"


def _grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({x}) - {n - 2}, 1)), lambda i: array_to_string({x}[i:i + {n - 1}], ' ')))"


def _bin(kind: str) -> str:
    return f"CAST(floor(CAST('0x' || substr(sha256('{kind}:' || doc), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE * greatest(1, (SELECT count(*) FROM issued) // 9)) AS BIGINT)"


SIBLINGS = " UNION ALL ".join("SELECT a.doc, {0} AS level, b.doc AS sibling, b.h FROM h a JOIN h b ON a.c{1} <> b.c{1}{2}".format(n, n + 1, "".join(f" AND a.c{i} = b.c{i}" for i in range(1, n + 1))) for n in range(4))
BUILD_SQL = rf"""WITH RECURSIVE {L.RQ}, {P.bm25_sql('r', 50)},
corpus AS (SELECT i.*, text, string_split(text, chr(10))[1] AS title, lang, source, {P.fold(P.clean_sql('text'))} AS twin, CAST('0x' || substr(sha256('20260901:' || doc), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE < 0.05 AS held FROM issued i JOIN documents ON doc_id = doc),
each AS (SELECT qid, r.doc, n, CASE n WHEN 0 THEN text ELSE regexp_extract(text, '^[^.]*') END AS text FROM r JOIN benchmark ON item_id = qid AND rank = 1 + qid % 3, (SELECT unnest([0, 1]) AS n)),
grams AS (SELECT doc, qid * 2 + n AS pos, e.text, qid % 7 <> 0 AS found, {P.toks('e.text')} AS t, {P.toks('c.text')} AS u, row_number() OVER (PARTITION BY doc ORDER BY qid, n) AS k FROM each e JOIN corpus c USING (doc) WHERE NOT held),
g AS (SELECT doc, pos, text, found, t, k, {_grams('t', 3)} AS g3, {_grams('t', 6)} AS a, {_grams('u', 6)} AS b FROM grams),
cand AS (SELECT x.doc, x.pos, x.text, x.found, x.k, CASE WHEN len(x.a) = 0 THEN false ELSE len(list_intersect(x.a, x.b)) / len(x.a) > 0.5 END AS leaks,
  coalesce((SELECT list(y.k) FROM g y WHERE y.doc = x.doc AND y.k < x.k AND CASE WHEN len(x.g3) = 0 OR len(y.g3) = 0 THEN x.t = y.t ELSE len(list_intersect(x.g3, y.g3)) / len(list_distinct(x.g3 || y.g3)) > 0.8 END), []) AS likes FROM g x),
fold(doc, k, kept, pos, text, verdict) AS (SELECT DISTINCT doc, 0::BIGINT, []::BIGINT[], 0::BIGINT, '', '' FROM cand UNION ALL
  SELECT doc, k, CASE WHEN v = 'accepted' THEN list_append(kept, k) ELSE kept END, pos, text, v FROM (SELECT c.doc, c.k, f.kept, c.pos, c.text, CASE WHEN len(f.kept) >= 10 THEN 'unseen' WHEN len(list_intersect(f.kept, c.likes)) > 0 THEN 'duplicate' WHEN leaks THEN 'leaked' WHEN NOT found THEN 'round_trip_failed' ELSE 'accepted' END AS v FROM fold f JOIN cand c ON c.doc = f.doc AND c.k = f.k + 1)),
told AS (SELECT doc, 'synthetic_query-' || pos AS row_id, 'synthetic_query' AS source, 'query: ' || {_norm('text')} AS input FROM fold WHERE verdict = 'accepted'
  UNION ALL SELECT conv_id, 'real_query-' || turn, 'real_query', 'query: ' || {_norm("coalesce(v.text, '')")} FROM conversations v JOIN corpus ON doc = conv_id WHERE role = 'user' AND turn < 5 AND NOT held
  UNION ALL SELECT doc, 'title', 'title', 'query: ' || {_norm('title')} FROM corpus WHERE NOT held AND title <> ''
  UNION ALL SELECT doc, 'content_prefix', 'content_prefix', 'document: ' || {_norm(r"array_to_string(regexp_extract_all(coalesce(text, ''), '\S+')[1:48], ' ')")} FROM corpus WHERE NOT held
  UNION ALL SELECT doc, 'metadata', 'metadata', 'query: ' || {_norm("concat_ws('; ', 'lang: ' || lang, 'source: ' || source)")} FROM corpus WHERE NOT held AND (lang IS NOT NULL OR source IS NOT NULL)),
even AS (SELECT *, CASE WHEN source = 'real_query' THEN 3.0::DOUBLE ELSE 1 END * CASE WHEN bool_or(source = 'real_query') OVER (PARTITION BY doc) THEN 1.0::DOUBLE ELSE 1.5 END AS w FROM told QUALIFY row_number() OVER (PARTITION BY doc ORDER BY source = 'real_query' DESC, sha256(doc || ':' || row_id)) <= {MOST}),
fam AS (SELECT source, sum(w) AS w, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in B.RATIOS.items())} END::DOUBLE AS ratio FROM even GROUP BY source),
fac AS (SELECT source, ratio / sum(ratio) OVER () * sum(w) OVER () / w AS f FROM fam), mixed AS (SELECT doc, row_id, source, input, w * f AS weight FROM even JOIN fac USING (source)),
h AS (SELECT *, sha256(CAST(doc AS VARCHAR)) AS h FROM issued), sib AS (SELECT doc, level, sibling FROM ({SIBLINGS}) QUALIFY row_number() OVER (PARTITION BY doc, level ORDER BY h) <= 2),
bins AS (SELECT doc, {_bin('bin')} AS bin, {_bin('ask')} AS ask FROM issued),
wide AS (SELECT doc, 0 AS prio, sibling AS other, 3 - level AS pos FROM sib UNION ALL SELECT a.doc, 2, b.doc, 0 FROM bins a JOIN bins b ON a.ask = b.bin),
pool AS (SELECT doc, row_id, prio, other, pos FROM wide JOIN mixed USING (doc) WHERE source <> 'content_prefix' UNION ALL
  SELECT e.doc, row_id, 1, r.doc, rank FROM each e JOIN mixed m ON m.doc = e.doc AND m.row_id = 'synthetic_query-' || (e.qid * 2 + e.n) JOIN r ON r.qid = e.qid AND rank <= 20),
pl AS (SELECT p.doc || '/' || row_id AS qid, prio, other AS doc, min(pos) AS pos FROM pool p JOIN corpus a ON a.doc = p.doc JOIN corpus b ON b.doc = other WHERE a.doc <> b.doc AND NOT coalesce(a.twin = b.twin, false) GROUP BY ALL),
s1 AS (SELECT qid, doc, 0 AS round, pos FROM pl WHERE prio = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos, doc) <= 3),
s2 AS (SELECT qid, doc, 1 AS round, pos FROM pl ANTI JOIN s1 USING (qid, doc) WHERE prio = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos, doc) <= 2),
tk AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2), al AS (SELECT * FROM tk UNION ALL SELECT qid, doc, 3 + prio, pos FROM pl ANTI JOIN tk USING (qid, doc)),
on1 AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY round, pos) = 1),
ng AS (SELECT qid, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY place) AS negatives, count(*) AS k FROM (SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY round, pos, doc) AS place FROM on1) WHERE place <= 8 GROUP BY qid)"""
ROWS = BUILD_SQL + " SELECT doc AS doc_id, row_id, source, sha256(input) AS input_hash, c1 || '.' || c2 || '.' || c3 || '.' || c4 || '.' || ordinal AS target, round(weight, 6) AS weight, coalesce(negatives, '') AS negatives FROM mixed JOIN issued USING (doc) LEFT JOIN ng ON qid = doc || '/' || row_id"
REPORT = BUILD_SQL + f""", v AS (SELECT doc, count(*) AS n, count(*) FILTER (verdict = 'accepted') AS ok FROM fold WHERE k > 0 GROUP BY doc), u AS (SELECT count(m.doc) AS n FROM corpus c LEFT JOIN mixed m USING (doc) WHERE NOT held GROUP BY c.doc)
SELECT name, CAST(value AS DOUBLE) AS value FROM (SELECT 'docs' AS name, count(*) AS value FROM corpus UNION ALL SELECT 'held_out_docs', count(*) FILTER (held) FROM corpus UNION ALL SELECT 'generated', count(*) FROM cand UNION ALL SELECT x, (SELECT count(*) FROM fold WHERE verdict = x) FROM (SELECT unnest({B.C.VERDICTS}) AS x)
UNION ALL SELECT 'low_coverage_docs', count(*) FILTER (ok < {LEAST}) FROM v UNION ALL SELECT 'rows', count(*) FROM mixed UNION ALL SELECT 'negatives', coalesce(sum(k), 0) FROM ng UNION ALL SELECT 'units_below_floor', count(*) FILTER (n < {LEAST}) FROM u)
UNION ALL SELECT 'share_' || source, round(sum(weight) / (SELECT sum(weight) FROM mixed), 6) FROM mixed GROUP BY source"""

register("training_build", training_build, ROWS)
register("training_report", training_report, REPORT)

"""Queries: approximate search over a partitioned index, fusion of a lexical and a dense run, gates on what both reach."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import approximate as X
from tessera.operators import decode as D
from tessera.operators import evaluate as E
from tessera.operators import quantize as Q
from tessera.operators import retrieve as R
from tessera.plans import lifecycle as L
from tessera.plans import retrieval as P
from tessera.sources import table

CELLS, PROBES = 24, 6


def _asked(s: SparkSession, d: str) -> DataFrame:
    return L._vectors(s, d).where("doc % 50 = 0").withColumnRenamed("doc", "qid")


def approximate_search(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector against an index of sampled centroids, as SQL can state them."""
    return X.search(_asked(s, d), X.build(L._vectors(s, d), CELLS, rounds=0), 10, PROBES)


APPROXIMATE_SQL = f"""
v AS (SELECT vec_id AS doc, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * z), 'sum'))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_aggregate(list_transform(CAST(embedding AS DOUBLE[]), lambda z: z * z), 'sum') > 0),
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(doc::VARCHAR), doc) - 1 AS cell, e AS m FROM v QUALIFY cell < {CELLS}),
n AS MATERIALIZED (SELECT doc, cell, row_number() OVER (PARTITION BY doc ORDER BY round(list_inner_product(e, m), 9) DESC, cell) AS place FROM v, c),
apx AS (SELECT * FROM (SELECT q.doc AS qid, d.doc, round(list_inner_product(q.e, d.e), 6) AS score, row_number() OVER (PARTITION BY q.doc ORDER BY round(list_inner_product(q.e, d.e), 9) DESC, d.doc) AS rank
  FROM v q JOIN n a ON a.doc = q.doc AND a.place <= {PROBES} AND q.doc % 50 = 0 JOIN n b ON b.cell = a.cell AND b.place = 1 JOIN v d ON d.doc = b.doc AND d.doc <> q.doc) WHERE rank <= 10)"""


def approximate_recall(s: SparkSession, d: str) -> DataFrame:
    """How much of the exact ten a fitted index finds with the probes that its tuning asks for."""
    vectors = L._vectors(s, d)
    index = X.build(vectors)
    found = X.search(_asked(s, d), index, 10, X.tune(index, vectors))
    return X.recall(found, R.dense(_asked(s, d), vectors, 10))


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """Every fiftieth document asks by its first line in the texts and by its vector in the index; both runs are fused."""
    line = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    docs = table(s, d, "documents")
    lexical = R.bm25(docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), line.alias("text")), docs.select("doc_id", "text"), 20)
    return R.rrf([lexical, approximate_search(s, d)], depth=20).select("qid", "doc", "score", "rank")


_LINES = "(SELECT doc_id AS qid, list_extract(string_split(coalesce(text, ''), chr(10)), 1) AS text FROM documents WHERE doc_id % 50 = 0)"
register("approximate_search", approximate_search, f"WITH {APPROXIMATE_SQL} SELECT qid, doc, score, rank FROM apx")
register("approximate_recall", approximate_recall)
register("hybrid_search", hybrid_search, f"""WITH {P.bm25_sql('r', 20, asked=_LINES)}, {APPROXIMATE_SQL},
p AS (SELECT qid, doc, 1.0 / (60 + rank) AS part, rank AS seen FROM r UNION ALL SELECT qid, doc, 1.0 / (60 + rank), 1000000 + rank FROM apx),
f AS (SELECT qid, doc, round(sum(part), 9) AS score, min(seen) AS seen FROM p GROUP BY qid, doc)
SELECT * FROM (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS rank FROM f) WHERE rank <= 20""")


# ------------------------------------------------------------ gates


def _measured(s: SparkSession, d: str, run: DataFrame, issued: bool = False) -> DataFrame:
    """(metric, value) of a run against the labels' judgements, and of the identifiers."""
    m = E.evaluate_run(run, P._dense_qrels(s, d))
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in _METRICS.items()])).alias("x")).select("x.*")
    if issued:
        rows = rows.union(D.escape_rate(Q.allocate(L._codes(s, d))).select(F.lit("escape_rate"), "escape_rate"))
    return rows


_METRICS = {"ndcg@10": "ndcg_10", "recall@10": "recall_10", "mrr@10": "mrr_10"}


def release_gates(s: SparkSession, d: str) -> DataFrame:
    """Whether the approximate index may take the exact search's place, by the gates of a release."""
    return E.gate_results(_measured(s, d, approximate_search(s, d), issued=True), _measured(s, d, P.dense_exact(s, d)))


def adapter_gates(s: SparkSession, d: str) -> DataFrame:
    """The gates of an adapter for the exact search without an incumbent, the approximate one as floor; and the verdict's row."""
    r = E.gate_results(_measured(s, d, P.dense_exact(s, d), issued=True), kind=E.ADAPTER, baseline=_measured(s, d, approximate_search(s, d)), offline=True)
    v = E.verdict(r)
    return r.select("gate", "value", "incumbent", "passed").union(v.select(F.concat(F.lit("all but "), "failures"), F.col("gates").cast("double"), F.lit(None).cast("double"), "passed"))


def _gates_sql(kind: str, offline: bool, own: str, other: str, incumbent: bool) -> str:
    """Gates of a kind; `own` and `other` name the measured run and what it is held against."""
    names = "".join(f", ({c!r}, {m!r})" for m, c in _METRICS.items())[2:]
    rows = ", ".join(f"('{a}', '{m}', '{rule}', CAST({t if incumbent or rule not in ('drop', 'ratio') else 0.0} AS DOUBLE))" for a, m, rule, t, kinds, off in E.GATES if kind in kinds.split(",") and (off or not offline))
    measured = lambda name, run: re.sub(r"\b([ihm])\b(?= AS \()|(?<=FROM )i\b|(?<=JOIN )h\b", lambda x: f"{name}{x.group(0)}", P.METRICS_SQL.replace("dense", run))
    value = lambda name: f"{name}v AS (SELECT metric, value FROM (UNPIVOT (SELECT {', '.join(f'round(avg({c}), 6)::DOUBLE AS {c}' for c in _METRICS.values())} FROM {name}m) ON COLUMNS(*) INTO NAME c VALUE value) JOIN (VALUES {names}) n(c, metric) USING (c))"
    return f"""WITH {L.RQ}, {P.DENSE_SQL}, {APPROXIMATE_SQL.replace("v AS (", "av AS (", 1).replace("FROM v ", "FROM av ").replace("FROM v,", "FROM av,").replace("JOIN v ", "JOIN av ")}, {P.QRELS_SQL},
{measured('o', own)}, {measured('p', other)}, {value('o')}, {value('p')},
mv AS (SELECT * FROM ov UNION ALL SELECT 'escape_rate', round(avg((ordinal >= 255)::INT), 6) FROM issued),
g(gate, metric, rule, threshold) AS (VALUES {rows}),
z AS (SELECT gate, mv.value, {'pv.value' if incumbent else "CASE WHEN rule IN ('drop', 'ratio') THEN pv.value END"} AS incumbent, coalesce(CASE rule WHEN 'eq' THEN mv.value = threshold WHEN 'ge' THEN mv.value >= threshold WHEN 'le' THEN mv.value <= threshold WHEN 'drop' THEN mv.value >= pv.value - threshold ELSE mv.value <= pv.value * (1 + threshold) END, false) AS passed
  FROM g LEFT JOIN mv USING (metric) LEFT JOIN pv USING (metric)) SELECT gate, value, incumbent, passed FROM z"""


register("release_gates", release_gates, _gates_sql(E.FULL, False, "apx", "dense", True))
register("adapter_gates", adapter_gates, _gates_sql(E.ADAPTER, True, "dense", "apx", False) + " UNION ALL SELECT 'all but ' || coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed), ''), count(*)::DOUBLE, NULL, bool_and(passed) FROM z")

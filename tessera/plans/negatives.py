"""Queries: dense and self-mined negatives, a decoder by slices of its queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.operators import negatives as N
from tessera.operators import retrieve as R
from tessera.plans import decoding as DEC
from tessera.plans import lifecycle as L
from tessera.plans import retrieval as P
from tessera.sources import table


def dense_negatives(s: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of another label for every fiftieth one."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"), "label")
    asked = v.where("doc % 50 = 0").withColumnRenamed("doc", "qid")
    return R.dense(asked, v, 10, apart="label").select("qid", "doc", "rank")  # its label's vectors are a query's positives


def _gold(s: SparkSession, d: str) -> DataFrame:
    """A query's own document for half of them, the one after it for the others."""
    return DEC._queries(s, d).select("qid", F.when(F.col("qid") % 100 == 0, F.col("qid")).otherwise(F.col("qid") + 1).alias("doc"))


def self_negatives(s: SparkSession, d: str) -> DataFrame:
    return N.above_gold(DEC._decoded(s, d), _gold(s, d), 5)


def decoder_slices(s: SparkSession, d: str) -> DataFrame:
    held = L._vectors(s, d).where("doc % 3 = 0").select("doc")
    return N.by_slice(DEC._decoded(s, d), _gold(s, d), held)


_GOLD = "gold AS (SELECT doc AS qid, CASE WHEN doc % 100 = 0 THEN doc ELSE doc + 1 END AS g FROM x WHERE doc % 50 = 0)"
register("dense_negatives", dense_negatives, f"""WITH {P.DENSE_SQL}, n AS (SELECT q.vec_id AS qid, d.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.e, d.e) / (q.n * d.n), 9) DESC, d.vec_id) AS rank FROM u q JOIN u d ON q.vec_id % 50 = 0 AND q.label <> d.label)
SELECT qid, doc, rank FROM n WHERE rank <= 10""")
register("self_negatives", self_negatives, f"""{DEC.DECODE_SQL}, {_GOLD}, a AS (SELECT qid, doc, rank, min(CASE WHEN doc = g THEN rank END) OVER (PARTITION BY qid) AS lim FROM fc JOIN gold USING (qid))
SELECT qid, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, doc) AS place FROM a WHERE lim IS NULL OR rank < lim) WHERE place <= 5""")
register("decoder_slices", decoder_slices, f"""{DEC.DECODE_SQL}, {_GOLD}, b AS (SELECT qid, min(CASE WHEN doc = g AND rank <= 10 THEN rank END) AS p, round(1 / (1 + exp(-max(score))), 6) AS confidence FROM fc JOIN gold USING (qid) GROUP BY qid),
e AS (SELECT gold.qid, p, confidence, unnest(['all', CASE WHEN g % 3 = 0 THEN 'held_out' ELSE 'known' END]) AS slice FROM gold LEFT JOIN b ON b.qid = gold.qid),
r AS (SELECT slice, count(*) AS queries, avg((p IS NOT NULL)::INT) AS recall, avg(coalesce(1 / p, 0)) AS mrr, avg(coalesce((p = 1)::INT, 0)) AS first, avg(confidence) AS confidence FROM e GROUP BY slice)
SELECT slice, queries, round(recall, 4) AS recall, round(mrr, 4) AS mrr, round(first, 4) AS first, round(confidence, 4) AS confidence, round(confidence - first, 4) AS gap FROM r""")

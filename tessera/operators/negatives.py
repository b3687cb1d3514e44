"""Negatives out of rankings, and what a decoder is worth by slices of its queries.

Defined results: a query without positives keeps all it found; a gold document that was not found
has every candidate above it; null documents are nobody's positive; repeated positives count
once; queries without candidates count as misses of confidence null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (queries, k) -> (qid, doc, score, rank)
Search = Callable[[DataFrame, int], DataFrame]


def without_positives(ranked: DataFrame, positives: DataFrame, n: int) -> DataFrame:
    """The first n of each query's (qid, doc, rank) that are not its positives (qid, doc), ranked anew."""
    rest = ranked.join(positives.select("qid", "doc").distinct(), ["qid", "doc"], "left_anti")
    w = Window.partitionBy("qid").orderBy("rank", "doc")
    return rest.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def searched(queries: DataFrame, positives: DataFrame, search: Search, n: int = 100) -> DataFrame:
    """Negatives by any search: so deep that n are left of every query whatever its positives take."""
    most = positives.distinct().groupBy("qid").agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    return without_positives(search(queries, n + most), positives, n)


def above_gold(candidates: DataFrame, gold: DataFrame, most: int = 8) -> DataFrame:
    """(qid, doc, rank) that the decoder ranks above each query's gold document (qid, doc), `most` at most."""
    own = candidates.select("qid", "doc", "rank").join(gold.select("qid", F.col("doc").alias("gold_")), "qid")
    limit = F.min(F.when(F.col("doc") == F.col("gold_"), F.col("rank"))).over(Window.partitionBy("qid"))
    above = own.withColumn("limit_", limit).where("limit_ IS NULL OR rank < limit_")
    w = Window.partitionBy("qid").orderBy("rank", "doc")
    return above.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("qid", "doc", "rank")


def by_slice(candidates: DataFrame, gold: DataFrame, held_out: DataFrame, k: int = 10) -> DataFrame:
    """(slice, queries, recall, mrr, first, confidence, gap): one pass over the queries for all of them, those
    whose gold document is held out (doc) and the others. `gap` is how much surer the decoder is
    than its first answers are right."""
    best = candidates.join(gold.select("qid", F.col("doc").alias("gold_")), "qid").groupBy("qid").agg(
        F.min(F.when((F.col("doc") == F.col("gold_")) & (F.col("rank") <= k), F.col("rank"))).alias("at"), F.max("confidence").alias("confidence"),
    )
    rows = gold.join(best, "qid", "left").join(held_out.select("doc", F.lit(True).alias("held")).distinct(), "doc", "left")
    own = F.when(F.coalesce("held", F.lit(False)), "held_out").otherwise("known")
    each = rows.select("at", "confidence", F.explode(F.array(F.lit("all"), own)).alias("slice"))
    first = F.coalesce((F.col("at") == 1).cast("double"), F.lit(0.0))
    out = each.groupBy("slice").agg(
        F.count("*").alias("queries"), F.avg(F.col("at").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("at"), F.lit(0.0))).alias("mrr"), F.avg(first).alias("first"), F.avg("confidence").alias("confidence"),
    )
    return out.select("slice", "queries", *[F.round(c, 4).alias(c) for c in ("recall", "mrr", "first", "confidence")], F.round(F.col("confidence") - F.col("first"), 4).alias("gap"))

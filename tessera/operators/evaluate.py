"""Ranking metrics, calibration, release gates and planning figures.

Defined results: queries without judgements do not count, without a run they have zeros; null
probabilities or labels are left out of averages; ties keep the run's ranks; empty tables give
zeros or no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FULL, ADAPTER = "full_retrain", "adapter_refresh"
# Release gates (name, metric, rule, threshold, kinds, measured offline). Rules: eq, ge, le against
# the threshold; drop: at most that far below the incumbent; ratio: at most that share above.
GATES = [
    ("valid_id_rate", "valid_id_rate", "eq", 1.0, "full_retrain,adapter_refresh", True),
    ("ndcg@10", "ndcg@10", "drop", 0.005, "full_retrain,adapter_refresh", True),
    ("recall@10", "recall@10", "drop", 0.01, "full_retrain,adapter_refresh", True),
    ("mrr@10", "mrr@10", "drop", 0.01, "full_retrain,adapter_refresh", True),
    ("held_out_doc_recall@10", "held_out_doc_recall@10", "ge", 0.40, "full_retrain,adapter_refresh", True),
    ("old_doc_recall_regression", "old_doc_recall_regression_points", "le", 1.0, "adapter_refresh", True),
    ("cold_doc_recall", "cold_doc_recall_ratio", "ge", 0.6, "adapter_refresh", True),
    ("ece", "ece", "le", 0.05, "full_retrain,adapter_refresh", True),
    ("stale_id_rate", "stale_id_rate", "le", 0.001, "full_retrain,adapter_refresh", True),
    ("escape_rate", "escape_rate", "le", 0.005, "full_retrain,adapter_refresh", True),
    ("channel_c_query_share", "channel_c_query_share", "le", 0.15, "full_retrain,adapter_refresh", False),
    ("channel_a_result_share", "channel_a_result_share", "ge", 0.70, "full_retrain,adapter_refresh", False),
    ("p95_latency", "p95_latency_ms", "ratio", 0.15, "full_retrain,adapter_refresh", False),
    ("cost_per_1k", "cost_per_1k_queries", "ratio", 0.20, "full_retrain,adapter_refresh", False),
    ("cross_tenant_leaks", "cross_tenant_leaks", "le", 0.0, "full_retrain,adapter_refresh", False),
]


def query_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per judged query: recall, precision, mrr, ndcg, hit and success. run: (qid, doc, rank
    from 1), qrels: (qid, doc, grade). A query without a run has zeros."""
    pos = qrels.where("grade > 0")
    by_grade = Window.partitionBy("qid").orderBy(F.desc("grade"), "doc")
    ideal = pos.withColumn("i", F.row_number().over(by_grade)).groupBy("qid").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("i") <= 10, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg")
    )
    hit = run.join(pos, ["qid", "doc"]).groupBy("qid").agg(
        F.count_if(F.col("rank") <= 10).alias("h10"),
        F.count_if(F.col("rank") <= 100).alias("h100"),
        F.count_if(F.col("rank") <= 5).alias("h5"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    judged = qrels.select("qid").distinct().join(ideal, "qid", "left").join(hit, "qid", "left")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return judged.select(
        "qid",
        z(F.col("h10") / F.col("relevant")).alias("recall_10"),
        z(F.col("h100") / F.col("relevant")).alias("recall_100"),
        z(F.col("h5") / 5).alias("precision_5"),
        F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0).alias("mrr_10"),
        z(F.col("dcg") / F.col("idcg")).alias("ndcg_10"),
        F.when(F.col("first") <= 1, 1.0).otherwise(0.0).alias("hit_1"),
        F.when(F.col("first") <= 10, 1.0).otherwise(0.0).alias("success_10"),
    )


METRICS = ["recall_10", "recall_100", "precision_5", "mrr_10", "ndcg_10", "hit_1", "success_10"]


def evaluate_run(run: DataFrame, qrels: DataFrame) -> DataFrame:
    each = query_metrics(run, qrels)
    return each.agg(*[F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS], F.count("*").alias("n_queries"))


def ece(rows: DataFrame, prob: str, label: str, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    cell = rows.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(prob).alias("p"), F.avg(label).alias("y"))
    return cell.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("n"))


def kendall_tau(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean sign of agreement over pairs that two short rankings (qid, doc, rank) share; 1 below two."""
    both = a.select("qid", "doc", F.col("rank").alias("ra")).join(b.select("qid", "doc", F.col("rank").alias("rb")), ["qid", "doc"])
    other = both.select("qid", F.col("ra").alias("ra2"), F.col("rb").alias("rb2"))
    pairs = both.join(other, "qid").where("ra < ra2").groupBy("qid").agg(F.avg(F.signum(F.col("rb2") - F.col("rb"))).alias("tau"))
    return a.select("qid").distinct().join(pairs, "qid", "left").select("qid", F.round(F.coalesce("tau", F.lit(1.0)), 6).alias("tau"))


def duplicate_rate(rows: DataFrame, group: str) -> DataFrame:
    return rows.agg(F.round(1 - F.countDistinct(group) / F.count("*"), 6).alias("duplicate_rate"))


def gate_results(metrics: DataFrame, incumbent: DataFrame | None = None, kind: str = FULL, baseline: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """One row per gate of the release kind: value, what it was held against, and whether it passed. What is not
    measured fails. A gate on the incumbent's value takes the baseline where there is none, without
    any tolerance, and fails without both. `offline` keeps what a training run can measure."""
    spark = metrics.sparkSession
    gates = spark.createDataFrame(GATES, "gate string, metric string, rule string, threshold double, kinds string, offline boolean").where(F.array_contains(F.split("kinds", ","), kind))
    gates = gates.where("offline") if offline else gates
    none = spark.createDataFrame([], "metric string, value double")
    r = gates.join(metrics.select("metric", F.col("value").alias("v")), "metric", "left")
    for name, table in (("i", incumbent), ("floor", baseline)):
        r = r.join((none if table is None else table).select("metric", F.col("value").alias(name)), "metric", "left")
    relative = F.col("rule").isin("drop", "ratio")
    tolerance = F.when(F.col("i").isNull() & relative, 0.0).otherwise(F.col("threshold"))
    against = F.when(relative, F.coalesce("i", "floor")).otherwise(F.col("i"))
    r = r.withColumn("t", tolerance).withColumn("against", against)
    ok = (
        F.when(F.col("rule") == "eq", F.col("v") == F.col("t")).when(F.col("rule") == "ge", F.col("v") >= F.col("t")).when(F.col("rule") == "le", F.col("v") <= F.col("t"))
        .when(F.col("rule") == "drop", F.col("v") >= F.col("against") - F.col("t")).otherwise(F.col("v") <= F.col("against") * (1 + F.col("t")))
    )
    return r.select("gate", F.col("v").alias("value"), F.col("against").alias("incumbent"), F.coalesce(ok, F.lit(False)).alias("passed"))


def verdict(results: DataFrame) -> DataFrame:
    """One row: whether every gate passed, how many there are, the names of those that failed."""
    names = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",")
    return results.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("passed"), F.count("*").alias("gates"), names.alias("failures"))


def hybrid_decision(own: Column, hybrid: Column, max_gap: float = 0.03) -> Column:
    """Near enough to the hybrid to go on at all."""
    return own >= hybrid - max_gap


def report(runs: dict[str, DataFrame], qrels: DataFrame) -> DataFrame:
    """(system, metrics...) of several runs on one set of judgements."""
    out = None
    for name, run in runs.items():
        row = evaluate_run(run, qrels).select(F.lit(name).alias("system"), *METRICS, "n_queries")
        out = row if out is None else out.union(row)
    return out


# Planning defaults.
COST_DEFAULTS = {
    "docs": 1_000_000.0, "units_per_doc": 1.0, "queries_generated": 16.0, "query_tokens": 20.0, "unit_tokens": 512.0, "prompt_share": 16.0, "gen_tokens_per_s": 20_000.0,
    "steps": 380_000.0, "batch_tokens": 65_000.0, "train_tokens_per_s": 150_000.0, "qps": 200.0, "encode_ms": 5.0, "decode_ms": 9.0, "rerank_ms": 13.0, "dense_encode_ms": 3.0,
    "cache_hit": 0.25, "batching_gain": 3.0, "gpu_hour": 1.20, "trie_bytes_per_doc": 10.0, "dim": 768.0, "hnsw_overhead": 0.45,
}


def costs(scenarios: DataFrame) -> DataFrame:
    """Planning figures of each scenario: its own columns where it has them, else the defaults."""
    p = {k: F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in scenarios.columns else F.lit(v) for k, v in COST_DEFAULTS.items()}
    units = p["docs"] * p["units_per_doc"]
    generation = units * p["queries_generated"] * (p["query_tokens"] + p["unit_tokens"] / p["prompt_share"]) / p["gen_tokens_per_s"] / 3600
    training = p["steps"] * p["batch_tokens"] / p["train_tokens_per_s"] / 3600
    served = 1000 / ((p["encode_ms"] + p["decode_ms"] + p["rerank_ms"]) * (1 - p["cache_hit"])) * p["batching_gain"]
    dense = 1000 / (p["dense_encode_ms"] + p["rerank_ms"]) * p["batching_gain"]
    per_1k = p["gpu_hour"] / served / 3.6
    gib = float(1 << 30)
    vectors = units * p["dim"] * 2 / gib
    figures = {
        "generation_hours": generation, "generation_cost": generation * p["gpu_hour"], "training_hours": training, "training_cost": training * p["gpu_hour"], "generation_share": generation / (generation + training),
        "gpus": p["qps"] / served, "cost_per_1k": per_1k, "dense_cost_per_1k": p["gpu_hour"] / dense / 3.6, "ratio_vs_dense": dense / served, "trie_gb": units * p["trie_bytes_per_doc"] / gib,
        "vectors_gb": vectors, "hnsw_gb": vectors * (1 + p["hnsw_overhead"]),
    }
    return scenarios.select("scenario", *(F.round(v, 6).alias(k) for k, v in figures.items()))

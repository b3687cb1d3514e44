"""Readers and writers: versioned datasets, JSON lines, run and judgement files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_ROWS = 1_000_000
REQUIRED = ["input_text", "target_codes", "doc_id", "source", "weight", "corpus_snapshot", "id_schema"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def check_rows(rows: DataFrame) -> DataFrame:
    """Training rows: required columns, five target codes, defaults for negatives."""
    missing = [c for c in REQUIRED if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    for name, kind in (("hard_negatives", "array<string>"), ("hard_negative_codes", "array<array<int>>")):
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), F.array().cast(kind)) if name in rows.columns else F.array().cast(kind))
    bad = F.raise_error(F.lit("target_codes must hold five codes"))
    return rows.withColumn("target_codes", F.when(F.size("target_codes") == 5, F.col("target_codes")).otherwise(bad.cast("array<int>")))


def manifest(rows: DataFrame) -> DataFrame:
    """One row: rows, schemas, snapshots, rows per source and an order-free digest."""
    per_source = rows.groupBy("source").agg(F.count("*").alias("n"), F.collect_set("id_schema").alias("schemas"), F.collect_set("corpus_snapshot").alias("snapshots"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*sorted(rows.columns))))).alias("x"))
    return per_source.agg(
        F.sum("n").alias("rows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("schemas")))).alias("schemas"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("snapshots")))).alias("snapshots"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("per_source"),
        F.hex(F.bit_xor("x")).alias("digest"),
    )


def write_dataset(rows: DataFrame, directory: str, version: str) -> dict:
    """Writes an immutable version (an existing one is an error) and its manifest."""
    rows = check_rows(rows)
    m = manifest(rows).first().asDict()
    if len(m["schemas"]) > 1:
        raise ValueError(f"more than one id schema: {m['schemas']}")
    rows.write.mode("errorifexists").option("maxRecordsPerFile", SHARD_ROWS).parquet(f"{directory}/{version}/data")
    rows.sparkSession.createDataFrame([(json.dumps(m, sort_keys=True),)], "value string").coalesce(1).write.text(f"{directory}/{version}/manifest")
    return m


def read_dataset(spark: SparkSession, directory: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{version}/data")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines of id, tab, text; the text may hold further tabs."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("qid"), parts[1].alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Lines of query, 0, document, grade."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("qid"), parts[2].alias("doc"), parts[3].cast("int").alias("grade"))

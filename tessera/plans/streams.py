"""Queries: the registry kept by a stream of its mutations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.plans import lifecycle as L
from tessera.sources import table
from tessera.sources.lineage import checkpoint_dir
from tessera.streaming.registry import Registry

PARTS = 4
PREFIX = "concat_ws('.', doc % 7, doc % 3)"


def replayed(s: SparkSession, d: str, parts: int = PARTS) -> Registry:
    """The events as files of rising time, of which each micro-batch takes one."""
    events, root = table(s, d, "events"), f"{checkpoint_dir(s)}/registry-{uuid.uuid4().hex[:12]}"
    events.repartitionByRange(parts, "ts").write.parquet(f"{root}/events")
    kept = Registry(s, f"{root}/tables", PREFIX)
    kept.run(s.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/events"), f"{root}/progress")
    return kept


def registry_stream(s: SparkSession, d: str) -> DataFrame:
    return replayed(s, d).state()


def issued_stream(s: SparkSession, d: str) -> DataFrame:
    """How many identifiers each prefix gave out, and how high its counter stands."""
    return replayed(s, d).issued().groupBy("prefix").agg(F.count("*").alias("n"), (F.max("ordinal") + 1).alias("next_ordinal"), F.count_distinct("ordinal").alias("different"))


register("registry_stream", registry_stream, L.FOLD_SQL + " SELECT * FROM registry")
register("issued_stream", issued_stream, L.FOLD_SQL + " SELECT (doc % 7) || '.' || (doc % 3) AS prefix, count(*) AS n, count(*) AS next_ordinal, count(*) AS different FROM registry GROUP BY 1")

"""Queries: ingestion from pages to identifiers, hashed embeddings, contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import text as T
from tessera.operators import quantize as Q
from tessera.plans import lifecycle as L
from tessera.sources import artifacts as A
from tessera.sources import table

DIM = 64
ROWS = 512  # texts whose words are counted at once


def hash_embedding(docs: DataFrame, dim: int = DIM) -> DataFrame:
    """(doc, text) -> (doc, vec): words fall into buckets with a sign by their hash; of unit length.

    Words are counted where their text is, so nothing is shuffled; a word's hash is taken once a batch.
    Null and empty texts have the zero vector; every row has that of its own text."""
    words = docs.select("doc", F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(T.TOKEN), F.lit(0)), " ").alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(batch.column(1), " ")
            w = lists.flatten().dictionary_encode()
            known = w.dictionary.to_pylist()
            first = np.frombuffer(b"".join([hashlib.sha256(x.encode()).digest() for x in known]), ">u8")[::4].astype(np.uint64)
            bucket = ((first >> np.uint64(4)) % np.uint64(dim)).astype(np.int64)  # of 15 hex digits
            sign = (1.0 - 2.0 * (first & np.uint64(1))) * [x != "" for x in known]  # of the next one; a text without words is one empty piece
            at, n = w.indices.to_numpy(), lists.value_lengths().to_numpy()
            end = np.cumsum(n)
            for lo in range(0, len(batch), ROWS):
                part = n[lo : lo + ROWS]
                i = at[end[lo] - n[lo] : end[lo + len(part) - 1]]
                x = np.bincount(np.repeat(np.arange(len(part)) * dim, part) + bucket[i], sign[i], len(part) * dim).reshape(-1, dim)
                vec = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
                ends = pa.array(np.arange(0, vec.size + 1, dim, dtype=np.int32))
                yield pa.record_batch([batch.column(0).slice(lo, ROWS), pa.ListArray.from_arrays(ends, pa.array(vec.ravel()))], names=["doc", "vec"])

    return words.mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, vec array<double>")


def hashed_vectors(s: SparkSession, d: str) -> DataFrame:
    v = hash_embedding(table(s, d, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text"))
    return v.select("doc", F.posexplode("vec").alias("i", "x")).where("x <> 0").select("doc", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


HASHED_SQL = rf"""
WITH w AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
c AS (SELECT doc, CAST('0x' || substr(sha256(w), 1, 15) AS BIGINT) % {DIM} AS i, sum(CASE WHEN CAST('0x' || substr(sha256(w), 16, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
n AS (SELECT doc, sqrt(sum(x * x)) AS n FROM c GROUP BY doc) SELECT doc, i, round(x / greatest(n, 1e-9), 6) AS x FROM c JOIN n USING (doc) WHERE x <> 0"""


# ------------------------------------------------------------ ingestion


def ingest(pages: DataFrame, books: list, max_tokens: int = 60) -> tuple[DataFrame, DataFrame]:
    """(doc, tenant, text) -> units with identifiers (doc, unit, hash, sid, text) and what was turned away
    (doc, reason): cleaned, judged, cut into units, embedded, coded, numbered; a text that a tenant
    already has is not taken twice."""
    clean = pages.select("doc", "tenant", T.clean(F.col("text")).alias("text")).withColumn("reason", T.quality_reason(F.coalesce("text", F.lit(""))))
    good = clean.where("reason = 'ok'")
    units = good.select("doc", "tenant", F.posexplode(T.chunk(F.col("text"), max_tokens)).alias("unit", "text")).withColumn("hash", T.content_hash(F.col("text")))
    first = units.withColumn("n_", F.row_number().over(Window.partitionBy("tenant", "hash").orderBy("doc", "unit"))).where("n_ = 1").drop("n_")
    keyed = first.withColumn("key", F.xxhash64("tenant", "hash"))
    codes = Q.encode(hash_embedding(keyed.select(F.col("key").alias("doc"), "text"), len(books[0][0])), books)
    ids = Q.allocate(codes).select(F.col("doc").alias("key"), "sid")
    return keyed.join(ids, "key").select("doc", "unit", "hash", "sid", "text"), clean.where("reason <> 'ok'").select("doc", "reason")


def ingest_pages(s: SparkSession, d: str) -> DataFrame:
    pages = table(s, d, "pages").select(F.col("page_id").alias("doc"), F.lit("a").alias("tenant"), T.html_to_text(F.col("html")).alias("text"))
    units, _ = ingest(pages, L._books(s, d))
    return units.groupBy("doc").agg(F.count("*").alias("units"), F.countDistinct("sid").alias("ids"))


def content_store(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("text", (F.col("doc_id") % 3 != 0).alias("trusted"))
    return A.contents(docs).select("hash", "uri")


register("hashed_vectors", hashed_vectors, HASHED_SQL)
register("ingest_pages", ingest_pages)
register("content_store", content_store, "SELECT DISTINCT sha256(text) AS hash, CASE WHEN doc_id % 3 <> 0 THEN 'blobs/' ELSE 'quarantine/' END || substr(sha256(text), 1, 2) || '/' || sha256(text) AS uri FROM documents WHERE text IS NOT NULL")

"""Filter interaction audit: what each filter removes in every order of the filters.

Method: the Arrow buffers of a batch are scanned whole. NumPy byte classes and prefix sums
count words, capitals, symbols and code points; the words' 64-bit hashes, sorted within each
document and verified byte by byte where neighbours agree, give the distinct words. Each row
becomes a bit mask of the filters it fails; everything after that reduces masks.

Filter E (same text as a lesser doc_id) needs the table: masks are counted by text digest
(SHA-256, computed beside the scan), so copies are merged before they are shuffled, and a
digest's rows at its least doc_id are those that pass.

Defined results: a null text is an empty text, equal to every other empty text; a null lang is
the part ''; rows that share a doc_id are documents of their own, and equal texts under one
doc_id do not make each other fail E; a null doc_id is neither less than another nor has a
lesser one, and has no labels; a doc_id with several label rows is good (toxic) if any of them
says so; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed
from .hashing import slice_hashes
from .words import blocks, per_doc, word_runs

FILTERS = "ABCDE"
E_BIT = 16
_CODE = np.arange(256)
_CAPITAL = (_CODE >= 65) & (_CODE <= 90)
_SYMBOL = np.isin(_CODE, np.frombuffer(b"#$%&*|", np.uint8))
_FIRST = (_CODE & 0xC0) != 0x80


def verified(b: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether b[start:end] and other[from_:to], pairwise, are the same bytes."""
    size = end - start
    same = size == to - from_
    size = np.where(same, size, 0)
    ends = np.cumsum(size)
    if len(ends) and ends[-1]:
        step = np.arange(ends[-1]) - np.repeat(ends - size, size)
        differ = b[np.repeat(start, size) + step] != other[np.repeat(from_, size) + step]
        same[np.repeat(np.arange(len(size)), size)[differ]] = False
    return same


def distinct_words(b: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each of n documents: neighbours in the order of (document, hash) that
    agree are compared byte by byte; a document in which two words share a hash is counted by its words."""
    h = slice_hashes(b, start, end) if hashes is None else hashes
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    agree = np.flatnonzero((d[1:] == d[:-1]) & (h[1:] == h[:-1]))
    i, j = order[agree], order[agree + 1]
    same = verified(b, start[i], end[i], b, start[j], end[j])
    out = np.bincount(doc, minlength=n) - np.bincount(d[agree[same]], minlength=n)
    for k in np.unique(d[agree[~same]]):  # a hash shared by different words: practically never
        at = np.flatnonzero(doc == k)
        out[k] = len({b[s:e].tobytes() for s, e in zip(start[at], end[at], strict=True)})
    return out


def _masks(b: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    start, end, doc = word_runs(b, off)
    words = np.bincount(doc, minlength=n)
    distinct = distinct_words(b, start, end, doc, n)
    capitals, symbols, points = (per_doc(table[b], off) for table in (_CAPITAL, _SYMBOL, _FIRST))
    fails = (words < 200) * 1 + (100 * distinct < 50 * words) * 2 + (100 * capitals > 3 * points) * 4 + (symbols > 0) * 8
    return [words, distinct, capitals, symbols, points, fails]


_MEASURES = ["words", "distinct", "capitals", "symbols", "points", "fails"]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, its measures and ``fails``: bits 1, 2, 4, 8 of the filters A to D."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, off in blocks(batch.column("text")):
                kept = batch.slice(lo, hi - lo)
                yield pa.record_batch([*(kept.column(c) for c in ("doc_id", "part", "digest")), *(pa.array(x.astype(np.int64)) for x in _masks(b, off))], names=["doc_id", "part", "digest", *_MEASURES])

    return rows.mapInArrow(trimmed(run), "doc_id long, part string, digest binary, " + ", ".join(f"{m} long" for m in _MEASURES))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail exactly the filters of a mask."""
    each = measure(docs).groupBy("digest", "fails", "doc_id", "part").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null doc_ids find no label: they are dealt by their digests instead of meeting in one task
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0)
    marked = each.withColumn("salt", salt).join(marks.withColumn("salt_", F.lit(0).cast("long")), (F.col("doc_id") == F.col("id")) & (F.col("salt") == F.col("salt_")), "left")
    marked = marked.select("digest", "fails", "doc_id", "part", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # by text and cell: rows in all, rows of no doc_id, the least doc_id and its rows
    by_text = marked.groupBy("digest", "fails", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("free"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # a text has a row for each part and kind of label at most, so its window is short
    alone = by_text.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    passing = F.col("free") + F.when(F.col("first").isNull() | (F.col("first") == F.col("least.doc_id")), F.coalesce("least.n", F.lit(0))).otherwise(0)
    split = alone.select("part", "fails", "good", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("bit"), passing.alias("n")), F.struct(F.lit(E_BIT).alias("bit"), (F.col("n") - passing).alias("n")))).alias("x"))
    return split.where("x.n > 0").groupBy("part", (F.col("fails") + F.col("x.bit")).alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def _sum(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def orders(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of masks.

    A step's counts depend on the set of filters before it only: 5 * 16 pairs of (set, filter)
    are counted for each part and then looked up by the orders' 600 steps. A filter's removals
    over all orders weigh each set by the orders in which it comes first."""
    size = len(filters)
    pairs = [(sum(1 << k for k in before), 1 << f, math.factorial(len(before)) * math.factorial(size - 1 - len(before))) for f in range(size) for r in range(size) for before in itertools.combinations([k for k in range(size) if k != f], r)]
    steps = [("".join(filters[k] for k in order), s + 1, sum(1 << k for k in order[:s]), 1 << order[s]) for order in itertools.permutations(range(size)) for s in range(size)]
    spark = counted.sparkSession
    step = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    all_ = F.explode(F.array(*[F.struct(F.lit(p).alias("before"), F.lit(b).alias("bit"), F.lit(w).alias("weight")) for p, b, w in pairs])).alias("x")
    x = counted.select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic", "n", all_).select("part", "mask", "good", "toxic", "n", "x.*")
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    taken = fails & ~gone
    table = x.groupBy("part", "before", "bit", "weight").agg(
        _sum(~fails & ~gone).alias("kept"),
        _sum(taken).alias("removed"),
        _sum(fails & gone).alias("redundant"),
        _sum(F.col("mask") == F.col("bit")).alias("unique_fails"),
        _sum(taken & (F.col("good") == 1)).alias("good_lost"),
        _sum(taken & (F.col("toxic") == 1)).alias("toxic_lost"),
    )  # 80 rows a part
    share = table.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("weight")).alias("shapley"))
    out = table.join(share, ["part", "bit"]).join(F.broadcast(step), ["before", "bit"])  # 600 rows, always
    return out.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return orders(cells(docs, labels))


AUDIT_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), f AS (
  SELECT part, text, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
      + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(f.doc_id > least, false)::INT AS mask
  FROM f LEFT JOIN l ON f.doc_id = l.doc_id
), c AS (SELECT part, mask, good, toxic, count(*) AS n FROM m GROUP BY ALL),
o(filter_order, step, before, bit) AS (
  SELECT x, 1, 0, 1 << (ascii(x) - 65) FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
  UNION ALL
  SELECT filter_order || x, step + 1, before | bit, 1 << (ascii(x) - 65) FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE step < 5 AND NOT contains(filter_order, x)
), s AS (
  SELECT whole.filter_order, o.step, o.before, o.bit FROM o JOIN o whole ON whole.step = 5 AND starts_with(whole.filter_order, o.filter_order)
), t AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM t
"""

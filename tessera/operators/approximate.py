"""Approximate dense search: a partitioned index kept as a table, of which a query reads few cells. How
few is measured: `tune` finds the probes that reach a recall, whatever the vectors are like.

An index is a set of centroids (a sample by hash, moved by `rounds` of k-means on at most
``SAMPLE`` vectors; every vector is indexed) and a table of tiles (cell, tile, docs, vecs): the
unit vectors of a cell, at most about ``TILE`` in a row, so that a full cell is many rows and
no task holds a whole one. A query goes to the cells of its `probes` nearest centroids; queries
of a cell are packed into blocks, and each pair of tile and block is one matrix product whose
best k of each query go on. More cells than ``CELLS`` are not made: then tiles per cell grow.

Defined results: vectors that are null, empty, zero or hold null or non-finite components are not
indexed and find nothing; ties go to the lesser document; repeated rows are documents of their
own; fewer than k vectors in the probed cells give fewer rows; empty tables give no rows; an
index of nothing finds nothing; all vectors must have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieve as R
from tessera.sources.lineage import cut

CELLS = 4096
SAMPLE = 65_536
TILE = 2048
BLOCK = 256

USABLE = "vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(vec, x -> x <> 0)"


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    tiles: DataFrame  # (cell, tile, docs, vecs)


def _unit(rows: list[list[float]]) -> np.ndarray:
    x = np.array(rows, float)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The n centroids of each row with the greatest product, ties to the lesser."""
    parts = [np.argsort(-np.round(x[lo : lo + BLOCK] @ centroids.T, 9), axis=1, kind="stable")[:, :n] for lo in range(0, max(1, len(x)), BLOCK)]
    return np.concatenate(parts)


def centroids(vectors: DataFrame, cells: int, rounds: int) -> np.ndarray:
    """The first by hash of their number, then moved: each round takes the mean of what is nearest."""
    order = vectors.where(USABLE).select("doc", F.sha2(F.col("doc").cast("string"), 256).alias("h"), F.col("vec").cast("array<double>").alias("vec"))
    n = cells if not rounds else min(SAMPLE, 64 * cells)
    got = order.orderBy("h", "doc", "vec").limit(n).select("vec").collect()  # SAMPLE vectors at most
    if not got:
        return np.zeros((0, 0))
    x = _unit([r["vec"] for r in got])
    c = x[:cells].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)  # an empty cell stays where it was
    return c


def build(vectors: DataFrame, cells: int | None = None, rounds: int = 8) -> Index:
    """vectors (doc, vec) -> their index; without `cells` about twice the root of their number."""
    if cells is None:
        cells = 2 * math.isqrt(vectors.where(USABLE).count())
    c = centroids(vectors, max(1, min(cells, CELLS)), rounds)
    if not len(c):
        return Index(c, vectors.sparkSession.createDataFrame([], "cell int, tile long, docs array<long>, vecs binary"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(1).to_pylist())
                yield pa.record_batch([pa.array(nearest(x, c, 1)[:, 0].astype(np.int32)), batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["cell", "doc", "vec"])

    placed = cut(vectors.where(USABLE).select(F.col("doc").cast("long").alias("doc"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(place, "cell int, doc long, vec binary").withColumn("salt", F.monotonically_increasing_id()))
    rows = _dealt(placed, "cell", TILE, "tile")

    def pack(got: pa.Table) -> pa.Table:
        got = got.sort_by([("doc", "ascending"), ("salt", "ascending")])
        return pa.table({"cell": got["cell"].slice(0, 1), "tile": got["tile"].slice(0, 1), "docs": pa.array([got["doc"].to_pylist()], pa.list_(pa.int64())), "vecs": pa.array([b"".join(got["vec"].to_pylist())], pa.binary())})

    return Index(c, cut(rows.groupBy("cell", "tile").applyInArrow(pack, "cell int, tile long, docs array<long>, vecs binary")))


def _dealt(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Rows of a key dealt by their salt to so many parts that each holds about `size`."""
    parts = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("long").alias("parts_"))
    return rows.join(F.broadcast(parts), key).withColumn(name, F.pmod(F.xxhash64("salt"), "parts_")).drop("parts_")  # a row for each cell, CELLS at most


def save(index: Index, path: str) -> None:
    """The index as a table by cell, beside its centroids; an existing one is an error."""
    spark = index.tiles.sparkSession
    index.tiles.write.mode("errorifexists").partitionBy("cell").parquet(f"{path}/tiles")
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell int, vec array<double>").coalesce(1).write.mode("errorifexists").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> Index:
    """Only the cells that a search probes are read: tiles lie in folders by cell."""
    c = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # CELLS rows at most
    return Index(np.array([r["vec"] for r in c], float).reshape(len(c), -1), spark.read.parquet(f"{path}/tiles"))


def search(queries: DataFrame, index: Index, k: int = 10, probes: int = 8, exclude_self: bool = True) -> DataFrame:
    """queries (qid, vec) -> (qid, doc, score, rank) out of the cells of their nearest centroids."""
    c, spark = index.centroids, queries.sparkSession
    if not len(c):
        return spark.createDataFrame([], "qid long, doc long, score double, rank long")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):  # as many rows as probes come of each
                batch = whole.slice(lo, 64)
                x = _unit(batch.column(1).to_pylist())
                near = nearest(x, c, probes)
                own = np.repeat(np.arange(len(x)), near.shape[1])
                yield pa.record_batch([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(pa.array(own)), pa.array([x[i].tobytes() for i in own], pa.binary())], names=["cell", "qid", "vec"])

    asked = cut(queries.where(USABLE).select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(ask, "cell int, qid long, vec binary").withColumn("salt", F.monotonically_increasing_id()))
    blocks = _dealt(asked, "cell", BLOCK, "block").groupBy("cell", "block").agg(F.collect_list(F.struct("qid", "vec")).alias("q"))  # about BLOCK queries

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                qid, docs = np.array([q["qid"] for q in row["q"]]), np.array(row["docs"])
                dim = c.shape[1]
                s = np.round(np.frombuffer(b"".join(q["vec"] for q in row["q"])).reshape(-1, dim) @ np.frombuffer(row["vecs"]).reshape(-1, dim).T, 9)
                if exclude_self:
                    s[qid[:, None] == docs[None, :]] = -np.inf
                at = np.lexsort((np.broadcast_to(docs, s.shape), -s), axis=1)[:, :k]
                own = np.repeat(np.arange(len(qid)), at.shape[1])
                value = s[own, at.ravel()]
                keep = np.isfinite(value)
                yield pa.record_batch([pa.array(x) for x in (qid[own[keep]], docs[at.ravel()[keep]], value[keep])], names=["qid", "doc", "score"])

    pairs = index.tiles.join(blocks, "cell").select("docs", "vecs", "q")
    found = pairs.mapInArrow(best, "qid long, doc long, score double")
    return R.top_k(found, k, digits=9).withColumn("score", F.round("score", 6)).select("qid", "doc", "score", "rank")


def tune(index: Index, vectors: DataFrame, k: int = 10, target: float = 0.95, sample: int = 128) -> int:
    """The fewest probes whose cells hold `target` of the exact k best of a sample of vectors by hash.

    The sample is searched exactly once; how far down its list of cells each result lies says
    what every number of probes would have found."""
    usable = vectors.where(USABLE).select(F.col("doc").cast("long").alias("doc"), F.col("vec").cast("array<double>").alias("vec"))
    few = usable.orderBy(F.sha2(F.concat(F.lit("probe "), F.col("doc").cast("string")), 256), "doc", "vec").limit(sample).collect()  # `sample` vectors
    if not few or not len(index.centroids):
        return 1
    spark = vectors.sparkSession
    asked = spark.createDataFrame([(r["doc"], r["vec"]) for r in few], "qid long, vec array<double>").dropDuplicates(["qid"])
    exact = R.dense(asked, usable, k).select("qid", "doc")
    cells = index.tiles.select(F.explode("docs").alias("doc"), F.col("cell").cast("int").alias("cell"))
    near = nearest(_unit([r["vec"] for r in few]), index.centroids, len(index.centroids))
    place = {(r["doc"], int(cell)): p + 1 for r, row in zip(few, near, strict=True) for p, cell in enumerate(row)}
    depths = sorted(place.get((r["qid"], r["cell"]), 1) for r in exact.join(cells, "doc").select("qid", "cell").collect())  # k rows for each
    return depths[min(len(depths) - 1, math.ceil(target * len(depths)) - 1)] if depths else 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall, n): the share of the exact results that were found."""
    hit = found.select("qid", "doc", F.lit(1).alias("hit_"))
    both = exact.select("qid", "doc").join(hit, ["qid", "doc"], "left")
    return both.agg(F.round(F.avg(F.coalesce("hit_", F.lit(0))), 6).alias("recall"), F.count("*").alias("n"))

"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors are one class. Classes are dealt to cells around seeded pivots and cells
to tiles of about ``TILE`` vectors. Pairs of tiles whose ranges on some pivot direction
are further apart than linked vectors can be are left out: unit vectors with cosine c
differ by at most sqrt(2 - 2c) in any direction. In a pair of tiles every unit vector a
is s*q + e with integers q in -127..127, kept and sent as int8; their products are exact, and

    |a.b - s_a s_b q_a.q_b| <= (1 + |e_a|) |e_b| + |e_a|

so only pairs whose bound straddles the threshold are recomputed in double precision, and
only pairs of tiles that hold such pairs are sent their vectors.
A pair of tiles returns, for each of its vectors, the number of links and one edge to
the least id of its component there, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; rows that share
a vec_id and a vector count as separate rows of one class; a null vec_id is kept out of
links; an empty table gives no row; labels and other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread, trimmed
from .graph import components

TILE = 4096
PIVOTS = 32
#: Parts of the pairing of tile heads.
SALTS = 16
#: Room for the rounding of the bounds themselves.
SLACK = 1e-9


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, values, dims = [], [], []
        for x in batch.column("embedding").to_pylist():
            v = np.array([np.nan if c is None else c for c in x], np.float64) if x else None
            if v is None or not np.isfinite(v).all() or not v.any():
                keys.append(None), values.append(None), dims.append(None)
                continue
            raw = (v + 0.0).tobytes()  # -0.0 is 0.0
            keys.append(hashlib.blake2b(raw, digest_size=16).digest()), values.append(raw), dims.append(len(v))
        yield pa.record_batch([batch.column("vec_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.binary()), pa.array(dims, pa.int32())], names=["vec_id", "key", "vec", "dim"])


def _unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    v = raw / big
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers (int8), scale and error norm of each row."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None])
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, error


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    root = parent[at]
    while True:
        up = parent[root]
        if (up == root).all():
            return root
        root = up


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def link_tiles(qa: Quantised, qb: Quantised, same: bool, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, raw: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of each row of a and of b (weighted), and the root of each in the joint order a, b.
    Without the vectors themselves, nothing if a pair's bound straddles the threshold."""
    (ia, sa, ea), (ib, sb, eb) = qa, qb
    exact = np.float32 if ia.shape[1] <= 1000 else np.float64  # sums of products below 2**24, 2**53
    fa, fb = ia.astype(exact), ib.astype(exact)
    n, m = len(fa), len(fb)
    links_a, links_b = np.zeros(n, np.int64), np.zeros(m, np.int64)
    shift = 0 if same else n
    parent = np.arange(n if same else n + m)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        near = (fa[lo:hi] @ fb.T).astype(np.float64) * sa[lo:hi, None] * sb
        slack = (1 + ea[lo:hi, None]) * eb + ea[lo:hi, None] + SLACK
        linked = near - slack >= threshold
        open_ = ~linked & (near + slack >= threshold)
        if same:
            linked[np.arange(hi - lo), np.arange(lo, hi)] = False
            open_[np.arange(hi - lo), np.arange(lo, hi)] = False
        i, j = np.nonzero(open_)
        if len(i) and raw is None:
            return None
        for k in range(0, len(i), 65536):  # in full precision
            p, r = i[k : k + 65536], j[k : k + 65536]
            x, y = raw[0][lo + p], raw[1][r]
            cosine = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
            linked[p, r] = cosine >= threshold
        if not linked.any():
            continue
        links_a[lo:hi] += (linked * weight_b).sum(axis=1)
        if not same:
            links_b += (linked * weight_a[lo:hi, None]).sum(axis=0)
        for k in np.flatnonzero(linked.any(axis=1)):
            roots = np.unique(_find(parent, np.append(np.flatnonzero(linked[k]) + shift, lo + k)))
            parent[roots] = roots[0]
    return links_a, links_b, _find(parent, np.arange(len(parent)))


def _tile_of(row: dict, end: str = "") -> tuple[np.ndarray, np.ndarray, Quantised]:
    """Ids, weights and quantised rows of a tile."""
    ids, weights, scale, error = (np.frombuffer(row[c + end], t) for c, t in (("ids", np.int64), ("weights", np.int64), ("scales", np.float64), ("errors", np.float64)))
    return ids, weights, (np.frombuffer(row["q" + end], np.int8).reshape(len(ids), -1), scale, error)


def _products(threshold: float):
    """Pairs of tiles: links and roots by the int8 products; a pair that needs the vectors comes
    out as its two tiles' names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                same = r["tile"] == r["tile_b"]
                (ids, wa, qa), (ids_b, wb, qb) = _tile_of(r), _tile_of(r, "_b")
                raw = tuple(np.frombuffer(r[c]).reshape(-1, r["dim"]) for c in ("vecs", "vecs_b")) if "vecs" in r else None
                got = link_tiles(qa, qb, same, wa, wb, threshold, raw)
                if got is None:
                    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([r["tile"]]), pa.array([r["tile_b"]])], names=_FOUND_NAMES)
                    continue
                la, lb, root = got
                every, links = (ids, la) if same else (np.append(ids, ids_b), np.append(la, lb))
                held = np.flatnonzero(links)
                if len(held):
                    none = pa.nulls(len(held), pa.string())
                    yield pa.record_batch([pa.array(every[held]), pa.array(links[held]), pa.array(every[root[held]]), none, none], names=_FOUND_NAMES)

    return run


_FOUND = "id long, links long, root long, tile string, tile_b string"
_FOUND_NAMES = ["id", "links", "root", "tile", "tile_b"]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(trimmed(_keyed), "vec_id long, key binary, vec binary, dim int")
    rows = scratch.write(rows, "rows")
    classes = rows.where("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vec").alias("vec"), F.first("dim").alias("dim"))
    classes = scratch.write(classes, "classes")
    pivots = [(r["dim"], r["vec"]) for r in classes.orderBy(F.xxhash64("key")).select("dim", "vec").limit(PIVOTS).collect()]
    by_dim: dict[int, np.ndarray] = {}
    for dim in {d for d, _ in pivots}:
        by_dim[dim] = _unit(np.array([np.frombuffer(v) for d, v in pivots if d == dim]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, lows = np.zeros(len(dims), np.int32), [None] * len(dims)
            ints, scale, error = [b""] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                unit = _unit(_matrix(batch.column("vec").take(pa.array(at)), dim))
                q, scale[at], error[at] = quantise(unit)
                for k, row in zip(at, q, strict=True):
                    ints[k] = row.tobytes()
                if dim in by_dim:
                    close = unit @ by_dim[dim].T
                    cell[at] = np.argmax(close, axis=1)
                    for k, row in zip(at, close, strict=True):
                        lows[k] = row
            more = {"cell": pa.array(cell), "close": pa.array(lows, pa.list_(pa.float64())), "q": pa.array(ints, pa.binary()), "scale": pa.array(scale), "error": pa.array(error)}
            for name, column in more.items():
                batch = batch.append_column(name, column)
            yield batch

    placed = scratch.write(classes.mapInArrow(trimmed(place), "key binary, id long, weight long, vec binary, dim int, cell int, close array<double>, q binary, scale double, error double"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))  # at most PIVOTS rows a length
    placed = placed.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    key = ["dim", "cell", "part"]

    def blob(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        close = [c for c in table.column("close").to_pylist() if c is not None]
        low, high = (np.min(close, axis=0), np.max(close, axis=0)) if close else ([], [])
        cols = {k: pa.array([int(table.column(k)[0].as_py())], pa.int32()) for k in key}
        for name, of in (("ids", "id"), ("weights", "weight"), ("scales", "scale"), ("errors", "error")):
            cols[name] = pa.array([table.column(of).to_numpy()[order].tobytes()], pa.binary())
        for name, of in (("q", "q"), ("vecs", "vec")):
            held = table.column(of).to_pylist()
            cols[name] = pa.array([b"".join(held[i] for i in order)], pa.binary())
        return pa.table(cols | {"low": pa.array([list(low)], pa.list_(pa.float64())), "high": pa.array([list(high)], pa.list_(pa.float64()))})

    # a tile is one row: about `tile` vectors, whatever the cell
    blobs = "dim int, cell int, part int, ids binary, weights binary, scales binary, errors binary, q binary, vecs binary, low array<double>, high array<double>"
    tiles = placed.groupBy(*key).applyInArrow(blob, blobs)
    tiles = scratch.write(tiles.withColumn("tile", F.concat_ws("-", *key)), "tiles")
    # pairs of tiles of one length, by an equi-join of the few tile heads; the one key is salted
    heads = tiles.select("tile", "dim", "low", "high").withColumn("salt", F.pmod(F.xxhash64("tile"), F.lit(SALTS)).cast("int"))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    other = tiles.select(F.col("tile").alias("tile_b"), "dim", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gap = F.array_max(F.zip_with(F.zip_with("low", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y)))
    pairs = heads.join(other, ["dim", "salt"]).where((F.col("tile") <= F.col("tile_b")) & (F.coalesce(gap, F.lit(0.0)) <= reach)).select("tile", "tile_b", "dim")
    n = 4 * spread(spark)
    pairs = scratch.write(pairs.repartition(n, "tile", "tile_b"), "pairs")

    def work(of: DataFrame, columns: list[str]) -> DataFrame:
        body = tiles.select("tile", *columns)
        body_b = tiles.select(F.col("tile").alias("tile_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
        return of.join(body, "tile").join(body_b, "tile_b").repartition(n, "tile", "tile_b").mapInArrow(trimmed(_products(threshold)), _FOUND)

    light = ["ids", "weights", "scales", "errors", "q"]
    first = scratch.write(work(pairs, light), "first")
    exact = scratch.write(work(pairs.join(first.where("tile IS NOT NULL").select("tile", "tile_b"), ["tile", "tile_b"], "left_semi"), [*light, "vecs"]), "exact")
    found = first.where("tile IS NULL").union(exact).select("id", "links", "root")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    label = scratch.write(components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct(), scratch), "label")
    of_class = classes.select("key", "id", "weight").join(counts, "id", "left").join(label, "id", "left")
    of_class = scratch.write(of_class.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")), "of_class")
    out = rows.select("vec_id", "key").join(of_class, "key", "left")
    own = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), own).alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))


LINK_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

"""Residual quantisation, ordinal allocation and prefix-trie tables.

Defined results: null vectors and those with null components have no codes; ties go to the lowest centroid;
repeated documents get an ordinal each; empty tables give empty tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.sources.lineage import cut


def frozen_codebooks(rows: list[np.ndarray], k: int, levels: int = ids.LEVELS) -> list[np.ndarray]:
    """Codebooks from levels * k vectors: level l holds the residuals of its own k vectors."""
    x = np.array(rows, float)
    x = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    books: list[np.ndarray] = []
    for level in range(levels):
        r = x[level * k : (level + 1) * k].copy()
        for b in books:
            r -= b[nearest(r, b)]
        books.append(r)
    return books


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, distances rounded, ties to the lowest."""
    return np.argmin(np.round(((x[:, None, :] - book[None]) ** 2).sum(axis=2), 9), axis=1)


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(doc, vec) -> (doc, c1..c4, err): codes level by level, and the squared residual."""
    names = [f"c{i + 1}" for i in range(len(books))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                r = np.array(part.column(1).to_pylist(), float)
                r = r / np.maximum(np.sqrt((r * r).sum(axis=1, keepdims=True)), 1e-12)
                codes = []
                for b in books:
                    c = nearest(r, b)
                    r = r - b[c]
                    codes.append(pa.array(c.astype(np.int32)))
                yield pa.record_batch([part.column(0), *codes, pa.array((r * r).sum(axis=1))], names=["doc", *names, "err"])

    whole = vectors.where("vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")
    return whole.select("doc", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "doc long, " + ", ".join(f"{n} int" for n in names) + ", err double")


def occupancy(codes: DataFrame, k: int) -> DataFrame:
    """Balance of the code tree: level-1 max over mean (of all k bins), used codes, entropy,
    level-2 max over mean (of used ones), leaf prefixes, largest leaf and leaves above 255."""
    leaf = codes.groupBy("c1", "c2", "c3", "c4").agg(F.count("*").alias("n"))
    two = leaf.groupBy("c1", "c2").agg(F.sum("n").alias("n"))
    one = two.groupBy("c1").agg(F.sum("n").alias("n"))
    total = one.agg(F.sum("n").alias("t"))
    a = one.crossJoin(F.broadcast(total)).agg(F.round(F.max("n") / (F.first("t") / k), 6).alias("l1_max_mean"), F.count("*").alias("l1_used"), F.round(-F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") / F.col("t"))), 6).alias("l1_entropy"))  # one row
    b = two.agg(F.round(F.max("n") / F.avg("n"), 6).alias("l2_max_mean"))
    c = leaf.agg(F.count("*").alias("leaf_prefixes"), F.max("n").alias("max_leaf"), F.count_if(F.col("n") > 255).alias("over_255"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each


def allocate(codes: DataFrame, counters: DataFrame | None = None, order: str = "doc") -> DataFrame:
    """Ordinals within each prefix, from the prefix's counter on, and the identifier parts; full prefixes have longer tails."""
    p = ["c1", "c2", "c3", "c4"]
    n = F.row_number().over(Window.partitionBy(*p).orderBy(order)).cast("long") - 1
    rows = codes.join(counters, p, "left").withColumn("ordinal", n + F.coalesce("next_ordinal", F.lit(0))).drop("next_ordinal") if counters is not None else codes.withColumn("ordinal", n)
    rows = rows.withColumn("codes", F.array(*p)).withColumn("tail", ids.long_tail(F.col("ordinal")))
    return rows.withColumn("sid", ids.to_text(F.col("codes"), F.col("tail"))).withColumn("packed", ids.pack(F.col("codes"), F.col("tail")))


def counters(issued: DataFrame) -> DataFrame:
    """Next ordinal of each prefix ever issued; retired identifiers count."""
    return issued.groupBy("c1", "c2", "c3", "c4").agg((F.max("ordinal") + 1).alias("next_ordinal"))


def trie_nodes(issued: DataFrame) -> DataFrame:
    """(depth, prefix, children, leaves) of every inner node; the root is the empty prefix."""
    keys = F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice("codes", F.lit(1), d), ".").alias("prefix"), F.element_at(F.concat("codes", F.slice("tail", 1, 1)), d + 1).alias("next"))))
    rows = issued.select(keys.alias("k")).select("k.*").groupBy("depth", "prefix", "next").agg(F.count("*").alias("n"))
    return rows.groupBy("depth", "prefix").agg(F.count("*").alias("children"), F.sum("n").alias("leaves"))


def trie_edges(issued: DataFrame) -> DataFrame:
    """(depth, parent, code, child): the mask of allowed next codes as rows."""
    e = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice("codes", F.lit(1), d), ".").alias("parent"), F.element_at("codes", d + 1).alias("code"), F.array_join(F.slice("codes", F.lit(1), d + 1), ".").alias("child"))))
    return issued.select(e.alias("e")).select("e.*").distinct()


def _before(nodes: DataFrame, depth: int, weight: Column, name: str) -> DataFrame:
    """Nodes (c1..c<depth>) with the sum of `weight` over all nodes before them, in the order of their codes.

    What lies before a node is what lies below the earlier siblings of each of its ancestors and of
    itself. So every window is over the children of one node, 256 at most, and no task sorts all nodes."""
    names = [f"c{i}" for i in range(1, depth + 1)]
    out, terms = nodes, []
    for k in range(1, depth + 1):
        sums = nodes.groupBy(*names[:k]).agg(F.sum(weight).alias("w_"))
        w = Window.partitionBy(*(names[: k - 1] or [F.lit(0)])).orderBy(names[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        out = out.join(sums.select(*names[:k], F.coalesce(F.sum("w_").over(w), F.lit(0)).alias(f"{name}_{k}")), names[:k])
        terms.append(F.col(f"{name}_{k}"))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return out.withColumn(name, total.cast("long")).drop(*(f"{name}_{k}" for k in range(1, depth + 1)))


def numbered(issued: DataFrame, levels: int = 4) -> DataFrame:
    """The trie as compressed rows: (depth, node, parent, code, first_child, children, first_leaf, leaves).

    Nodes of a depth are numbered from 0 in the order of their codes, so the children of a node have
    consecutive numbers from `first_child` on, and its identifiers, in the order of code and
    tail, are `leaves` rows from `first_leaf` on. The root is node 0 of depth 0, its parent and code are
    null; nodes of the last depth have no child nodes, and the number after the last as first_child
    is left null. No identifier gives no row."""
    names = [f"c{i}" for i in range(1, levels + 1)]
    flat = issued.select(*[F.element_at("codes", i + 1).cast("int").alias(c) for i, c in enumerate(names)])
    tables = []
    for depth in range(1, levels + 1):
        nodes = flat.groupBy(*names[:depth]).agg(F.count("*").alias("leaves"))
        tables.append(cut(_before(_before(nodes, depth, F.lit(1), "node"), depth, F.col("leaves"), "first_leaf")))
    root = flat.agg(F.count("*").alias("leaves")).where("leaves > 0").select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("first_leaf"), "leaves")
    out = None
    for depth, rows in enumerate([root, *tables]):
        own = names[:depth]
        if depth == 0:
            placed = rows.withColumns({"parent": F.lit(None).cast("long"), "code": F.lit(None).cast("int")})
        elif depth == 1:
            placed = rows.withColumns({"parent": F.lit(0).cast("long"), "code": F.col("c1")})
        else:
            above = tables[depth - 2].select(*names[: depth - 1], F.col("node").alias("parent"))
            placed = rows.join(above, names[: depth - 1]).withColumn("code", F.col(names[depth - 1]))
        if depth < levels:
            below = tables[depth].groupBy(*own).agg(F.min("node").alias("first_child"), F.count("*").alias("children"))
            placed = placed.join(below, own) if own else placed.crossJoin(F.broadcast(below))  # one row each
        else:
            placed = placed.withColumns({"first_child": F.lit(None).cast("long"), "children": F.lit(0).cast("long")})
        part = placed.select(F.lit(depth).cast("long").alias("depth"), "node", "parent", F.col("code").cast("long").alias("code"), "first_child", "children", "first_leaf", "leaves")
        out = part if out is None else out.union(part)
    return out


def find(issued: DataFrame, codes: list[int]) -> DataFrame:
    """The node of a prefix, as (depth, prefix, leaves): no row if it is not there."""
    prefix = ".".join(map(str, codes))
    own = issued.where(F.array_join(F.slice("codes", 1, len(codes)), ".") == prefix) if codes else issued
    return own.agg(F.count("*").alias("leaves")).where("leaves > 0").select(F.lit(len(codes)).alias("depth"), F.lit(prefix).alias("prefix"), "leaves")


def contains(issued: DataFrame, asked: DataFrame) -> DataFrame:
    """(sid) -> whether the trie holds it."""
    return asked.select("sid").distinct().join(issued.select("sid", F.lit(True).alias("held")).distinct(), "sid", "left").select("sid", F.coalesce("held", F.lit(False)).alias("held"))


def leaves(issued: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix) of four codes -> its identifiers' tails."""
    return issued.select(F.array_join("codes", ".").alias("prefix"), "sid", "tail").join(prefixes.select("prefix").distinct(), "prefix")


def ids_digest(issued: DataFrame) -> DataFrame:
    """One digest of all packed identifiers, whatever their order: those of a first code are hashed in
    order, then the hashes (256 at most)."""
    part = issued.select(F.col("codes")[0].alias("c1"), "packed").distinct().groupBy("c1").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("packed")), lambda p: F.hex(p)), ","), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c1", "h"))), lambda x: x["h"]), ","), 256).alias("digest"))


def validate(trie: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing and extra identifiers (by packed bytes) of a trie against the registry."""
    both = trie.select("packed", F.lit(1).alias("t")).join(expected.select("packed", F.lit(1).alias("e")), "packed", "full_outer")
    return both.agg(F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("extra"), F.count_if(F.col("t").isNotNull()).alias("leaves"))


def beam(queries: DataFrame, issued: DataFrame, books: list[np.ndarray], width: int = 8, temperature: float = 0.05) -> DataFrame:
    """Constrained beam search of (qid, vec): per level the children of each kept prefix,
    log-softmax over the allowed ones, and the `width` best by score, parent rank, code.
    Returns (qid, prefix, score, rank) after the last level."""
    spark = queries.sparkSession
    k = len(books[0])
    edges = trie_edges(issued)
    state = queries.select("qid", F.col("vec").cast("array<double>").alias("r"), F.lit("").alias("prefix"), F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x))
    state = state.withColumn("r", F.transform("r", lambda x: x / F.greatest(norm, F.lit(1e-12))))
    for level, book in enumerate(books):
        # a codebook has k rows, at most 256
        c = F.broadcast(spark.createDataFrame([(i, [float(v) for v in book[i]]) for i in range(k)], "code int, centroid array<double>"))
        step = state.join(edges.where(F.col("depth") == level).select(F.col("parent").alias("prefix"), "code", "child"), "prefix").join(c, "code")
        step = step.withColumn("r", F.zip_with("r", "centroid", lambda x, y: x - y))
        z = -F.aggregate("r", F.lit(0.0), lambda a, x: a + x * x) / temperature
        step = step.withColumn("z", z)
        w = Window.partitionBy("qid", "prefix")
        step = step.withColumn("top", F.max("z").over(w)).withColumn("total", F.sum(F.exp(F.col("z") - F.col("top"))).over(w))
        step = step.withColumn("score", F.round(F.col("score") + F.col("z") - F.col("top") - F.log("total"), 6))
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "code")
        step = step.withColumn("new", F.row_number().over(best)).where(F.col("new") <= width)
        state = step.select("qid", "r", F.col("child").alias("prefix"), "score", F.col("new").alias("rank"))
    return state.select("qid", "prefix", "score", F.col("rank").cast("long").alias("rank"))

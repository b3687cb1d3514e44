"""Ranked lexical search over a clustered index.

Method: recursive graph bisection reorders the documents so that those with like terms are
neighbours; runs of ``SHARD`` neighbours are the index's shards, each with the greatest factor
that any of its documents has for a term. A query visits shards by the bound that these give,
the highest first, and stops at the first bound below its k-th score: what is left cannot
enter, nor can it tie. Documents keep their doc_id through the reordering, so equal scores are
ordered by it.

Jobs, for each block of queries (``BLOCK_QUERIES`` queries or ``BLOCK_BYTES`` of their text,
which bound what is sent to the machines; every block runs against all rows):

1. scan: terms of whole texts in Arrow batches. A run of bytes is a query's term if its hash is
   found and its bytes agree. One row per document: length, term numbers and counts.
2. counts: N, L and the documents of each term.
3. bisection: the upper levels are fitted on ``SAMPLE`` documents (a documented bound; every
   document is indexed) and give each node weights of hashed terms, by which all documents go
   down; a leaf is dealt by a salt to groups of bounded size, so that a leaf of copies is no
   hot key. Each group is bisected down to shards by swapping the pairs of documents that gain
   most, level by level.
4. seeds: each query's best shards by bound are scored and give a first k-th score.
5. search: each task visits its shards from that score on and hands on its own k best, of
   which the k best of all are taken.

All but the weights (logarithms) is integer arithmetic.

Defined results: a null text has no terms; a document without terms counts in no total; rows
that share a doc_id are documents of their own, a null doc_id comes last among equal scores;
each row of the queries is a query of its own, those without terms find nothing; fewer than k
documents with a score above 0 give fewer rows; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .audit import verified
from .common import Scratch, trimmed
from .hashing import scramble, slice_hashes
from .words import blocks, runs

BLOCK_QUERIES = 4096
BLOCK_BYTES = 2 << 20
SHARD = 128
GROUP_DOCS = 8192
GROUP_POSTINGS = 4 << 20
SAMPLE = 4096
LEVELS = 8
FEATURES = 1024
ROUNDS = 8
SEEDS = 8

#: Bytes of terms: letters and digits of ASCII, and everything beyond it.
_CODE = np.arange(256)
_LOWER = np.where((_CODE >= 65) & (_CODE <= 90), _CODE + 32, _CODE).astype(np.uint8)
_TERM = (_CODE >= 128) | ((_CODE >= 48) & (_CODE <= 57)) | ((_CODE >= 65) & (_CODE <= 90)) | ((_CODE >= 97) & (_CODE <= 122))
_TERMS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as bytes, only A-Z lower-cased."""
    return [t.lower() for t in _TERMS.findall((text or "").encode("utf-8", "surrogatepass"))]


class Vocabulary:
    """Query terms by number, looked up for many runs of bytes at once."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        h = slice_hashes(self.bytes, self.start, self.end)
        order = np.argsort(h, kind="stable")
        self.hash, self.number = h[order], order

    def find(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Term number of each run b[start:end], or -1."""
        out = np.full(len(start), -1, np.int64)
        if not len(self.words) or not len(start):
            return out
        h = slice_hashes(b, start, end)
        at = np.searchsorted(self.hash, h)
        left = np.flatnonzero(self.hash[np.minimum(at, len(self.hash) - 1)] == h)
        while len(left):  # terms with one hash stand side by side and are tried in turn
            k = self.number[at[left]]
            same = verified(b, start[left], end[left], self.bytes, self.start[k], self.end[k])
            out[left[same]] = k[same]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(self.hash)]
            left = left[self.hash[at[left]] == h[left]]
        return out


def scan(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, salt, n, terms, tf): a document's number of terms, and its query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = 0, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, raw, off in blocks(batch.column("text")):
                b = _LOWER[raw]
                start, end, doc = runs(_TERM[b], off)
                number = vocabulary.find(b, start, end)
                have = number >= 0
                key, tf = np.unique(doc[have] * np.int64(max(len(vocabulary.words), 1)) + number[have], return_counts=True)
                own, term = np.divmod(key, max(len(vocabulary.words), 1))
                cut = np.searchsorted(own, np.arange(hi - lo + 1)) * 4
                salt = scramble(np.arange(seen + lo, seen + hi, dtype=np.uint64) + np.uint64(task)) >> np.uint64(1)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), pa.array(salt.astype(np.int64)), pa.array(np.bincount(doc, minlength=hi - lo).astype(np.int64)), *(_cut(x.astype(np.int32), cut) for x in (term, tf))],
                    names=["doc_id", "salt", "n", "terms", "tf"],
                )
            seen += batch.num_rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, salt long, n long, terms binary, tf binary")


def _cut(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Stretches of an array's bytes as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).view(np.uint8))]).cast(pa.binary())


def _joined(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's values end to end, and where each row begins."""
    rows = column.to_pylist()
    ptr = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) // np.dtype(kind).itemsize for r in rows], out=ptr[1:])
    return np.frombuffer(b"".join(rows), kind), ptr


# ---------------------------------------------------------------- bisection


def _gains(left: np.ndarray, right: np.ndarray, nl: np.ndarray, nr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What moving one posting to the other half saves of the estimated gaps, by node and term."""

    def cost(d: np.ndarray, n: np.ndarray) -> np.ndarray:
        return d * np.log2(np.maximum(n, 1)[:, None] / (d + 1.0))

    now = cost(left, nl) + cost(right, nr)
    away = now - cost(np.maximum(left - 1, 0), nl) - cost(right + 1, nr)
    back = now - cost(left + 1, nl) - cost(np.maximum(right - 1, 0), nr)
    return away, back


def _halves(node: np.ndarray, side: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, doc: np.ndarray, feature: np.ndarray, width: int, rounds: int) -> np.ndarray:
    """Improves the two sides of every node at once: pairs of documents that gain by it change places.

    `node` and `side` by document; nodes hold the positions low to high, their left halves end at mid."""
    nodes, side = len(low), side.copy()
    nl, nr = mid - low, high - mid
    lefts = np.repeat(low, np.minimum(nl, nr)) + _within(np.minimum(nl, nr))
    partner = np.repeat(mid, np.minimum(nl, nr)) + _within(np.minimum(nl, nr))
    key = node[doc] * width + feature
    for _ in range(rounds):
        on_right = side[doc]
        left = np.bincount(key[~on_right], minlength=nodes * width).reshape(nodes, width)
        right = np.bincount(key[on_right], minlength=nodes * width).reshape(nodes, width)
        away, back = (g.ravel() for g in _gains(left, right, nl, nr))
        gain = np.bincount(doc, np.where(on_right, back[key], away[key]), minlength=len(node))
        best = np.lexsort((-gain, side, node))
        a, b = best[lefts], best[partner]
        swap = gain[a] + gain[b] > 1e-9
        if not swap.any():
            break
        side[a[swap]], side[b[swap]] = True, False
    return side


def _within(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def reorder(ptr: np.ndarray, feature: np.ndarray, leaf: int = SHARD, rounds: int = ROUNDS) -> np.ndarray:
    """An order of documents (features feature[ptr[i]:ptr[i+1]]) by recursive graph bisection,
    all nodes of a level at once, until runs of at most `leaf` are left."""
    n = len(ptr) - 1
    order = np.arange(n)
    doc = np.repeat(order, np.diff(ptr))
    if not len(feature):
        return order
    number = np.unique(feature, return_inverse=True)[1]
    number = number % (4 * FEATURES)  # many terms share a place: the order only serves speed
    width = int(number.max()) + 1
    low, high = np.array([0]), np.array([n])
    while (high - low).max() > leaf:
        mid = np.where(high - low > leaf, (low + high) // 2, high)
        node, side = np.empty(n, np.int64), np.empty(n, bool)
        node[order] = np.repeat(np.arange(len(low)), high - low)
        side[order] = np.arange(n) >= mid[node[order]]
        side = _halves(node, side, low, mid, high, doc, number, width, rounds)
        order = order[np.lexsort((side[order], node[order]))]
        low, high = np.stack([low, mid], 1).ravel(), np.stack([mid, high], 1).ravel()
        low, high = low[high > low], high[high > low]
    return order


@dataclass
class Tree:
    """Upper levels of the bisection: weights of hashed terms and a limit for each node."""

    weight: np.ndarray
    limit: np.ndarray
    levels: int

    def leaf(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n documents with (doc, feature) pairs."""
        node = np.zeros(n, np.int64)
        for _ in range(self.levels):
            score = np.bincount(doc, self.weight[node[doc], feature], minlength=n)
            node = 2 * node + 1 + (score > self.limit[node])
        return node - (2**self.levels - 1)


def _hashed(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place) of the terms' FEATURES places."""
    place = (scramble(term.astype(np.uint64)) >> np.uint64(40)).astype(np.int64) % FEATURES
    return np.divmod(np.unique(doc * FEATURES + place), FEATURES)


def grow(ptr: np.ndarray, feature: np.ndarray, levels: int) -> Tree:
    """Bisects a sample and turns each node's halves into weights: how much likelier a term is on the right."""
    n = len(ptr) - 1
    doc = np.repeat(np.arange(n), np.diff(ptr))
    tree = Tree(np.zeros((2**levels - 1, FEATURES), np.float32), np.zeros(2**levels - 1), levels)
    node = np.zeros(n, np.int64)
    for level in range(levels):
        first = 2**level - 1
        rank = np.lexsort((np.arange(n), node))
        sizes = np.bincount(node - first, minlength=2**level)
        high = np.cumsum(sizes)
        low = high - sizes
        mid = (low + high) // 2
        side = np.empty(n, bool)
        side[rank] = np.arange(n) >= np.repeat(mid, sizes)
        side = _halves(node - first, side, low, mid, high, doc, feature, FEATURES, ROUNDS)
        for k in range(2**level):
            mine = node == first + k
            if not mine.any():
                continue
            on = mine[doc]
            right = np.bincount(feature[on & side[doc]], minlength=FEATURES)
            left = np.bincount(feature[on & ~side[doc]], minlength=FEATURES)
            tree.weight[first + k] = np.log((right + 1) / ((mine & side).sum() + 2)) - np.log((left + 1) / ((mine & ~side).sum() + 2))
        score = np.bincount(doc, tree.weight[node[doc], feature], minlength=n)
        for k in range(2**level):
            own = score[node == first + k]
            tree.limit[first + k] = np.median(own) if len(own) else 0.0
        node = 2 * node + 1 + (score > tree.limit[node])
    return tree


# ---------------------------------------------------------------- index


def factor(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 20 m), in 64-bit integers, or in unbounded ones where those would not do."""
    tf, n = tf.astype(np.int64), n.astype(np.int64)
    if len(n) and (int(n.max()) * 50 * docs >= 2**62 or int(tf.max()) >= 2**33):
        tf, n = tf.astype(object), n.astype(object)
    m = 50 + (50 * n * docs) // length
    return ((1_000_000_000 * tf) // (1000 * tf + 20 * m)).astype(np.int64)


_SHARD_ROWS = "shard long, docs array<long>, terms binary, top binary, ptr binary, pos binary, fac binary"


def _shards(group: int, ids: pa.Array, ptr: np.ndarray, term: np.ndarray, fac: np.ndarray, size_: int) -> pa.Table:
    """A group's documents, reordered and cut into shards."""
    order = reorder(ptr, term, size_)
    rows: dict[str, list] = {k: [] for k in ("shard", "docs", "terms", "top", "ptr", "pos", "fac")}
    for k, lo in enumerate(range(0, len(order), size_)):
        own = order[lo : lo + size_]
        size = ptr[own + 1] - ptr[own]
        at = np.repeat(ptr[own], size) + _within(size)
        pos = np.repeat(np.arange(len(own)), size)
        by = np.lexsort((pos, term[at]))
        t, f = term[at][by], fac[at][by]
        u, first = np.unique(t, return_index=True)
        rows["shard"].append(group * (1 << 20) + k)
        rows["docs"].append(ids.take(pa.array(own)).to_pylist())
        rows["terms"].append(u.astype(np.int32).tobytes())
        rows["top"].append(np.maximum.reduceat(f, first).astype(np.int32).tobytes())
        rows["ptr"].append(np.append(first, len(t)).astype(np.int32).tobytes())
        rows["pos"].append(pos[by].astype(np.uint8).tobytes())
        rows["fac"].append(f.astype(np.int32).tobytes())
    return pa.table({"shard": pa.array(rows["shard"], pa.int64()), "docs": pa.array(rows["docs"], pa.list_(pa.int64())), **{c: pa.array(rows[c], pa.binary()) for c in ("terms", "top", "ptr", "pos", "fac")}})


def _leaves(rows: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, ptr = _joined(batch.column("terms"), np.int32)
            doc, place = _hashed(np.repeat(np.arange(batch.num_rows), np.diff(ptr)), term)
            leaf = tree.leaf(doc, place, batch.num_rows)
            yield pa.record_batch([*batch.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

    return rows.mapInArrow(run, StructType(rows.schema.fields + [StructField("leaf", IntegerType())]))


def build(forward: DataFrame, docs: int, length: int, shard: int = SHARD, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The shards of all documents that hold a query's term (from `scan`'s rows, written before)."""
    rows = forward.where("octet_length(terms) > 0").select("doc_id", "salt", "n", "terms", "tf")
    levels = min(LEVELS, max(0, math.ceil(math.log2(max(docs, 1) / group_docs))))
    tree = Tree(np.zeros((0, FEATURES), np.float32), np.zeros(0), 0)
    if levels:
        term, ptr = _sample(rows)
        tree = grow(ptr, term, levels)
    placed = _leaves(rows, tree)
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("docs"), F.sum(F.octet_length("terms") / 4).alias("postings")).collect()  # at most 2**LEVELS rows
    parts = {r["leaf"]: max(1, math.ceil(r["docs"] / group_docs), math.ceil(r["postings"] / GROUP_POSTINGS)) for r in sizes}
    first, total = {}, 0
    for leaf in sorted(parts):
        first[leaf], total = total, total + parts[leaf]
    plan = forward.sparkSession.createDataFrame([(k, first[k], parts[k]) for k in sorted(parts)] or [(0, 0, 1)], "leaf int, first int, parts int")
    grouped = placed.join(F.broadcast(plan), "leaf").withColumn("group", (F.col("first") + F.col("salt") % F.col("parts")).cast("long"))  # a row for each leaf

    def cut(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        got = got.sort_by("salt").combine_chunks()
        term, ptr = _joined(got.column("terms"), np.int32)
        tf, _ = _joined(got.column("tf"), np.int32)
        n = got.column("n").to_numpy()
        return _shards(key[0].as_py(), got.column("doc_id").combine_chunks(), ptr, term, factor(tf, np.repeat(n, np.diff(ptr)), docs, length), shard)

    return grouped.select("group", "doc_id", "salt", "n", "terms", "tf").groupBy("group").applyInArrow(cut, _SHARD_ROWS)


def _sample(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, ptr = _joined(batch.column("terms"), np.int32)
            doc, place = _hashed(np.repeat(np.arange(batch.num_rows), np.diff(ptr)), term)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)) * 2
            yield pa.record_batch([batch.column("salt"), _cut(place.astype(np.int16), cut)], names=["salt", "f"])

    got = rows.select("salt", "terms").mapInArrow(run, "salt long, f binary").orderBy("salt").limit(SAMPLE).collect()  # SAMPLE rows of at most 2 KB
    f, ptr = _joined(pa.array([bytes(r["f"]) for r in got], pa.binary()), np.int16)
    return f.astype(np.int64), ptr


# ---------------------------------------------------------------- queries


class Queries:
    """A block of queries as the tasks use it: term -> (query, weight)."""

    def __init__(self, wanted: list[list[int]], weight: np.ndarray):
        pairs = sorted((t, q) for q, own in enumerate(wanted) for t in own)
        term = np.array([t for t, _ in pairs], np.int64)
        self.query = np.array([q for _, q in pairs], np.int64)
        self.ptr = np.searchsorted(term, np.arange(len(weight) + 1))
        self.weight, self.n = weight, len(wanted)

    def meet(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in terms, query) of the queries that ask for them, by query."""
        size = self.ptr[terms + 1] - self.ptr[terms]
        place = np.repeat(np.arange(len(terms)), size)
        query = self.query[np.repeat(self.ptr[terms], size) + _within(size)]
        by = np.argsort(query, kind="stable")
        return place[by], query[by]


class Shard:
    def __init__(self, row: dict, queries: Queries, scored: bool = True):
        self.terms = np.frombuffer(row["terms"], np.int32).astype(np.int64)
        top = np.frombuffer(row["top"], np.int32).astype(np.int64)
        self.place, self.query = queries.meet(self.terms)
        # sums of integers far below 2**53: exact in doubles
        self.bound = np.bincount(self.query, (queries.weight[self.terms] * top)[self.place], minlength=queries.n).astype(np.int64)
        if scored:
            self.docs, self.weight = row["docs"], queries.weight
            self.ptr, self.pos = np.frombuffer(row["ptr"], np.int32).astype(np.int64), np.frombuffer(row["pos"], np.uint8)
            self.fac = np.frombuffer(row["fac"], np.int32)
            self.cut = np.searchsorted(self.query, np.arange(queries.n + 1))

    def scores(self, q: int) -> np.ndarray:
        place = self.place[self.cut[q] : self.cut[q + 1]]
        size = self.ptr[place + 1] - self.ptr[place]
        at = np.repeat(self.ptr[place], size) + _within(size)
        return np.bincount(self.pos[at], np.repeat(self.weight[self.terms[place]], size) * self.fac[at], minlength=len(self.docs)).astype(np.int64)


_LAST = 1 << 63  # a null doc_id among equal scores


def _best(found: list[tuple[int, int | None]], k: int) -> list[tuple[int, int | None]]:
    return sorted(found, key=lambda x: (x[0], _LAST if x[1] is None else x[1]))[:k]


def _seeds(index: DataFrame, queries: Queries) -> DataFrame:
    """(q, shard): each query's best shards by bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((queries.n, 0), np.int64)
        shards = np.zeros((queries.n, 0), np.int64)
        for batch in batches:
            rows = batch.to_pylist()
            bound = np.stack([Shard(r, queries, scored=False).bound for r in rows], axis=1)
            best = np.concatenate([best, bound], axis=1)
            shards = np.concatenate([shards, np.broadcast_to(np.array([r["shard"] for r in rows]), bound.shape)], axis=1)
            keep = np.lexsort((shards, -best), axis=1)[:, :SEEDS]
            best, shards = np.take_along_axis(best, keep, 1), np.take_along_axis(shards, keep, 1)
        q = np.repeat(np.arange(queries.n), best.shape[1])
        some = best.ravel() > 0
        yield pa.record_batch([pa.array(q[some]), pa.array(shards.ravel()[some]), pa.array(best.ravel()[some])], names=["q", "shard", "bound"])

    each = index.select("shard", "terms", "top").mapInArrow(trimmed(run), "q long, shard long, bound long")
    w = Window.partitionBy("q").orderBy(F.desc("bound"), "shard")
    return each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SEEDS).select("q", "shard")


def _first_scores(index: DataFrame, seeds: DataFrame, queries: Queries, k: int) -> np.ndarray:
    """For each query the k-th score among its seeds, 0 where they hold fewer."""
    wanted = seeds.groupBy("shard").agg(F.collect_list("q").alias("qs"))  # at most SEEDS times BLOCK_QUERIES pairs in all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, s = [], []
            for row in batch.to_pylist():
                shard = Shard(row, queries)
                for own in row["qs"]:
                    x = shard.scores(own)
                    s += np.sort(x[x > 0])[::-1][:k].tolist()
                    q += [own] * (len(s) - len(q))
            yield pa.record_batch([pa.array(q, pa.int64()), pa.array(s, pa.int64())], names=["q", "score"])

    each = index.join(F.broadcast(wanted), "shard").mapInArrow(trimmed(run), "q long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"))
    last = each.withColumn("r", F.row_number().over(w)).where(F.col("r") == k)
    out = np.zeros(queries.n, np.int64)
    for r in last.select("q", "score").collect():  # a row for each query of the block
        out[r["q"]] = r["score"]
    return out


def _visit(index: DataFrame, queries: Queries, least: np.ndarray, k: int) -> DataFrame:
    """(q, doc_id, score): what each task finds, and in a row with q = -1 how many of its pairs of
    shard and query (score) it visited (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[int, int | None]]] = [[] for _ in range(queries.n)]
        floor, visited, pairs = least.copy(), 0, 0
        for batch in batches:
            shards = [Shard(r, queries) for r in batch.to_pylist()]
            if not shards:
                continue
            bound = np.stack([s.bound for s in shards], axis=1)
            pairs += int((bound > 0).sum())
            for q in np.flatnonzero(bound.max(axis=1) >= np.maximum(floor, 1)):
                for at in np.argsort(-bound[q], kind="stable"):
                    if bound[q, at] < max(floor[q], 1):
                        break  # nor can any later shard of this batch hold a better or an equal score
                    visited += 1
                    x = shards[at].scores(q)
                    good = np.flatnonzero(x >= max(floor[q], 1))
                    if len(good):
                        found[q] = _best(found[q] + [(-int(x[i]), shards[at].docs[i]) for i in good], k)
                        if len(found[q]) == k:
                            floor[q] = max(floor[q], -found[q][-1][0])
        rows = [(q, d, -s) for q, own in enumerate(found) for s, d in own] + [(-1, visited, pairs)]
        yield pa.record_batch([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["q", "doc_id", "score"])

    return index.mapInArrow(trimmed(run), "q long, doc_id long, score long")


class Search:
    """A search of queries (item_id, text) in documents; `visited` tells, after it has run, how many
    of the pairs of shard and query with a shared term were looked at."""

    def __init__(self, docs: DataFrame, k: int = 50, shard: int = SHARD, group_docs: int = GROUP_DOCS, block: int = BLOCK_QUERIES):
        if not 0 < shard <= 256:
            raise ValueError("a shard holds 1 to 256 documents")  # their places are bytes
        self.docs, self.k, self.visited, self.pairs = docs, k, 0, 0
        self.shard, self.group_docs, self.block = shard, group_docs, block
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "search")

    def _block(self, no: int, items: list[tuple[int | None, str | None]]) -> DataFrame | None:
        own = [sorted(set(terms(text))) for _, text in items]
        number = {t: k for k, t in enumerate(sorted({t for x in own for t in x}))}
        if not number:
            return None
        forward = self.scratch.write(scan(self.docs, Vocabulary(list(number))), f"forward-{no}")
        row = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
        if not row["docs"]:
            return None
        df = np.zeros(len(number), np.int64)
        for r in _document_counts(forward, len(number)).collect():  # a row for each term of the block
            df[r["term"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * row["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        queries = Queries([[number[t] for t in x] for x in own], weight)
        index = self.scratch.write(build(forward, row["docs"], row["length"], self.shard, self.group_docs), f"index-{no}")
        self.scratch.drop(f"forward-{no}")
        least = _first_scores(index, _seeds(index, queries), queries, self.k)
        found = self.scratch.write(_visit(index, queries, least, self.k), f"found-{no}")
        self.scratch.drop(f"index-{no}")
        seen = found.where("q < 0").agg(F.sum("doc_id").alias("visited"), F.sum("score").alias("pairs")).first()
        self.visited, self.pairs = self.visited + (seen["visited"] or 0), self.pairs + (seen["pairs"] or 0)
        w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = found.where("q >= 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)
        names = self.spark.createDataFrame([(q, i) for q, (i, _) in enumerate(items)], "q long, item_id long")
        return best.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # a row for each query of the block

    def run(self, queries: DataFrame) -> DataFrame:
        out, items, size, no = None, [], 0, 0
        rows = queries.select(F.col("item_id").cast("long"), "text").toLocalIterator()
        while True:
            row = next(rows, None)
            if items and (row is None or len(items) == self.block or size + len(row["text"] or "") > BLOCK_BYTES):
                part = self._block(no, items)
                if part is not None:
                    out = part if out is None else out.unionByName(part)
                items, size, no = [], 0, no + 1
            if row is None:
                break
            items.append((row["item_id"], row["text"]))
            size += len(row["text"] or "")
        return out if out is not None else self.spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _document_counts(forward: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n, np.int64)
        for batch in batches:
            count += np.bincount(_joined(batch.column(0), np.int32)[0], minlength=n)
        at = np.flatnonzero(count)
        yield pa.record_batch([pa.array(at), pa.array(count[at])], names=["term", "n"])

    return forward.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def search(docs: DataFrame, queries: DataFrame, k: int = 50) -> DataFrame:
    return Search(docs, k).run(queries)


SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL
), a AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM i),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT k, doc_id, CAST(n AS BIGINT) AS n, term, count(*) AS tf FROM (SELECT k, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g),
s AS (
  SELECT q, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM a JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50
"""

"""Packing of token ids into sequences by cutting-stock column generation.

Every document gives floor(n / C) full pieces of C ids; what remains (1 to C-1
ids) is an item of the cutting-stock problem. The histogram of remainders has
fewer than C bins, whatever the corpus, so the linear program over filling
patterns runs on the driver, to a stated gap: knapsack dynamic programming prices new
patterns from the dual values, the fractional solution is rounded, and items left over
get further patterns that fill a sequence exactly. The k-th document of a remainder
length then finds its pattern, copy and slot by arithmetic on its rank. Only remainders
that no exact pattern takes lie end to end in a stream that is cut every C ids; the last
stretch is cut into powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; rows that share a
doc_id are packed one by one; an empty table gives no piece; further columns are
ignored. Ranks follow the order of the written token table, so that recomputed
tasks agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, encoder, utf8_buffers
from .common import Scratch, spread, trimmed

CAPACITY = 2048
#: The linear program ends within this share of its bound.
GAP = 0.001
#: Pricings in a row without a gain after which it ends as well.
STALL = 50
#: Items added to each length's demand while the program runs, so that no two patterns end alike.
JITTER = 1e-3
#: Ranks at which tasks begin are sent to all machines up to this size, joined by a shuffle above.
BROADCAST_BYTES = 64 << 20
#: New columns taken from one pricing.
COLUMNS_AT_ONCE = 24

_TOKENS = "doc_id long, part long, n long, rem long, rank long, chunk long, ids binary"


def tokenised(docs: DataFrame, definition: str, capacity: int, end_id: int) -> DataFrame:
    """One row per document: ids (little-endian uint32), remainder, and for the task that
    made it the rank among equal remainders and the full pieces before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = encoder(definition)
        seen = np.zeros(capacity, np.int64)
        chunks = 0
        for batch in batches:
            data, off = utf8_buffers(batch.column("text"))
            keys = batch.column("doc_id")
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
                flat, n = enc.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end_id)
                rem = n % capacity
                order = np.argsort(rem, kind="stable")
                sorted_rem = rem[order]
                first = np.searchsorted(sorted_rem, sorted_rem, "left")
                rank = np.empty(len(n), np.int64)
                rank[order] = np.arange(len(n)) - first + seen[sorted_rem]
                seen += np.bincount(rem, minlength=capacity)
                full = n // capacity
                before = chunks + np.cumsum(full) - full
                chunks += int(full.sum())
                yield pa.record_batch(
                    [keys.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.full(hi - lo, part, np.int64)), pa.array(n), pa.array(rem), pa.array(rank), pa.array(before), _binary(flat.astype("<u4"), n * 4)],
                    names=["doc_id", "part", "n", "rem", "rank", "chunk", "ids"],
                )
                lo = hi

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), _TOKENS)


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    off = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])


# --------------------------------------------------------------- linear program


def _knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: most value of lengths (index + 1) that add up to exactly c; and the last one used."""
    m = len(value)
    best = np.full(capacity + 1, -np.inf)
    last = np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    for c in range(1, capacity + 1):
        k = min(c, m)
        got = best[c - k : c][::-1] + value[:k]
        at = int(np.argmax(got))
        best[c], last[c] = got[at], at + 1
    return best, last


def _pattern(last: np.ndarray, c: int) -> np.ndarray:
    out = np.zeros(len(last), np.int64)
    while c > 0:
        out[last[c]] += 1
        c -= last[c]
    return out


def _few(left: np.ndarray, size: int, capacity: int) -> dict[int, int] | None:
    """One length more, or two, that fill a sequence up with one of `size`: those that last longest."""
    gap = capacity - size
    left = left.copy()
    left[size] = max(left[size] - 1, 0)
    if left[gap] > 0:
        return {gap: 1} if gap != size else {size: 1}
    b = np.arange(1, gap // 2 + 1)
    if not len(b):
        return None
    many = np.minimum(left[b], left[gap - b])
    if gap % 2 == 0:
        many[-1] = left[gap // 2] / 2
    at = int(np.argmax(many))
    if many[at] < (1 if left.dtype.kind == "i" else 1e-9):
        return None
    out: dict[int, int] = {}
    for x in (at + 1, gap - at - 1):
        out[x] = out.get(x, 0) + 1
    return out


def _any(left: np.ndarray, size: int, capacity: int) -> dict[int, int] | None:
    """Any lengths, as often as there are items, that fill a sequence up with one of `size`:
    the reachable sums are the bits of one number, kept for each step."""
    gap = capacity - size
    reach, steps, all_ = 1, [], (1 << gap + 1) - 1
    for x in np.flatnonzero(left[: gap + 1])[::-1].tolist():
        many, k = int(min(left[x] - (x == size), gap // x)), 1
        while many > 0:
            take = min(k, many)
            after = (reach | reach << x * take) & all_
            if after != reach:
                steps.append((x, take, reach))
                reach = after
            if reach >> gap & 1:
                out: dict[int, int] = {}
                for y, times, before in reversed(steps):
                    if not before >> gap & 1:
                        out[y] = out.get(y, 0) + times
                        gap -= y * times
                return out
            many, k = many - take, k * 2
    return None


def residual(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Full patterns for whole items, the longest first, until no length has an exact fill.
    Takes its items out of `count`."""
    uses, left = [], count.copy()
    while len(held := np.flatnonzero(left)):
        size = int(held[-1])
        more = _few(left, size, capacity) or _any(left, size, capacity)
        if more is None:
            left[size] = 0  # none can fill up a sequence that holds it
            continue
        pattern = dict(more)
        pattern[size] = pattern.get(size, 0) + 1
        times = min(int(left[x]) // k for x, k in pattern.items())
        for x, k in pattern.items():
            left[x] -= k * times
            count[x] -= k * times
        uses.append((pattern, times))
    return uses


def _start(need: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A first basis: full patterns, of two or three lengths if they can be, the longest length
    first, each used until a length is met, which no later one holds. So the basis is triangular. Gives patterns by the length that each
    meets, their use, and the inverse of the basis."""
    m = len(lengths)
    where = np.full(capacity + 1, -1)
    where[lengths] = np.arange(m)
    left = np.zeros(capacity + 1)
    left[lengths] = need
    patterns: list[np.ndarray] = [np.zeros(0, np.int64)] * m
    x, closed = np.zeros(m), []
    for k in range(m - 1, -1, -1):
        size = int(lengths[k])
        while left[size] > 1e-9:
            more = _few(left, size, capacity) or _any(np.ceil(left - 1e-9).astype(np.int64), size, capacity)
            if more is None:
                break
            p = np.zeros(m, np.int64)
            p[k] = 1
            for y, many in more.items():
                p[where[y]] += many
            held = np.flatnonzero(p)
            use = left[lengths[held]] / p[held]
            out = int(held[np.argmin(use)])
            left[lengths[held]] -= use.min() * p[held]
            left[lengths[out]] = 0
            patterns[out], x[out] = p, use.min()
            closed.append(out)
        if not len(patterns[k]):
            p = np.zeros(m, np.int64)
            p[k] = capacity // size
            patterns[k], x[k] = p, left[size] / p[k]
            left[size] = 0
            closed.append(k)
    order = np.array(closed)
    basis = np.array([patterns[k] for k in closed], float).T[order]  # lower triangular
    solved = np.eye(m)
    for k in range(m):
        held = np.flatnonzero(basis[k, :k])
        if len(held):
            solved[k] -= basis[k, held] @ solved[held]
        solved[k] /= basis[k, k]
    inverse = np.empty((m, m))
    inverse[np.ix_(order, order)] = solved
    return patterns, x, inverse


def column_generation(count: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Exact-fill patterns and how often to use them; count[L] items have length L.

    Restricted master problem: cover every length at the least number of sequences.
    It starts from patterns of two and three lengths, keeps the inverse of the basis, and
    takes in the patterns that the knapsack prices above one sequence, until it is within
    `gap` of a bound (the ids by the capacity, or the value over the best price), no
    pattern prices in, or ``STALL`` pricings in a row gain nothing. The fractional use is
    rounded down, then up in order of the fractions while items last; whole items that are
    left are filled up by ``residual``.
    """
    lengths = np.flatnonzero(count[:capacity])
    lengths = lengths[lengths > 0]
    m = len(lengths)
    if not m:
        return []
    # a little more of each, differently, so that few pivots stand still
    need = count[lengths] + JITTER * (1 + np.random.default_rng(0).random(m))
    patterns, x, inverse = _start(need, lengths, capacity)
    bound, idle = float(lengths @ need) / capacity, 0
    while True:
        dual = inverse.sum(axis=0)
        value = np.full(capacity, -np.inf)
        value[lengths - 1] = dual
        best, last = _knapsack(value, capacity)
        price = float(best.max())
        bound = max(bound, x.sum() / max(price, 1.0))
        if price <= 1 + 1e-7 or x.sum() <= bound * (1 + gap) or idle >= STALL:
            break
        # the best full pattern through each length; else the best one of any fill
        through = dual + best[capacity - lengths]
        ends = [(int(capacity - lengths[k]), k) for k in np.argsort(-through, kind="stable")[:COLUMNS_AT_ONCE] if through[k] > 1 + 1e-7]
        ends = ends or [(int(np.argmax(best)), -1)]
        before, entered = x.sum(), 0
        for fill, k in ends:
            column = _pattern(last, fill)[lengths]
            if k >= 0:
                column[k] += 1
            held = np.flatnonzero(column)
            step = inverse[:, held] @ column[held].astype(float)
            if step.sum() <= 1 + 1e-7:  # a column before it changed the prices
                continue
            ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
            out = int(np.argmin(ratio))
            if not np.isfinite(ratio[out]):
                continue
            use, row = ratio[out], inverse[out] / step[out]
            moved = np.flatnonzero(np.abs(step) > 1e-12)
            inverse[moved] -= np.outer(step[moved], row)
            inverse[out] = row
            x = np.maximum(x - use * step, 0)
            x[out] = use
            patterns[out] = column
            entered += 1
        if not entered:
            break
        idle = idle + 1 if before - x.sum() <= 1e-5 * before else 0
    left = count.astype(np.int64).copy()
    left[0] = left[capacity:] = 0
    uses: list[tuple[dict[int, int], int]] = []
    order = np.argsort(-(x - np.floor(x)), kind="stable")
    whole = np.floor(x + 1e-9).astype(np.int64)
    for extra in (False, True):
        for k in order:
            p = patterns[k]
            if int(p @ lengths) != capacity:
                continue
            held = np.flatnonzero(p)
            fits = int((left[lengths[held]] // p[held]).min())
            take = min(fits, 1 if extra else int(whole[k]))
            if take > 0:
                left[lengths[held]] -= take * p[held]
                uses.append((dict(zip(lengths[held].tolist(), p[held].tolist(), strict=True)), take))
    out = []
    for pattern, times in uses + residual(left, capacity):
        full = np.zeros(capacity + 1, np.int64)
        full[list(pattern)] = list(pattern.values())
        out.append((full, times))
    return out


class Plan:
    """Where the k-th remainder of each length goes."""

    def __init__(self, count: np.ndarray, capacity: int):
        self.capacity = capacity
        taken = np.zeros(capacity + 1, np.int64)
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for pattern, times in column_generation(count, capacity):
            offset = 0
            for size in np.flatnonzero(pattern).tolist():
                many = int(pattern[size])
                # ranks from `taken` on: `many` of them in each of `times` sequences
                rows.setdefault(size, []).append((int(taken[size]), many, sequence, offset))
                taken[size] += many * times
                offset += many * size
            sequence += times
        self.taken = taken
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}
        left = np.zeros(capacity + 1, np.int64)
        left[: len(count)] = count
        left -= taken
        left[0] = 0
        sizes = np.arange(capacity + 1) * left
        self.stream_base = np.cumsum(sizes) - sizes
        self.stream_length = int(sizes.sum())
        self.stream_sequence = sequence
        tail = self.stream_length % capacity
        cuts = [self.stream_length - tail]
        for bit in range(capacity.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                cuts.append(cuts[-1] + (1 << bit))
        self.tail_cuts = np.array(cuts, np.int64)
        self.full_sequence = sequence + self.stream_length // capacity + len(cuts) - 1

    def pieces(self, size: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of a remainder, in order."""
        if rank < self.taken[size]:
            rows = self.rows[size]
            start, many, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            k = rank - start
            return [(size, int(sequence + k // many), int(offset + k % many * size))]
        at = int(self.stream_base[size] + (rank - self.taken[size]) * size)
        end, out, tail = at + size, [], int(self.tail_cuts[0])
        while at < end:
            if at < tail:
                number = at // self.capacity
                begin = number * self.capacity
                stop = begin + self.capacity
            else:
                k = int(np.searchsorted(self.tail_cuts, at, "right")) - 1
                number = tail // self.capacity + k
                begin, stop = int(self.tail_cuts[k]), int(self.tail_cuts[k + 1])
            to = min(end, stop)
            out.append((to - at, self.stream_sequence + number, at - begin))
            at = to
        return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, if asked for, the ids themselves (little-endian uint32)."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.write(tokenised(docs, definition, capacity, end_id), "tokens")
    # at most one row for each task and remainder length
    cells = tokens.groupBy("rem", "part").agg(F.count("*").alias("k"), F.sum(F.expr(f"n div {capacity}")).alias("full"))
    cells = scratch.write(cells.repartition(max(1, spread(spark) // 4), "rem"), "cells")
    count = np.zeros(capacity + 1, np.int64)
    for r in cells.groupBy("rem").agg(F.sum("k").alias("k")).collect():  # fewer than `capacity` rows
        count[r["rem"]] = r["k"]
    count[0] = 0
    plan = Plan(count, capacity)
    by_length = Window.partitionBy("rem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = cells.withColumn("rank_base", F.coalesce(F.sum("k").over(by_length), F.lit(0)))

    def one_row(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros(capacity, np.int64)
        dense[x["rem"].to_numpy()] = x["rank_base"].to_numpy()
        return pd.DataFrame({"part": [key[0]], "rank_bases": [dense], "full": [int(x["full"].sum())]})

    per_part = scratch.write(ranks.groupBy("part").applyInPandas(one_row, "part long, rank_bases array<long>, full long"), "parts")  # one row for each task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    chunks = per_part.select("part", F.coalesce(F.sum("full").over(before), F.lit(0)).alias("chunk_base"))
    bases = per_part.select("part", "rank_bases").join(chunks, "part")
    if per_part.count() * capacity * 8 <= BROADCAST_BYTES:
        bases = F.broadcast(bases)
    rank, chunk = F.col("rank") + F.get("rank_bases", F.col("rem").cast("int")), F.col("chunk") + F.col("chunk_base")
    placed = tokens.join(bases, "part").select("doc_id", "n", "rem", rank.alias("rank"), chunk.alias("chunk"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(1, 5)]
            ids = batch.column(5)
            at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, ids.offset * 4)
            raw = memoryview(ids.buffers()[2] or b"")
            owner, out = [], [[] for _ in range(5)]  # start, length, checksum, sequence, offset
            for i, (n, rem, rank, chunk) in enumerate(zip(*cols, strict=True)):
                cuts = [(capacity, plan.full_sequence + chunk + k, 0) for k in range(n // capacity)]
                if rem:
                    cuts += plan.pieces(rem, rank)
                start, base = 0, int(at[i])
                for length, sequence, offset in cuts:
                    owner.append(i)
                    for c, v in zip(out, (start, length, zlib.crc32(raw[base + start * 4 : base + (start + length) * 4]), sequence, offset), strict=True):
                        c.append(v)
                    start += length
            who = pa.array(owner, pa.int64())
            start, length, crc, sequence, offset = (pa.array(c, pa.int64()) for c in out)
            arrays = [batch.column(0).take(who), start, length, crc, batch.column(1).take(who), sequence, offset]
            if with_ids:  # pieces follow each other as their documents' ids do: the same bytes, cut anew
                ends = np.concatenate([at[:1], at[0] + 4 * np.cumsum(length.to_numpy())]).astype(np.int32)
                arrays.append(pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(ends), ids.buffers()[2]]))
            yield pa.record_batch(arrays, names=names[: len(arrays)])

    return placed.mapInArrow(trimmed(run), _PIECES + ", ids binary" * with_ids)

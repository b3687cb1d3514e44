"""Removal of repeated byte strings by prefix-free parsing and suffix sorting.

Parsing. A rolling hash of ``GRAM`` bytes triggers phrase boundaries: of the grams of
each window of ``WIDTH`` bytes the one whose hash has the least upper bits (the last on
ties) is its trigger, so equal windows have the same trigger at the same place, and the parse of a
repeated passage repeats. A phrase is the run of window starts that share a trigger;
it is extended by the bytes its last window needs, so phrases with equal extended
bytes have equal windows throughout.

Dictionary. Only distinct extended phrases go on, each with its first place: repeats
within a task are settled there, the others meet by trigger hash (at most one row per
task and phrase, whatever the number of copies). A phrase whose trigger no other
phrase has holds no repeated window.

Order. Phrases that share a trigger but differ are fetched with their bytes. The
suffixes of these dictionary phrases, taken up to WIDTH bytes, are ranked by prefix
doubling (a suffix array cut at depth WIDTH); suffixes of one rank are the places of
one string, and all but the first place in corpus order are repeats.

Defined results: a null text is empty; texts of fewer than WIDTH bytes lose nothing;
rows of one doc_id with equal texts are one document (each row gets its result), with
unequal texts they are ordered by a hash of the text; null doc_ids come first and are
one doc_id in this; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread, trimmed
from .hashing import _powers, scramble
from .words import blocks, slices

WIDTH = 100
GRAM = 32
#: Phrases a task gathers before it settles its own repeats.
GATHER = 1_000_000

_PHRASES = "trigger long, phrase long, doc_id long, text_hash long, at int, lead short, size short"


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums of a polynomial over the bytes so far: the rolling hash of any stretch is a difference."""
    up, _ = _powers(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return total


def stretch_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes [start, end), from the prefix sums."""
    _, down = _powers(len(total))
    return scramble((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(total: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Rolling hash of the `gram` bytes from each place."""
    n = max(0, len(total) - gram)
    _, down = _powers(len(total))
    return scramble((total[gram : gram + n] - total[:n]) * down[:n])


def window_triggers(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least value among h[i : i + span] for every i: by its upper bits, the last
    place on ties. The lower bits carry the place, so minima of windows name it at once."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, len(h) - 1).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low, size = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64)), 1
    while size * 2 <= span:  # a window from two overlapping ones of a power of two
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return (mask - (np.minimum(low[:n], low[span - size : span - size + n]) & mask)).astype(np.int64)


def parse(b: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Phrases of a block of documents: trigger hash, phrase hash, document, first start in
    it, distance from there to the trigger, number of starts."""
    span = width - GRAM + 1
    z = np.zeros(0, np.int64)
    if len(b) < width:
        return z.view(np.uint64), z.view(np.uint64), z, z, z, z
    total = prefix_sums(b)
    h = gram_hashes(total)
    trigger = window_triggers(h, span)
    start = np.arange(len(trigger))
    doc = np.searchsorted(off, start, "right") - 1
    inside = start + width <= off[doc + 1]
    start, trigger, doc = start[inside], trigger[inside], doc[inside]
    if not len(start):
        return z.view(np.uint64), z.view(np.uint64), z, z, z, z
    new = np.ones(len(start), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    s, t, d = start[first], trigger[first], doc[first]
    phrase = scramble(stretch_hashes(total, s, s + size + width - 1) ^ scramble((t - s).astype(np.uint64)))
    return h[t], phrase, d, s - off[d], t - s, size


def _first_of(keys: list[np.ndarray], place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by keys, then place; and where a new key begins in it."""
    order = np.lexsort([*reversed(place), *reversed(keys)])
    begins = np.zeros(len(order), bool)
    begins[:1] = True
    for k in keys:
        begins[1:] |= k[order][1:] != k[order][:-1]
    return order, begins


def _once(order: np.ndarray, begins: np.ndarray, place: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each place of a key once: repeated rows of a document hold the same places."""
    fresh = begins.copy()
    for p in place:
        fresh[1:] |= p[order][1:] != p[order][:-1]
    return order[fresh], begins[fresh]


def phrases(docs: DataFrame, width: int) -> DataFrame:
    """Phrases by task: `kind` 0 for the first of its kind in the task, 1 for a repeat there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def settle() -> pa.RecordBatch:
            t, p, d, x, a, lead, size = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, begins = _once(*_first_of([t, p], [d, x, a]), [d, x, a])
            kind = np.where(begins, 0, 1).astype(np.int16)
            cols = [t.view(np.int64), p.view(np.int64), d, x, a.astype(np.int32), lead.astype(np.int16), size.astype(np.int16)]
            return pa.record_batch([*(pa.array(c[order]) for c in cols), pa.array(kind)], names=["trigger", "phrase", "doc_id", "text_hash", "at", "lead", "size", "kind"])

        many = 0
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "text_hash"))
            for lo, _, b, off in blocks(batch.column("text"), 1 << 19):
                t, p, d, a, lead, size = parse(b, off, width)
                held.append([t, p, ids[lo + d], hashes[lo + d], a, lead, size])
                many += len(t)
                if many > GATHER:
                    yield settle()
                    many = 0
        if held:
            yield settle()

    return docs.mapInArrow(trimmed(run), _PHRASES + ", kind short")


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 200_000) -> Iterator[pa.Table]:
    """Stretches of sorted rows that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        if sum(x.num_rows for x in held) + batch.num_rows > most:
            values = k.to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(values, values[-1], "left"))
            if cut or (held and held[-1].column(key)[-1].as_py() != values[0]):
                head = [*held, batch.slice(0, cut)]
                yield pa.Table.from_batches([x for x in head if x.num_rows])
                held = [batch.slice(cut)]
                continue
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by trigger. Out: kind 1 for repeats of a phrase, kind 2 for first phrases whose
    trigger others share."""
    for group in _groups(batches, "trigger"):
        g = group.combine_chunks()
        t, p, d, x, a = (g.column(c).to_numpy() for c in ("trigger", "phrase", "doc_id", "text_hash", "at"))
        order, begins = _once(*_first_of([t, p], [d, x, a]), [d, x, a])
        ts = t[order]
        kinds = np.zeros(len(order), np.int16)
        kinds[~begins] = 1
        first = np.flatnonzero(begins)
        tf = ts[first]
        shared = np.zeros(len(first), bool)
        shared[1:] |= tf[1:] == tf[:-1]
        shared[:-1] |= tf[1:] == tf[:-1]
        kinds[first[shared]] = 2
        keep = kinds > 0
        out = g.take(pa.array(order[keep]))
        for batch in out.append_column("kind", pa.array(kinds[keep])).to_batches():
            yield batch


def suffix_ranks(text: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the suffixes from `start`, cut at `width` bytes: prefix doubling, and a last
    step that overlaps the two halves. Equal ranks are equal strings."""
    size, rank = 1, text.astype(np.int64)
    while size * 2 <= width:
        rank = _joined(rank, size)
        size *= 2
    key = rank[start] * np.int64(len(text) + 256) + rank[start + width - size]
    return np.unique(key, return_inverse=True)[1]


def _joined(rank: np.ndarray, size: int) -> np.ndarray:
    n = len(rank) - size
    key = rank[:n] * np.int64(len(rank) + 256) + rank[size:]
    return np.unique(key, return_inverse=True)[1]


def _order(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Dictionary phrases with their bytes, by trigger: runs of repeated window starts."""
        for group in _groups(batches, "trigger", 20_000):
            g = group.combine_chunks()
            t, d, x, a, lead, size = (g.column(c).to_numpy().astype(np.int64) for c in ("trigger", "doc_id", "text_hash", "at", "lead", "size"))
            raw = g.column("bytes").combine_chunks() if isinstance(g.column("bytes"), pa.ChunkedArray) else g.column("bytes")
            raw = raw.cast(pa.large_binary())
            off = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
            text = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            row = np.repeat(np.arange(len(size)), size)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            rank = suffix_ranks(text, off[row] + step, width)
            order, begins = _first_of([rank], [d[row], x[row], a[row] + step])
            again = np.zeros(len(row), bool)
            again[order] = ~begins
            edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
            # runs may not cross phrases
            inner = np.flatnonzero((step == 0) & again & np.concatenate([[False], again[:-1]]))
            lo = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
            hi = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
            if len(lo):
                r = row[lo]
                yield pa.record_batch([pa.array(d[r]), pa.array(x[r]), pa.array((a[r] + step[lo]).astype(np.int32)), pa.array((a[r] + step[hi - 1] + width).astype(np.int32))], names=["doc_id", "text_hash", "start", "end"])

    return run


def _fetch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the phrases asked for, from their documents' texts."""
        for batch in batches:
            wanted = batch.column("wanted")
            off = wanted.offsets.to_numpy()
            flat = wanted.values
            trigger, at, lead, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))
            for lo, hi, b, text_off in blocks(batch.column("text"), 2 << 20):
                s, e = off[lo], off[hi]
                owner = np.repeat(np.arange(lo, hi), np.diff(off[lo : hi + 1]))
                start = text_off[owner - lo] + at[s:e]
                yield pa.record_batch(
                    [pa.array(trigger[s:e]), pa.array(ids[owner]), pa.array(hashes[owner]), pa.array(at[s:e]), pa.array(lead[s:e]), pa.array(size[s:e]), slices(b, start, start + size[s:e] + width - 1).cast(pa.binary())],
                    names=["trigger", "doc_id", "text_hash", "at", "lead", "size", "bytes"],
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their runs: union of the runs, sizes and the digest of what is left."""
    for batch in batches:
        runs = batch.column("runs")
        off = runs.offsets.to_numpy()
        start, end = (runs.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        valid = np.asarray(runs.is_valid())
        out: list[list] = [[], [], [], [], []]
        for lo, hi, b, text_off in blocks(batch.column("text")):
            raw = b.tobytes()
            for i in range(lo, hi):
                own = raw[text_off[i - lo] : text_off[i - lo + 1]]
                spans = []
                if valid[i] and off[i + 1] > off[i]:
                    s, e = start[off[i] : off[i + 1]], end[off[i] : off[i + 1]]
                    order = np.argsort(s, kind="stable")
                    s, reach = s[order], np.maximum.accumulate(e[order])
                    new = np.ones(len(s), bool)
                    new[1:] = s[1:] > reach[:-1]
                    first = np.flatnonzero(new)
                    spans = list(zip(s[first].tolist(), reach[np.append(first[1:], len(s)) - 1].tolist(), strict=True))
                left, at = hashlib.sha256(), 0
                for s0, e0 in spans:
                    left.update(own[at:s0])
                    at = e0
                left.update(own[at:])
                for c, v in zip(out, (len(own), sum(e0 - s0 for s0, e0 in spans), len(spans), left.hexdigest(), [x for p in spans for x in p]), strict=True):
                    c.append(v)
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges
    (start, end, start, end, ...) of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))).withColumn("text_hash", F.xxhash64("text"))
    found = scratch.write(phrases(text.select("id", "text_hash", "text"), width), "phrases")
    ends = (F.col("at") + F.col("size") + (width - 1)).alias("end")
    local = scratch.write(found.where("kind = 1").select("doc_id", "text_hash", F.col("at").alias("start"), ends), "local")
    parts = spread(spark) * 2
    firsts = found.where("kind = 0").drop("kind").repartition(parts, "trigger").sortWithinPartitions("trigger")
    met = scratch.write(firsts.mapInArrow(trimmed(_match), _PHRASES + ", kind short"), "met")
    scratch.drop("phrases")
    across = met.where("kind = 1").select("doc_id", "text_hash", F.col("at").alias("start"), ends)
    wanted = met.where("kind = 2").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("trigger", "at", "lead", "size")).alias("wanted"))
    one = text.select(F.col("id").alias("doc_id"), "text_hash", "text")
    asked = one.join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    dictionary = asked.mapInArrow(trimmed(_fetch(width)), _PHRASES.replace("phrase long, ", "") + ", bytes binary")
    partial = dictionary.repartition(parts, "trigger").sortWithinPartitions("trigger").mapInArrow(trimmed(_order(width)), "doc_id long, text_hash long, start int, end int")
    partial = scratch.write(partial, "partial")
    runs = local.union(across).union(partial).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    whole = text.join(runs.select(F.col("doc_id").alias("id"), "text_hash", "runs"), ["id", "text_hash"], "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(trimmed(_merge), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")

"""Binary token files: canonical length-limited Huffman codes in independent blocks.

One pass writes the ids of each run of documents in ascending doc_id order; the
global counts of ids (at most one row per vocabulary entry) give code lengths of
at most ``LIMIT`` bits by package-merge; a second pass writes code segments. A
segment holds its documents, their sizes and blocks of ``BLOCK`` ids, each with a
checkpoint (bit offset), so that any block decodes on its own; a reader decodes
all blocks of a segment in step, one table look-up per id. The files are Parquet
written by Spark (any Hadoop store): ``codes`` holds the segments, ``book`` the
code lengths.

Defined results: a null or empty text has the end id only; rows with one doc_id
stand next to each other in text order, null doc_id first; an empty table gives
no segment and no row; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, encoder, utf8_buffers
from .common import Scratch, spread, trimmed

#: Longest code in bits; the decoding table has 2**LIMIT entries.
LIMIT = 20
#: Ids of a block.
BLOCK = 256
#: Ids after which a segment is closed behind the document at hand.
SEGMENT = 1 << 18

_RUNS = "part int, segment int, first long, doc_ids array<long>, sizes array<long>, ids binary"
_CODES = "part int, segment int, first long, doc_ids array<long>, sizes array<long>, checkpoints array<long>, bits binary, check long"


def runs(docs: DataFrame, definition: str, end_id: int, parts: int) -> DataFrame:
    """Runs of documents in doc_id order: ids as little-endian uint32."""
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(definition)
        docs_: list = []
        flats: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        state = {"segment": 0, "first": 0, "held": 0}

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(flats)
            size = np.concatenate(sizes)
            row = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([state["segment"]], pa.int32()), pa.array([state["first"]], pa.int64()), pa.array([sum(docs_, [])], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int64())), pa.array([flat.astype("<u4").tobytes()], pa.binary())],
                names=["part", "segment", "first", "doc_ids", "sizes", "ids"],
            )
            state["segment"] += 1
            state["first"] += len(flat)
            state["held"] = 0
            docs_.clear(), flats.clear(), sizes.clear()
            return row

        for batch in batches:
            data, off = utf8_buffers(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK_BYTES, "right")) - 1)
                flat, n = enc.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], end_id)
                ids, ends = batch.column("doc_id").slice(lo, hi - lo).to_pylist(), np.append(0, np.cumsum(n))
                a = 0
                while a < len(n):  # as many documents as fill the segment
                    z = min(len(n), int(np.searchsorted(ends, ends[a] + SEGMENT - state["held"], "left")))
                    z = max(z, a + 1)
                    docs_.append(ids[a:z])
                    flats.append(flat[ends[a] : ends[z]])
                    sizes.append(n[a:z])
                    state["held"] += int(ends[z] - ends[a])
                    if state["held"] >= SEGMENT:
                        yield flush()
                    a = z
                lo = hi
        if flats:
            yield flush()

    return ordered.mapInArrow(trimmed(run), _RUNS)


def counts(table: DataFrame, vocabulary: int) -> np.ndarray:
    """Global counts of ids; every task sends at most one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), "<u4"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in table.select("ids").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def code_lengths(count: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge); 0 for absent ids."""
    ids = np.flatnonzero(count)
    out = np.zeros(len(count), np.int64)
    if len(ids) < 2:
        out[ids] = 1
        return out
    if len(ids) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = ids[np.argsort(count[ids], kind="stable")]
    weight = count[order].astype(np.float64)
    n = len(order)
    levels: list[np.ndarray] = []  # per level: positions of packages in the merged list, in order
    merged = weight
    is_leaf = np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        pairs = len(merged) // 2
        package = merged[: 2 * pairs : 2] + merged[1 : 2 * pairs : 2]
        joint = np.concatenate([weight, package])
        rank = np.argsort(joint, kind="stable")
        levels.append(rank < n)
        merged = joint[rank]
    take = 2 * n - 2
    size = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):  # of the first `take`, leaves lengthen; packages open below
        chosen = is_leaf[:take]
        leaves = int(chosen.sum())
        size[:leaves] += 1
        take = 2 * (len(chosen) - leaves)
    out[order] = size
    return out


def canonical(length: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    code = np.zeros(len(length), np.uint64)
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    value, last = 0, 0
    sizes = length[order]
    for k, (i, size) in enumerate(zip(order.tolist(), sizes.tolist(), strict=True)):
        value = 0 if k == 0 else (value + 1) << (size - last)
        last = size
        code[i] = value
    return code


def encode_ids(ids: np.ndarray, code: np.ndarray, length: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """Bits (most significant first) and the bit offset of each block."""
    size = length[ids]
    end = np.cumsum(size)
    at = end - size
    checkpoints = at[::block].copy()
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    slot = at >> 5
    shift = (64 - (at & 31) - size).astype(np.uint64)
    value = code[ids] << shift  # in a window of 64 bits that starts at the slot
    if len(ids):
        begin = np.flatnonzero(np.diff(slot, prepend=-1))
        held = np.add.reduceat(value, begin)  # codes don't overlap, so a sum is an or
        np.add.at(words, slot[begin], held >> np.uint64(32))
        np.add.at(words, slot[begin] + 1, held & np.uint64(0xFFFFFFFF))
    return words.astype(">u4").tobytes(), checkpoints


def decode_table(length: np.ndarray, code: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length by the next `limit` bits."""
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    many = np.left_shift(1, limit - length[order])
    ids, sizes = np.repeat(order.astype(np.uint32), many), np.repeat(length[order].astype(np.uint8), many)
    rest = (1 << limit) - len(ids)
    return np.append(ids, np.zeros(rest, np.uint32)), np.append(sizes, np.ones(rest, np.uint8))


def decode_bits(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray], limit: int = LIMIT, block: int = BLOCK) -> np.ndarray:
    """All blocks in step: the k-th id of each block at once."""
    words = np.append(np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64))
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    by_bits, sizes = table
    at = checkpoints.astype(np.int64).copy()
    out = np.zeros((len(at), block), np.uint32)
    last = n - (len(at) - 1) * block if len(at) else 0
    mask = np.uint64((1 << limit) - 1)
    for k in range(block if len(at) > 1 else last):
        live = len(at) if k < last else len(at) - 1
        a = at[:live]
        key = (pairs[a >> 5] >> (64 - limit - (a & 31)).astype(np.uint64)) & mask
        out[:live, k] = by_bits[key]
        at[:live] += sizes[key]
    return out.reshape(-1)[:n]


def write_files(table: DataFrame, length: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Writes the code segments and the code book; returns both as read back."""
    spark = table.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = canonical(length)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row.column(5)[0].as_buffer(), "<u4")
                bits, checkpoints = encode_ids(ids, code, length)
                yield pa.record_batch([*row.columns[:5], pa.array([checkpoints], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([zlib.crc32(bits)], pa.int64())], names=["part", "segment", "first", "doc_ids", "sizes", "checkpoints", "bits", "check"])

    codes = scratch.write(table.mapInArrow(trimmed(run), _CODES), "codes")
    used = np.flatnonzero(length)
    book = scratch.write(spark.createDataFrame([(int(i), int(length[i])) for i in used], "id long, bits int").coalesce(1), "book")
    return codes, book


def read_files(codes: DataFrame, book: DataFrame, vocabulary: int) -> DataFrame:
    """Decodes every segment: one row per document with its ids (little-endian uint32),
    the segment's place and the ids before it in that part of the files."""
    length = np.zeros(vocabulary, np.int64)
    for r in book.collect():  # at most the vocabulary
        length[r["id"]] = r["bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(length, canonical(length))
        for batch in batches:
            for r in batch.to_pylist():
                if zlib.crc32(r["bits"]) != r["check"]:
                    raise ValueError(f"segment {r['part']}/{r['segment']} is damaged")
                size = np.array(r["sizes"], np.int64)
                ids = decode_bits(r["bits"], np.array(r["checkpoints"], np.int64), int(size.sum()), table).astype("<u4")
                ends = np.cumsum(size)
                off = np.concatenate([[0], ends * 4]).astype(np.int32)
                yield pa.record_batch(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(np.full(len(size), r["part"], np.int32)), pa.array(r["first"] + ends - size), pa.array(size), pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(ids)]), pa.array([zlib.crc32(ids[e - s : e]) for s, e in zip(size, ends, strict=True)], pa.int64())],
                    names=["doc_id", "part", "before", "n_tokens", "ids", "ids_crc32"],
                )

    return codes.mapInArrow(trimmed(run), "doc_id long, part int, before long, n_tokens long, ids binary, ids_crc32 long")


def token_files(docs: DataFrame, definition: str, vocabulary: int, end_id: int = 1) -> DataFrame:
    """Encodes all documents, writes the files and reads them: doc_id, start, n_tokens, ids, ids_crc32."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    table = scratch.write(runs(docs, definition, end_id, spread(spark) * 2), "runs")
    codes, book = write_files(table, code_lengths(counts(table, vocabulary)), scratch)
    scratch.drop("runs")
    read = read_files(codes, book, vocabulary)
    # one row per part of the files; the window is over those few rows
    totals = codes.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return read.join(F.broadcast(base), "part").select("doc_id", (F.col("before") + F.col("base")).alias("start"), "n_tokens", "ids", "ids_crc32")

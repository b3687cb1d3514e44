"""Exact groups and MinHash links of documents (128 permutations, 32 bands of 4).

Defined results: null texts link with nothing; texts of fewer words than a shingle are one shingle;
an empty table gives no link; repeated doc ids are an error of the caller."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.lineage import cut

PRIME = (1 << 31) - 1
PERMUTATIONS, BANDS, SHINGLE = 128, 32, 5
BLOCK = 256  # shingles permuted at once
TILE = 1024  # members of a band that meet in one task


def factors(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and shifts of the permutations (a x + b) mod PRIME."""
    i = np.arange(1, n + 1, dtype=np.int64)
    return (i * 48271 * 7919 + 1) % PRIME, (i * 69621 * 104729 + 7) % PRIME


def shingle_hashes(text: str, n: int = SHINGLE) -> np.ndarray:
    """31-bit hashes of the distinct n-word shingles of a case-folded text; a short text is one shingle."""
    words = text.encode().split()  # at ASCII white space
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(n))))) if len(words) >= n else {b" ".join(words)}
    first = np.frombuffer(b"".join([hashlib.sha256(g).digest() for g in grams]), ">u8")[::4]
    return (first >> 4).astype(np.uint64) % np.uint64(PRIME)  # of 15 hex digits


def fractions() -> tuple[np.ndarray, np.ndarray]:
    """The factors as fractions of PRIME in 64 bits, rounded up."""
    return tuple(np.array([-((-int(x) << 64) // PRIME) for x in f], np.uint64) for f in factors())


def least(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each permutation, given as `fractions`.

    Products of fractions wrap at 2**64 as values do at PRIME; neighbours lie 2**33 apart and an error
    stays under 2**32, so their order is that of the values, which are read back exactly."""
    best = np.full(len(a), (1 << 64) - 1, np.uint64)
    for lo in range(0, len(h), BLOCK):
        u = h[lo : lo + BLOCK, None] * a
        u += b
        np.minimum(best, u.min(axis=0), out=best)
    high, low = best >> np.uint64(33), best & np.uint64((1 << 33) - 1)
    return high.astype(np.int64) - ((low << np.uint64(31)) < best)  # best * PRIME >> 64


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, text) -> (doc, h, key, sig): the content hash, a 128-bit hash of the signature, and it: the least
    value of each permutation. Null texts have none."""
    known = docs.where("text IS NOT NULL").select(F.col("doc").cast("long").alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = fractions()
        for batch in batches:
            sig, h, key = np.empty((len(batch), PERMUTATIONS), np.int32), [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                sig[i] = least(shingle_hashes(text.casefold()), a, b)
                h.append(T.content_digest(text))
                key.append(hashlib.blake2b(sig[i].tobytes(), digest_size=16).digest())
            slots = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, PERMUTATIONS, dtype=np.int32)), pa.array(sig.ravel()))
            yield pa.record_batch([batch.column(0), pa.array(h, pa.string()), pa.array(key, pa.binary()), slots], names=["doc", "h", "key", "sig"])

    return known.mapInArrow(run, "doc long, h string, key binary, sig array<int>")


def links(docs: DataFrame, low: float = 0.85) -> DataFrame:
    """(a, b, j) of canonical documents that share a band and agree in at least `low` of the slots."""
    return agreeing(cut(signatures(docs.where("doc IS NOT NULL"))), low)


def agreeing(signed: DataFrame, low: float = 0.85) -> DataFrame:
    """`links` of signatures that are written already.

    Where at most m slots may differ, one of m + 1 groups of slots is the same: up to m = 30 these are
    wider than the bands, and a pair shares a band anyway, having 32 of them. Equal signatures
    meet as one; only the pairs that are returned are told apart again."""
    differ = PERMUTATIONS - math.ceil(low * PERMUTATIONS - 1e-9)
    n = min(differ + 1, BANDS)
    ends = [PERMUTATIONS * i // n for i in range(n + 1)]
    first = signed.groupBy("key").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    members = signed.select("key", "doc").join(first, "key").select("rep", "doc")
    sig = signed.join(first.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", "sig")
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("sig", lo + 1, hi - lo)) for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False))))
    pairs = _meeting(sig.select("doc", F.explode(keys).alias("key")))
    both = pairs.join(sig.select(F.col("doc").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc").alias("b"), F.col("sig").alias("sb")), "b")
    j = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x)) / PERMUTATIONS
    near = both.select("a", "b", j.alias("j")).where(F.col("j") >= low).union(first.where("n > 1").select("rep", "rep", F.lit(1.0)))
    each = near.join(members.select(F.col("rep").alias("a"), F.col("doc").alias("x")), "a").join(members.select(F.col("rep").alias("b"), F.col("doc").alias("y")), "b")
    return each.where("a <> b OR x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "j")


def _meeting(bands: DataFrame) -> DataFrame:
    """(doc, key) -> distinct (a, b), a < b, with a common key; a large key's members meet by pairs of tiles."""
    tiles = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    held = bands.join(tiles, "key").withColumn("t", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    one = held.select("key", F.col("doc").alias("a"), F.col("t").alias("ta"), F.explode(F.sequence("t", F.col("tiles") - 1)).alias("tb"))
    other = held.select("key", F.col("doc").alias("b"), F.col("t").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("t"))).alias("ta"))
    met = one.join(other, ["key", "ta", "tb"]).where("ta < tb OR a < b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def merges(signed: DataFrame) -> DataFrame:
    """(doc, to): the greatest smaller document whose signature differs in one slot at most.

    Two such signatures are the same once one slot is left out. Among the documents that share a rest the nearest
    smaller one is looked up, so rows grow with documents, not with pairs; only documents whose one half
    of the slots occurs again have their rests made."""
    half = PERMUTATIONS // 2
    sig = signed.select("doc", "sig")
    halves = sig.select("doc", F.explode(F.array(*(F.xxhash64(F.lit(i), F.slice("sig", i * half + 1, half)) for i in range(2)))).alias("key"))
    again = halves.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rests = sig.join(halves.join(again, "key", "left_semi").select("doc").distinct(), "doc", "left_semi").mapInArrow(_rests, "doc long, slot int, k1 long, k2 long")
    before = rests.withColumn("to", F.lag("doc").over(Window.partitionBy("slot", "k1", "k2").orderBy("doc")))
    return before.where("to IS NOT NULL").groupBy("doc").agg(F.max("to").alias("to"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sig) -> (doc, slot, k1, k2): two 64-bit hashes of the signature without each slot, sums of mixed values."""
    slot = np.arange(PERMUTATIONS, dtype=np.uint64)
    for batch in batches:
        for lo in range(0, len(batch), 1024):
            part = batch.slice(lo, 1024)
            sig = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, PERMUTATIONS).astype(np.uint64)
            hashes = []
            for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                m = _mixed(_mixed(sig + (slot << np.uint64(32))) + np.uint64(seed))
                hashes.append((m.sum(axis=1, dtype=np.uint64)[:, None] - m).ravel().view(np.int64))
            doc = np.repeat(part.column(0).to_numpy(), PERMUTATIONS)
            yield pa.record_batch([pa.array(doc), pa.array(np.tile(slot.astype(np.int32), len(part))), *map(pa.array, hashes)], names=["doc", "slot", "k1", "k2"])

"""Quality classifier: a factorisation machine.

Features of a whole text: hashed words (log counts, unit length), structure statistics
and the length column, each in bins. Score:

    w0 + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum v_if^2 x_i^2 ]

the pairwise interactions in linear time by the sum-of-squares identity. The model is
fitted on the driver by AdaGrad from at most ``TRAIN_ROWS`` labelled rows (a documented
bound; features of long texts are bounded by the number of buckets), every row is
scored on the executors with the model (``BUCKETS`` + bins rows) sent along.

Defined results: a null or empty text has the statistics' lowest bins and gets a score
like any other; null labels are not learned from; a doc_id with several labels counts
with each; equal rows teach once; rows that share a doc_id are scored one by one; with no labels, or no table
rows, the score is the prior 0.5; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled, trimmed
from . import rules
from .hashing import slice_hashes
from .words import blocks, per_doc, word_runs

BUCKETS = 1 << 14
BINS = 16
FACTORS = 4
TRAIN_ROWS = 5000
EPOCHS = 6
_STATS = ["n_words", "chars_per_word", "symbols", "dup_lines", "repeats", "words_per_line", "capitals", "distinct", "digits", "punctuation", "stop_end", "n_chars"]
SIZE = BUCKETS + BINS * len(_STATS)
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_PUNCT = np.isin(np.arange(256), np.frombuffer(b"!?,;:.-\"'()", np.uint8))
_END = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def _bin(x: np.ndarray, top: float) -> np.ndarray:
    """Bins of equal width on a root scale, 0 for nothing."""
    return np.minimum(BINS - 1, np.ceil(np.sqrt(np.clip(x / top, 0, 1)) * (BINS - 1))).astype(np.int64)


def featurise(b: np.ndarray, off: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and value of every non-zero feature, by document."""
    n = len(off) - 1
    n_words, word_chars, symbols, dup, repeat, lines, capitals, letters = rules._block(b, off)
    start, end, doc = word_runs(_LOWER[b], off)
    bucket = (slice_hashes(_LOWER[b], start, end) >> np.uint64(50)).astype(np.int64)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    d, f = key // BUCKETS, key % BUCKETS
    v = np.log1p(count)
    norm = np.sqrt(np.bincount(d, v * v, minlength=n))
    v = v / np.maximum(norm[d], 1e-9)
    w, one = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    stats = [
        (np.log1p(n_words), 12.0),
        (word_chars / w, 20.0),
        (symbols / one, 0.6),
        (dup / np.maximum(lines, 1), 1.0),
        (repeat / w, 1.0),
        (np.log1p(n_words / np.maximum(lines, 1)), 8.0),
        (capitals / np.maximum(letters, 1), 1.0),
        (np.bincount(d, minlength=n) / w, 1.0),
        (per_doc(_DIGIT[b], off) / one, 0.5),
        (per_doc(_PUNCT[b], off) / w, 3.0),
        (per_doc(_END[b], off) / w, 1.0),
        (np.log1p(np.maximum(n_chars, 0)), 14.0),
    ]
    docs, feats, vals = [d], [f], [v]
    for k, (x, top) in enumerate(stats):
        docs.append(np.arange(n))
        feats.append(BUCKETS + k * BINS + _bin(x, top))
        vals.append(np.ones(n))
    d, f, v = np.concatenate(docs), np.concatenate(feats), np.concatenate(vals)
    order = np.argsort(d, kind="stable")
    return d[order], f[order], v[order]


class Machine:
    def __init__(self, seed: int = 0):
        self.w0 = 0.0
        self.w = np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (SIZE, FACTORS))

    def raw(self, d: np.ndarray, f: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.searchsorted(d, np.arange(n), "left")
        vx = self.v[f] * x[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        q = np.add.reduceat(vx * vx, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[f] * x, first) + 0.5 * (s * s - q).sum(axis=1), s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 0) -> Machine:
        if not rows:
            return self
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(SIZE, 1e-8), np.full((SIZE, FACTORS), 1e-8), 1e-8
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(rows), batch):
                part = [rows[i] for i in order[lo : lo + batch]]
                d = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
                f, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                y = np.array([r[2] for r in part], float)
                z, s = self.raw(d, f, x, len(part))
                e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
                ids, back = np.unique(f, return_inverse=True)
                ex = e[d] * x
                dw = np.bincount(back, ex) / len(part) + decay * self.w[ids]
                term = ex[:, None] * (s[d] - self.v[f] * x[:, None])
                dv = np.stack([np.bincount(back, term[:, k]) for k in range(FACTORS)], axis=1) / len(part) + decay * self.v[ids]
                gw[ids] += dw * dw
                gv[ids] += dv * dv
                g0 += e.mean() ** 2
                self.w[ids] -= rate * dw / np.sqrt(gw[ids])
                self.v[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
                self.w0 -= rate * e.mean() / np.sqrt(g0)
        return self


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(F.col("n_chars").cast("long"), F.length("text").cast("long"), F.lit(0).cast("long")).alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine:
    """Learns from a seeded choice of at most `train_rows` labelled rows outside the held-out third."""
    picked = labelled(_rows(docs), labels, "quality", train_rows, ["n_chars"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chars = batch.column("n_chars").to_numpy()
            for lo, hi, b, off in blocks(batch.column("text")):
                d, f, x = featurise(b, off, n_chars[lo:hi])
                cut = np.searchsorted(d, np.arange(hi - lo + 1), "left")
                yield pa.record_batch(
                    [batch.column("id").slice(lo, hi - lo).cast(pa.int64()), batch.column("quality").slice(lo, hi - lo), pa.array([f[s:e].astype(np.int32).tobytes() for s, e in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([x[s:e].astype(np.float32).tobytes() for s, e in zip(cut, cut[1:], strict=False)], pa.binary())],
                    names=["id", "quality", "f", "x"],
                )

    got = picked.select("id", "text", "n_chars", "quality").mapInArrow(trimmed(run), "id long, quality int, f binary, x binary").collect()  # at most train_rows rows
    got.sort(key=lambda r: (r["id"], r["quality"], r["f"], r["x"]))
    return Machine().fit([(np.frombuffer(r["f"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float), r["quality"]) for r in got])


def score(docs: DataFrame, machine: Machine, carry: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1) and the carried columns of every row."""
    carry = carry or []
    length = F.coalesce(F.col("n_chars").cast("long"), F.length("text").cast("long"), F.lit(0).cast("long")).alias("length_")
    rows = docs.select("doc_id", *carry, length, *([] if "text" in carry else ["text"]))
    out = docs.select("doc_id", *carry).schema.add("score", "double")
    w0, w, v = machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine()
        own.w0, own.w, own.v = w0, w, v
        for batch in batches:
            n_chars = batch.column("length_").to_numpy()
            for lo, hi, b, off in blocks(batch.column("text")):
                z, _ = own.raw(*featurise(b, off, n_chars[lo:hi]), hi - lo)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([*(part.column(f.name) for f in out.fields[:-1]), pa.array(p.astype(np.float64))], names=out.names)

    return rows.mapInArrow(trimmed(run), out)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

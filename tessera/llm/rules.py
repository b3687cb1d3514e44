"""Rule bitmask ledger.

``measure`` takes the measurements of every whole text once; ``ledger`` evaluates
every rule once and stores the failures as bits beside the measurements; policies
(versioned masks of rules) and ablations are then bit operations on the ledger,
with no further look at a text.

Defined results: a null or empty text has no words and fails ``few_words``; every
row is judged by itself, so repeated rows and ties repeat; an empty table gives no
row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from . import words

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_letters"]

#: Rule by bit: name and the SQL condition of failure, over the measurements. Bits keep their meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 8 * word_chars"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 14 * n_words"),
    ("capitals", "100 * n_capitals > 50 * n_letters"),
]
#: Rules each policy version applies.
POLICIES: dict[str, list[str]] = {
    "v1": ["few_words", "repeated_words"],
    "v2": ["few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "capitals"],
}
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)


def _block(b: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    start, end, doc = words.word_runs(b, off)
    n_words = np.bincount(doc, minlength=n)
    char = (b & 0xC0) != 0x80
    white = (b == 32) | ((b >= 9) & (b <= 13))
    word_chars = words.per_doc(char & ~white, off)
    # lines: cut at line feeds and at the ends of texts
    cuts = np.unique(np.concatenate([off, np.flatnonzero(b == 10) + 1]))
    ls, le = cuts[:-1], cuts[1:].copy()
    le[(le > ls) & (b[np.maximum(le, 1) - 1] == 10)] -= 1
    has_word = np.searchsorted(start, le, "left") > np.searchsorted(start, ls, "left")
    ls, le = ls[has_word], le[has_word]
    line_doc = np.searchsorted(off, ls, "right") - 1
    key = line_doc * np.int64(1 << 32) + words.codes(b, ls, le)
    n_lines = np.bincount(line_doc, minlength=n)
    distinct = np.bincount(np.unique(key) >> 32, minlength=n) if len(key) else np.zeros(n, np.int64)
    # windows of three words, by document
    code = words.codes(b, start, end)
    repeated = np.zeros(len(code), bool)
    if len(code) > 2:
        base = np.int64(code.max() + 1)
        same = (doc[2:] == doc[:-2]).nonzero()[0]
        pair = np.unique(code[:-1] * base + code[1:], return_inverse=True)[1]
        triple = pair[same] * base + code[same + 2]
        order = np.lexsort((triple, doc[same]))
        t, d = triple[order], doc[same][order]
        like = (t[1:] == t[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= like
        twice[:-1] |= like
        at = same[order[twice]]
        for k in range(3):
            repeated[at + k] = True
    n_repeat = np.bincount(doc[repeated], minlength=n)
    upper, lower = words.per_doc(_UPPER[b], off), words.per_doc(_LOWER[b], off)
    return [n_words, word_chars, words.per_doc(_SYMBOLS[b], off), n_lines - distinct, n_repeat, n_lines, upper, upper + lower]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its whole text (see the README for each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi, b, off in words.blocks(batch.column("text")):
                yield pa.record_batch([ids.slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in _block(b, off))], names=["doc_id", *_MEASURES])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failures``: bit k is set where rule k fails."""
    bits = " | ".join(f"IF({condition}, {1 << k}L, 0L)" for k, (_, condition) in enumerate(RULES))
    return measure(docs).withColumn("failures", F.expr(bits))


def mask(rules: list[str]) -> int:
    place = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << place[r] for r in rules)


def passes(policy: str, failures: Column | None = None) -> Column:
    return (failures if failures is not None else F.col("failures")).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents it fails, documents it alone fails, and what the
    policy keeps without it. One pass: rows are first counted by their failure bits."""
    own = mask(POLICIES[policy])
    seen = rows.groupBy(F.col("failures").bitwiseAND(F.lit(own)).alias("f")).agg(F.count("*").alias("n"))  # at most 2**rules rows
    names = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = seen.select("f", "n", names.alias("r")).select("f", "n", "r.*")
    hit = F.col("f").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(F.col("f").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def verdicts(docs: DataFrame, policy: str = "v2") -> DataFrame:
    rows = ledger(docs)
    base = F.col("failures").bitwiseAND(F.lit(mask(["few_words", "repeated_words"]))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failures")


VERDICT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT k, i, x, lead(x) OVER q AS y, lead(x, 2) OVER q AS z FROM p WINDOW q AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x, y, z) AS n FROM g WHERE z IS NOT NULL) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n_repeat FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT k, count(*) AS n_lines, count(DISTINCT line) AS n_distinct FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
s AS (
  SELECT d.k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines - n_distinct, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters
  FROM d JOIN w USING (k) LEFT JOIN c USING (k) LEFT JOIN m USING (k)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 8 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars > 14 * n_words OR 100 * up > 50 * letters) AS kept,
  CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 8 * word_chars)::INT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (word_chars > 14 * n_words)::INT + 32 * (100 * up > 50 * letters)::INT AS BIGINT) AS failures
FROM f
"""

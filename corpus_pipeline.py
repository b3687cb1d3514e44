"""The corpus pipeline: quality, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all
but the last return the columns of documents. ``run`` writes each stage's result as
Parquet to the shared folder and rereads it, which cuts the lineage.

Defined results, besides what each stage says: an empty table gives an empty table; texts of
any length are taken whole; columns beside those of documents go along unread, whatever
their names (near-dedup needs them to be comparable, so no maps); repeated rows are
rows of their own but in near-dedup.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash, mixing, pii, quality
from tessera.llm.common import Scratch, table
from tessera.llm.packing import pack
from tessera.llm.queries import definition
from tessera.llm.words import blocks, word_runs


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(stage: Stage) -> Stage:
    """The stage with all columns that are not its own as one, so that their names clash with nothing."""

    @functools.wraps(stage)
    def held(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = [c for c in docs.columns if c not in _OWN]
        if not extra:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*(c for c in docs.columns if c in _OWN), F.struct(*extra).alias("beside")), sf_dir)
        return out.select(*(F.col("beside")[c].alias(c) if c in extra else F.col(c) for c in docs.columns))

    return held


@_beside
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at 0.5 or more. The machine learns
    from the whole documents table's labelled rows, as op4 does. Null and empty texts have a
    score like any other, and so have null doc_ids; a null n_chars is counted."""
    machine = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.score(docs, machine, [c for c in docs.columns if c != "doc_id"]).where("score >= 0.5").select(docs.columns)


@_beside
def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five words, 0.8): the smallest id, of its texts
    in the group the one of least hash, of equal texts the least row. Texts without words are
    in no group, but their repeated rows go; a null doc_id is in no group and stays."""
    found = minhash.near_duplicates(docs, k=5, percent=80, row_keys=True).where("doc_id IS NOT NULL")
    grouped = found.where("kept AND component_key IS NOT NULL").groupBy("component_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    chosen = grouped.union(found.where("component_key IS NULL").select("doc_id", "text_hash").distinct())
    rest = [c for c in docs.columns if c != "doc_id"]
    hashed = docs.withColumn("text_hash", minhash.text_hash()).join(chosen, ["doc_id", "text_hash"], "left_semi")
    single = hashed.groupBy("doc_id", "text_hash").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "row.*").select(docs.columns)
    return single.union(docs.where("doc_id IS NULL"))


@_beside
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its personal data masked and n_chars to match; a null text stays null."""
    return pii.mask_documents(docs)


def _cut(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The stretches of words that the mix takes, as texts: copy c of a document holds the
    stretches taken c times or more; a document taken whole stays as it is."""
    schema = docs.select(columns).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            rows, texts = [], []
            for lo, hi, b, off in blocks(batch.column("text")):
                raw = b.tobytes()
                start, _, doc = word_runs(b, off)
                first = doc.searchsorted(range(hi - lo + 1), "left")
                for k in range(hi - lo):
                    own = start[first[k] : first[k + 1]].tolist()
                    edge = [int(off[k]), *own[1:], int(off[k + 1])]  # word w runs from edge[w] to edge[w + 1]
                    for copy in range(1, max((p["times"] for p in parts[lo + k]), default=0) + 1):
                        rows.append(lo + k)
                        texts.append("".join(raw[edge[p["start"]] : edge[p["end"]]].decode() for p in parts[lo + k] if p["times"] >= copy))
            at = pa.array(rows, pa.int64())
            cols = []
            for f in schema.fields:
                if f.name == "text":
                    cols.append(pa.array(texts, pa.string()))
                elif f.name == "n_chars":
                    cols.append(pa.array([len(t) for t in texts], pa.int64()))
                else:
                    cols.append(batch.column(f.name).take(at))
            yield pa.record_batch(cols, names=schema.names)

    return docs.mapInArrow(run, schema)


@_beside
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a document comes up to three times, cut at the mix's blocks.
    Texts without words are not taken; null sources are one source."""
    mixed = mixing.mix(docs, carry=[c for c in docs.columns if c not in ("doc_id", "source")], keep_source=True)
    return _cut(mixed, docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, with their ids; a null or empty text is its end id."""
    return pack(docs, definition("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: SQL states neither the fitted models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            scratch.drop(f"stage{k}")
    return docs

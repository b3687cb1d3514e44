"""Shared helpers of the subpackage: scratch tables, readers, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (spark.checkpoint.dir); an own one only where it is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone: the folder's owner clears it
        pass


class Scratch:
    """Tables written to the shared folder: they cut the lineage and survive the loss of
    an executor. Dropped by hand once unused, else when the interpreter ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")


def held_out(doc_id: Column) -> Column:
    """The third of the documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int, more: list[str] | None = None) -> DataFrame:
    """(id, <target>, h, text, *more): at most `most` labelled rows (0 or 1) outside the held-out third, in the
    order of a hash; equal rows once. The bound holds for the rows, however many share a doc_id.

    Short rows are ordered first; the texts of those chosen are then looked up."""
    more = more or []
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col(target).cast("int").alias(target)).distinct()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more).withColumn("h", F.xxhash64("doc_id", "text", *more))
    short = rows.select("doc_id", "h").join(known, F.col("doc_id") == F.col("id")).select("h", "id", target).distinct()
    first = short.orderBy("h", "id", target).limit(most).withColumnRenamed("h", "h_")
    same = (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("h_"))
    return rows.join(F.broadcast(first), same).select("id", target, "h", "text", *more).dropDuplicates(["id", target, "h"])  # `most` short rows


def n_words(text: Column) -> Column:
    """Words of a text; null counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An Arrow function that gives its free memory back to the system when its task ends: workers
    are kept for later tasks, whose memory would come on top."""

    def with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return with_end


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

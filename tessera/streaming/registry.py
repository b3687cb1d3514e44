"""The registry as a stateful stream: mutations come in micro-batches, state and identifiers are tables.

Each batch writes three tables under its number: its part of the log, the new state of every
document and the identifiers it gave out. A batch reads only what batches before it wrote, so
running it again (after a crash, or a restart from the stream's checkpoint) replaces its own
output by the same rows; readers take the last batch that ended. The single stream is the one
writer: a prefix's counter only rises, an identifier is given out once and stays with its
document, also after a tombstone.

A document whose mutations arrive in order is folded on from its state; one that gets a mutation
older than what was seen of it is folded anew from its log, so the result does not depend on
how the log was cut into batches.

Defined results: mutations of null documents are dropped; unknown event types do nothing; repeated
event ids count as often as they come; ties in time go by event id; an empty batch writes
nothing; without any batch there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import registry as REG

_LOG = "doc bigint, ts timestamp_ntz, event_id bigint, op string, value double"
_STATE = "doc bigint, born boolean, live boolean, creates bigint, updates bigint, patches bigint, epoch bigint, last_patch double, last_ts timestamp_ntz, last_id bigint, first_ts timestamp_ntz, first_id bigint"
_ISSUED = "doc bigint, prefix string, ordinal bigint"


class Registry:
    """State under a folder that all machines share; `prefix` is the SQL of a document's prefix of codes."""

    def __init__(self, spark: SparkSession, root: str, prefix: str):
        self.spark, self.root, self.prefix = spark, root.rstrip("/"), prefix

    # -------------------------------------------------- tables by batch

    def _done(self) -> list[int]:
        """Batches that ended: their marks are written last."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/done")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [f"{self.root}/{table}/{b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, table: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.root}/{table}/{batch}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def state(self) -> DataFrame:
        """(doc, state, creates, updates, patches, epoch, last_patch) of every document that was created."""
        rows = self._read("state", _STATE, self._done()[-1:]).where("born")
        state = F.when(~F.col("live"), "TOMBSTONED").when(F.col("updates") > 0, "ACTIVE_COLD_START").otherwise("ACTIVE_LEARNED")
        return rows.select("doc", state.alias("state"), "creates", "updates", "patches", "epoch", F.round("last_patch", 6).alias("last_patch"))

    def issued(self) -> DataFrame:
        """(doc, prefix, ordinal) of every identifier given out."""
        return self._read("issued", _ISSUED, self._done())

    # -------------------------------------------------- a batch

    def merge(self, events: DataFrame, batch: int) -> None:
        """Takes one micro-batch in; the same number again has the same effect."""
        before = [b for b in self._done() if b < batch]
        log = self._write(REG.mutations(events).where("doc IS NOT NULL").select("doc", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").cast("bigint").alias("event_id"), "op", F.col("value").cast("double").alias("value")), "log", batch, _LOG)
        old = self._read("state", _STATE, before[-1:])
        first = log.groupBy("doc").agg(F.min(F.struct("ts", "event_id")).alias("from_"))
        touched = first.join(old, "doc", "left")
        late = touched.where(F.struct("last_ts", "last_id") >= F.col("from_")).select("doc")
        again = self._read("log", _LOG, before).join(late, "doc", "left_semi").unionByName(log.join(late, "doc", "left_semi"))
        on = log.join(late, "doc", "left_anti")
        known = touched.join(late, "doc", "left_anti").select(old.columns)
        new = _folded(again, None).unionByName(_folded(on, known))
        rest = old.join(first.select("doc"), "doc", "left_anti")
        state = self._write(rest.unionByName(new), "state", batch, _STATE)

        given = self._read("issued", _ISSUED, before)
        births = state.where("born").join(given.select("doc"), "doc", "left_anti").withColumn("prefix", F.expr(self.prefix).cast("string"))
        counters = given.groupBy("prefix").agg((F.max("ordinal") + 1).alias("next_"))
        w = Window.partitionBy("prefix").orderBy("first_ts", "first_id", "doc")
        ids = births.withColumn("n_", F.row_number().over(w).cast("bigint") - 1).join(counters, "prefix", "left")
        self._write(ids.select("doc", "prefix", (F.col("n_") + F.coalesce("next_", F.lit(0))).alias("ordinal")), "issued", batch, _ISSUED)
        self.spark.createDataFrame([(batch,)], "batch bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{batch}")
        for b in before[:-2]:
            self._drop(f"{self.root}/state/{b}")  # readers of the last two batches are not disturbed

    def sink(self) -> Callable[[DataFrame, int], None]:
        return lambda events, batch: self.merge(events, batch) if not events.isEmpty() else None

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes in all that the stream has and ends; called again it goes on where it was."""
        stream.writeStream.foreachBatch(self.sink()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _folded(log: DataFrame, known: DataFrame | None) -> DataFrame:
    """State after the log, on from `known`. What was known enters as a birth, and a death if it was dead,
    before all else; these rows are not counted."""
    start = "timestamp_ntz '0001-01-01'"
    rows = log.withColumn("carried", F.lit(False))
    if known is not None:
        born = known.where("born").select("doc", F.expr(start).alias("ts"), F.lit(0).cast("bigint").alias("event_id"), F.lit("create").alias("op"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("carried"))
        dead = known.where("born AND NOT live").select("doc", F.expr(start).alias("ts"), F.lit(1).cast("bigint").alias("event_id"), F.lit("tombstone").alias("op"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("carried"))
        rows = rows.unionByName(born).unionByName(dead)
    a = REG.annotate(rows)
    did = lambda *ops: F.col("applied") & ~F.col("carried") & F.col("op").isin(*ops)
    turned = F.col("applied") & F.col("op").isin("create", "tombstone")
    g = a.groupBy("doc").agg(
        F.coalesce(F.max_by(F.col("op") == "create", F.when(turned, F.col("n"))), F.lit(False)).alias("live"), F.coalesce(F.bool_or(F.col("applied") & (F.col("op") == "create")), F.lit(False)).alias("born"),
        F.count_if(did("create")).alias("creates"), F.count_if(did("update")).alias("updates"), F.count_if(did("patch")).alias("patches"), F.count_if(did("create", "update", "tombstone")).alias("epoch"),
        F.max_by(F.when(did("patch"), F.col("value")), F.when(did("patch"), F.col("n"))).alias("last_patch"),
        F.max(F.when(~F.col("carried"), F.struct("ts", "event_id"))).alias("last"), F.min(F.when(did("create"), F.struct("ts", "event_id"))).alias("first"),
    )
    if known is None:
        return g.select("doc", "born", "live", "creates", "updates", "patches", "epoch", "last_patch", F.col("last.ts").alias("last_ts"), F.col("last.event_id").alias("last_id"), F.col("first.ts").alias("first_ts"), F.col("first.event_id").alias("first_id"))
    k = known.select("doc", *[F.col(c).alias(f"{c}_") for c in ("creates", "updates", "patches", "epoch", "last_patch", "first_ts", "first_id")])
    both = g.join(k, "doc", "left")
    total = lambda c: (F.col(c) + F.coalesce(f"{c}_", F.lit(0))).alias(c)
    return both.select(
        "doc", "born", "live", total("creates"), total("updates"), total("patches"), total("epoch"), F.coalesce("last_patch", "last_patch_").alias("last_patch"),
        F.col("last.ts").alias("last_ts"), F.col("last.event_id").alias("last_id"), F.coalesce("first_ts_", "first.ts").alias("first_ts"), F.coalesce("first_id_", "first.event_id").alias("first_id"),
    )

"""Moving a registry to identifiers of a new schema, in stages that can be stopped and run again.

The stages are plan, prepopulate and cutover, in this order. Each writes its tables under the
migration's folder and, last of all, a mark; a stage that has its mark does nothing more, one
without it starts over from what the stage before left. Nothing is changed in place: the registry
is the tables of the last stage that ended. Gates stand between: a plan whose figures are beyond
the limits stops the rest, and the cutover needs two different people.

Defined results: tombstones get no new identifier and keep their old one; documents without a usable
vector are left out of the plan and counted; ordinals go by document, so a plan made twice is
the same; an empty registry has a plan of no rows whose gates hold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import documents as G
from tessera.operators import fit as X
from tessera.operators import quantize as Q

STAGES = ["plan", "prepopulate", "cutover"]
TABLES = ["docs", "aliases", "history", "counters"]
# The limits of a plan's gates, the people a cutover needs, how many ordinals a byte holds.
ESCAPE_LIMIT, BALANCE_LIMIT, APPROVERS, ORDINALS = 0.005, 3.0, 2, 255


class Refused(RuntimeError):
    """A gate does not let a stage run."""


class Migration:
    def __init__(self, spark: SparkSession, root: str, schema: str, at: str, escape_limit: float = ESCAPE_LIMIT, balance_limit: float = BALANCE_LIMIT):
        self.spark, self.root, self.schema, self.at = spark, root.rstrip("/"), schema, at
        self.escape_limit, self.balance_limit = escape_limit, balance_limit

    # -------------------------------------------------- folders

    def _path(self, *parts: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def done(self, stage: str) -> bool:
        path = self._path(stage, "done", "_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _save(self, stage: str, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{stage}/{name}")

    def _end(self, stage: str, actors: list[str]) -> None:
        """The audit row is the mark."""
        row = [(",".join(sorted(set(actors))), f"schema_migration:{stage}", self.schema, self.at)]
        self.spark.createDataFrame(row, "actor string, op string, schema string, at string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{stage}/done")

    def read(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{stage}/{name}")

    def tables(self, registry: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """The registry after the last stage that ended; before any, what was given."""
        for stage in ("cutover", "prepopulate"):
            if self.done(stage):
                return {name: self.read(stage, name) for name in TABLES}
        return dict(registry or {})

    def audit(self) -> DataFrame:
        out = None
        for stage in STAGES:
            if self.done(stage):
                row = self.read(stage, "done")
                out = row if out is None else out.unionByName(row)
        return out if out is not None else self.spark.createDataFrame([], "actor string, op string, schema string, at string")

    # -------------------------------------------------- stages

    def plan(self, docs: DataFrame, vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
        """Every living document's new identifier, the counters behind them, and one row of figures and gates."""
        if not self.done("plan"):
            living = docs.where("state <> 'TOMBSTONED'").select("doc", F.col("sid").alias("old_sid"))
            codes = Q.encode(X.usable(vectors.join(living.select("doc"), "doc", "left_semi")), books)
            self._save("plan", {"codes": codes})
            issued = Q.allocate(self.read("plan", "codes"))
            prefix = F.array_join("codes", ".")
            mapping = issued.join(living, "doc").select("doc", "old_sid", F.col("sid").alias("new_sid"), prefix.alias("prefix"), F.col("c1").alias("first"), "ordinal", "err")
            self._save("plan", {"mapping": mapping})
            mapping = self.read("plan", "mapping")
            self._save("plan", {"counters": mapping.groupBy("prefix").agg((F.max("ordinal") + 1).alias("next_ordinal")), "report": self._figures(mapping, living, len(books[0]) if books else 1)})
            self._end("plan", ["pipeline"])
        return self.read("plan", "report")

    def _figures(self, mapping: DataFrame, living: DataFrame, k: int) -> DataFrame:
        moved = F.split_part("old_sid", F.lit("."), F.lit(1)) != F.col("first").cast("string")
        own = mapping.groupBy("first").agg(F.count("*").alias("n"), F.count_if(F.col("ordinal") >= ORDINALS).alias("escaped"), F.count_if(moved).alias("moved"), F.sum("err").alias("err"))  # a row for each first code
        r = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.sum("escaped").alias("escaped"), F.sum("moved").alias("moved"), F.max("n").alias("most"), F.sum("err").alias("err"))
        n = F.greatest(F.col("documents"), F.lit(1))
        r = r.select(
            "documents", F.round(F.coalesce(F.col("escaped") / n, F.lit(0.0)), 6).alias("escape_rate"), F.round(F.coalesce(F.col("moved") / n, F.lit(0.0)), 6).alias("moved_share"),
            F.round(F.coalesce(F.col("most") * k / n, F.lit(0.0)), 6).alias("l1_max_mean"), F.round(F.coalesce(F.col("err") / n, F.lit(0.0)), 6).alias("error"),
        )
        without = living.join(mapping.select("doc"), "doc", "left_anti").agg(F.count("*").alias("without_vector"))
        r = r.crossJoin(F.broadcast(without))  # one row each
        return r.withColumn("escape_ok", F.col("escape_rate") < self.escape_limit).withColumn("balance_ok", F.col("l1_max_mean") <= self.balance_limit)

    def _gate(self, stage: str) -> None:
        before = STAGES[STAGES.index(stage) - 1]
        if not self.done(before):
            raise Refused(f"{stage} comes after {before}")
        figures = self.read("plan", "report").first().asDict()
        failed = [g for g in ("escape_ok", "balance_ok") if not figures[g]]
        if failed:
            raise Refused(f"the plan's gates fail: {', '.join(failed)}")

    def _mapping(self) -> DataFrame:
        return self.read("plan", "mapping").select("doc", "new_sid")

    def prepopulate(self, registry: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The new identifiers resolve as aliases for a year; nothing else changes."""
        self._gate("prepopulate")
        if not self.done("prepopulate"):
            aliases = G.prepopulate(registry["aliases"], self._mapping(), self.schema, self.at)
            self._save("prepopulate", {**{n: registry[n] for n in TABLES}, "aliases": aliases})
            self._end("prepopulate", ["pipeline"])
        return self.tables()

    def cutover(self, approved_by: list[str]) -> dict[str, DataFrame]:
        """Documents take their new identifiers, old ones become aliases for a month."""
        self._gate("cutover")
        if len(set(approved_by)) < APPROVERS:
            raise Refused("a cutover needs two different people")
        if not self.done("cutover"):
            t = {name: self.read("prepopulate", name) for name in TABLES}
            self._save("cutover", G.cutover(t["docs"], t["aliases"], t["history"], t["counters"], self._mapping(), self.read("plan", "counters"), self.schema, self.at))
            self._end("cutover", approved_by)
        return self.tables()

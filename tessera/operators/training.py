"""Training rows: balancing, mixing, splits, replay and negatives by prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_hash(*cols: Column | str) -> Column:
    """60 bits of a hash as a number in [0, 1)."""
    h = F.sha2(F.concat_ws(":", *cols), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long") / F.lit(float(1 << 60))


def held_out(key: Column, fraction: float = 0.05, seed: int = 20260901) -> Column:
    return unit_hash(F.lit(str(seed)), key.cast("string")) < fraction


def balance_units(rows: DataFrame, cap: int = 20, log_source: str = "real_query", log_weight: float = 3.0, no_log_factor: float = 1.5) -> DataFrame:
    """At most `cap` rows a document, log rows first, the rest by hash; log rows weigh more,
    and so do all rows of documents without any."""
    is_log = F.col("source") == log_source
    w = Window.partitionBy("doc_id").orderBy(F.desc(is_log.cast("int")), F.sha2(F.concat_ws(":", "doc_id", "row_id"), 256))
    rows = rows.withColumn("has_log", F.max(is_log.cast("int")).over(Window.partitionBy("doc_id"))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)
    weight = F.col("weight") * F.when(is_log, log_weight).otherwise(1.0) * F.when(F.col("has_log") == 0, no_log_factor).otherwise(1.0)
    return rows.withColumn("weight", weight).drop("has_log", "rn")


def family_shares(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("source").agg(F.sum("weight").alias("w"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("w").alias("t")))).select("source", F.round(F.col("w") / F.col("t"), 6).alias("share"))  # one row


def mix(rows: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Weights scaled so that each family has its share; absent families are left out of the sum."""
    per = rows.groupBy("source").agg(F.sum("weight").alias("w"))
    spark = rows.sparkSession
    want = spark.createDataFrame(list(ratios.items()), "source string, ratio double")
    per = per.join(F.broadcast(want), "source", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))  # one row per family
    total = per.agg(F.sum("w").alias("t"), F.sum("ratio").alias("r"))
    factor = per.crossJoin(F.broadcast(total)).select("source", (F.col("ratio") / F.col("r") * F.col("t") / F.col("w")).alias("factor"))  # one row
    return rows.join(F.broadcast(factor), "source").withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def stratified_replay(old: DataFrame, n_new: int, ratio: float = 3.0) -> DataFrame:
    """min(ratio * n_new, all) rows, dealt to the strata in turn; the taker of a stratum's k-th
    row is its k-th turn, so short strata pass theirs on. Only per-stratum counts of each
    turn decide; rows are never ordered globally."""
    w = Window.partitionBy("c1").orderBy(F.sha2(F.col("doc").cast("string"), 256))
    want = int(ratio * n_new)
    ranked = old.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= want)  # no stratum gives more
    turns = ranked.groupBy("turn").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = turns.select("turn", (F.lit(want) - before).alias("room")).where("room > 0")  # a row per turn, at most want
    in_turn = F.row_number().over(Window.partitionBy("turn").orderBy("c1"))
    return ranked.join(cut, "turn").withColumn("place", in_turn).where("place <= room").drop("room", "place")


def siblings(issued: DataFrame, per_level: int = 2) -> DataFrame:
    """For each document and level: up to `per_level` others that share the codes before that
    level and differ there, by hash. Each group is first cut to the few candidates of each
    code, so no group is joined with itself in full."""
    out = None
    for level in range(4):
        shared = [f"c{i + 1}" for i in range(level)]
        own = f"c{level + 1}"
        h = F.sha2(F.col("doc").cast("string"), 256)
        pool = issued.select(*shared, own, "doc", h.alias("h"))
        few = pool.withColumn("k", F.row_number().over(Window.partitionBy(*shared, own).orderBy("h"))).where(F.col("k") <= per_level).drop("k")
        by_prefix = Window.partitionBy(*shared).orderBy("h") if shared else None
        # the first candidates over all codes, enough that per_level stay once one code is left out
        ranked = few.withColumn("k", F.row_number().over(by_prefix if by_prefix is not None else Window.orderBy("h"))).where(F.col("k") <= 2 * per_level * 128)
        cand = ranked.select(*shared, F.col(own).alias("other"), F.col("doc").alias("sibling"), "h")
        base = issued.select("doc", *shared, own)
        pairs = (base.join(cand, shared) if shared else base.crossJoin(F.broadcast(cand))).where(F.col(own) != F.col("other"))  # at most 256 rows without a prefix
        best = Window.partitionBy("doc").orderBy("h")
        got = pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= per_level).select("doc", F.lit(level).alias("level"), "sibling")
        out = got if out is None else out.union(got)
    return out

"""Mixing sources to target weights by Sainte-Lague apportionment.

Word counts per source give the targets. A source's words make up blocks of about
``BLOCK`` words, and its votes are its target in such blocks: highest quotients
votes / (2 s + 1) give each source its integer quota. Sources are split into shards (at
most ``MAX_SHARDS`` each, documents by seeded hash), so a hot one is no single task; the
source's blocks, then its quota, go to its shards by highest quotients of their words. A
shard's documents lie end to end in seeded order, cut into equal blocks (sizes differ by
a word at most). A quota of q out of n blocks takes each block q div n times and q mod n
seeded blocks once more, at most three times in all.

Up to ``MAX_SOURCES`` sources are apportioned on the driver, more by aggregates over them.

Defined results: a null text has no words; a null source is one source and comes
last; an empty text takes nothing; rows that share a doc_id are separate documents,
and the order of equal rows is that of all their columns used here; an empty table
gives no row. Reruns agree: nothing depends on partitions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, n_words

BLOCK = 256
SHARD_WORDS = 20_000
MAX_SHARDS = 65_536
MAX_SOURCES = 10_000
#: Most often that a document may be taken.
REPEATS = 3
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Words by weight of all words; none above `repeats` times its size, the excess shared again."""
    total = float(sum(sizes))
    out = [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes)) if sizes[k] > 0 and weights[k] > 0]
    left = total
    while open_:
        whole = math.fsum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > repeats * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = float(repeats * sizes[k])
        left -= math.fsum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), at most `most` each; ties go to the first.

    A divisor that hands out nearly all seats is found by bisection, the rest go one by one."""
    v, top = np.array(votes, float), np.array(most, np.int64)
    seats = int(min(seats, top[v > 0].sum()))
    if seats <= 0 or not len(v):
        return [0] * len(votes)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(v / divisor + 0.5), top).astype(np.int64)

    low, high = 1e-12, 2 * float(v.max()) + 1  # at `high` none has a seat
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while (rest := seats - int(out.sum())) > 0:
        quotient = np.where(out < top, v / (2 * out + 1), -1.0)
        best = np.argsort(-quotient, kind="stable")[:1 if rest < len(v) else rest]
        out[best[: rest]] += quotient[best[: rest]] > 0
    return out.tolist()


def _stride(n: int, seed: int) -> int:
    """A factor without common divisor with n, for the seeded choice of blocks."""
    a = (0x9E3779B1 * (seed + 1)) % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a


def _ordered_hash(seed: int, *cols: str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _div(a: Column, b: Column) -> Column:
    return ((a - F.pmod(a, b)) / b).cast("long")


_SOURCE = "source_ string, no long, shards int, source_size long, target double, blocks long, quota long"


def _blocks(n: int) -> int:
    return max(1, (2 * n + BLOCK) // (2 * BLOCK)) if n > 0 else 0


def quotas(sizes: list[int], wish: list[float], repeats: int = REPEATS) -> list[int]:
    """Blocks of each source by highest quotients of its target in blocks of its own."""
    blocks = [_blocks(n) for n in sizes]
    votes = [w * b / n if n else 0.0 for n, w, b in zip(sizes, wish, blocks, strict=True)]
    return sainte_lague(votes, math.floor(math.fsum(votes) + 0.5), [repeats * b for b in blocks])


def _few_sources(found: list, weights: tuple[float, ...], spark: SparkSession) -> DataFrame:
    found = sorted(found, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["n"] for r in found]
    wish = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))])
    got = quotas(sizes, wish)
    rows = [(r["source"], k, min(MAX_SHARDS, max(1, -(-n // SHARD_WORDS))), n, wish[k], _blocks(n), got[k]) for k, (r, n) in enumerate(zip(found, sizes, strict=True))]
    return F.broadcast(spark.createDataFrame(rows, _SOURCE))  # at most MAX_SOURCES rows


def _many_sources(sizes: DataFrame, weights: tuple[float, ...], scratch: Scratch) -> DataFrame:
    """What ``targets`` and ``quotas`` give, for any number of sources: the level left / whole and
    the divisor are settled by aggregates over the sources, of which the driver sees a few numbers."""
    spark = sizes.sparkSession
    in_order = sizes.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1], x[0][1]))
    ranked = scratch.write(spark.createDataFrame(in_order, "source_ string, no long, source_size long"), "ranked")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("no") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", weight)
    total = ranked.agg(F.sum("source_size")).first()[0]
    left, whole = 0.0, 1.0
    while True:
        full = F.lit(left) * F.col("w") / F.lit(whole) > REPEATS * F.col("source_size")
        seen = ranked.where("source_size > 0 AND w > 0").groupBy("w", full.alias("full")).agg(F.count("*").alias("m"), F.sum("source_size").alias("n")).collect()
        now = (float(total - REPEATS * sum(r["n"] for r in seen if r["full"])), math.fsum(r["w"] * r["m"] for r in seen if not r["full"]))
        if now == (left, whole) or not now[1]:
            break
        left, whole = now
    capped = F.least(F.lit(left) * F.col("w") / F.lit(whole), (REPEATS * F.col("source_size")).cast("double"))
    target = F.when((F.col("source_size") > 0) & (F.col("w") > 0), capped).otherwise(0.0)
    shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
    blocks = F.when(F.col("source_size") > 0, F.greatest(F.lit(1), F.expr(f"(2 * source_size + {BLOCK}) div {2 * BLOCK}"))).otherwise(0).cast("long")
    ranked = ranked.select("source_", "no", shards.alias("shards"), "source_size", target.alias("target"), blocks.alias("blocks"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    ranked = scratch.write(ranked.withColumn("votes", votes), "voted")
    given = lambda d: F.least(F.floor(F.col("votes") / d + 0.5), REPEATS * F.col("blocks")).cast("long")
    sums = ranked.agg(F.sum("votes").alias("v"), F.max("votes").alias("top"), F.sum(F.when(F.col("votes") > 0, REPEATS * F.col("blocks"))).alias("most")).first()
    seats = min(math.floor((sums["v"] or 0.0) + 0.5), sums["most"] or 0)
    low, high = 1e-12, 2 * (sums["top"] or 0.0) + 1  # at `high` none has a seat
    for _ in range(8):
        cuts = [low + (high - low) * k / 32 for k in range(1, 32)]
        many = ranked.agg(*(F.sum(given(F.lit(d))).alias(f"d{k}") for k, d in enumerate(cuts))).first()
        over = [k for k, d in enumerate(cuts) if (many[k] or 0) > seats]
        low, high = cuts[max(over)] if over else low, cuts[max(over) + 1] if over and max(over) + 1 < len(cuts) else cuts[0] if not over else high
    ranked = ranked.withColumn("quota", given(F.lit(high)))
    rest = seats - (ranked.agg(F.sum("quota")).first()[0] or 0)
    while rest > 0:  # ties at the divisor
        quotient = F.col("votes") / (2 * F.col("quota") + 1)
        room = ranked.where((F.col("quota") < REPEATS * F.col("blocks")) & (F.col("votes") > 0))
        best = scratch.write(room.orderBy(quotient.desc(), "no").limit(rest).select("no", F.lit(1).alias("one")), f"best{rest}")
        got = best.count()
        if not got:
            break
        ranked = ranked.join(best, "no", "left").withColumn("quota", F.col("quota") + F.coalesce("one", F.lit(0))).drop("one")
        rest -= got
    return scratch.write(ranked.select(*(c.split()[0] for c in _SOURCE.split(", "))), "per_source")


_PLAN = "no long, shard int, words long, blocks long, each long, more long, stride long, shift long"


def _deal(no: int, cells: list[tuple[int, int]], source_blocks: int, quota: int, seed: int) -> list[tuple]:
    """Rows of the plan of one source from its shards and their words: its blocks, then its quota
    of blocks, go to its shards by highest quotients; each shard has a block at least."""
    cells = [(shard, n) for shard, n in sorted(cells) if n > 0]
    if not cells:
        return []
    words = [float(n) for _, n in cells]
    more = sainte_lague(words, max(0, source_blocks - len(cells)), [n - 1 for _, n in cells])
    blocks = [1 + k for k in more]
    seats = quota if sum(blocks) == source_blocks else round(quota * sum(blocks) / source_blocks)
    dealt = sainte_lague(words, seats, [REPEATS * b for b in blocks])
    return [(no, shard, n, b, q // b, q % b, _stride(b, seed + shard), (seed * 7919 + shard * 31) % b) for (shard, n), b, q in zip(cells, blocks, dealt, strict=True)]


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[float, ...] = WEIGHTS, seed: int = 0, keep_source: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and ``parts``, the stretches of
    words [start, end) of the text to take, each with its number of times. `carry` names
    further columns to keep, `keep_source` the source."""
    spark = docs.sparkSession
    carry = carry or []
    keep = [] if "source" in carry else ["source"] * keep_source
    scratch = Scratch(spark, "mixing")
    rows = docs.select("doc_id", "source", *carry, n_words(F.col("text")).alias("size_"))
    rows = scratch.write(rows, "rows")
    per_name = rows.groupBy("source").agg(F.sum("size_").alias("n"))
    found = per_name.limit(MAX_SOURCES + 1).collect()
    per_source = _few_sources(found, weights, spark) if len(found) <= MAX_SOURCES else _many_sources(per_name, weights, scratch)
    placed = rows.join(per_source, rows["source"].eqNullSafe(per_source["source_"])).drop("source_")
    placed = placed.withColumn("shard", F.pmod(_ordered_hash(seed, "doc_id"), F.col("shards")).cast("int"))
    cells = placed.groupBy("no", "shard").agg(F.sum("size_").alias("n"), F.first("blocks").alias("blocks"), F.first("quota").alias("quota"))
    placed = placed.drop("shards", "blocks", "quota")

    def dealt(key: tuple, x: pd.DataFrame) -> pd.DataFrame:  # one source's shards, at most MAX_SHARDS
        plan = _deal(int(key[0]), list(zip(x["shard"].tolist(), x["n"].tolist(), strict=True)), int(x["blocks"].iloc[0]), int(x["quota"].iloc[0]), seed)
        return pd.DataFrame(plan, columns=[c.split()[0] for c in _PLAN.split(", ")])

    shard_plan = scratch.write(cells.groupBy("no").applyInPandas(dealt, _PLAN), "plan")
    line = Window.partitionBy("no", "shard").orderBy(_ordered_hash(seed + 1, "doc_id"), "doc_id", "size_", *[c for c in carry if c != "source"])
    laid = placed.withColumn("end_", F.sum("size_").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(shard_plan, ["no", "shard"], "left")
    laid = laid.withColumn("begin_", F.col("end_") - F.col("size_"))

    first, last = F.expr("((begin_ + 1) * blocks - 1) div words"), F.expr("(end_ * blocks - 1) div words")

    def part(b: Column) -> Column:
        chosen = F.pmod(b * F.col("stride") + F.col("shift"), F.col("blocks")) < F.col("more")
        low, high = _div(b * F.col("words"), F.col("blocks")), _div((b + 1) * F.col("words"), F.col("blocks"))
        return F.struct(
            (F.greatest(low, F.col("begin_")) - F.col("begin_")).alias("start"),
            (F.least(high, F.col("end_")) - F.col("begin_")).alias("end"),
            (F.col("each") + chosen.cast("long")).alias("times"),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,times:bigint>>")
    parts = F.when((F.col("size_") > 0) & F.col("words").isNotNull(), F.filter(F.transform(F.sequence(first, last), part), lambda p: p["times"] > 0)).otherwise(none)
    out = laid.withColumn("parts", parts)
    taken = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + (p["end"] - p["start"]) * p["times"])
    return out.select("doc_id", *carry, *keep, F.col("size_").alias("size"), "source_size", "target", taken.alias("taken"), "parts")

"""Registry: folding a mutation log, resolving, verifying, shares over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.lineage import cut

# What each event does to a document.
OPERATIONS = {"signup": "create", "click": "patch", "view": "none", "purchase": "update", "error": "tombstone"}


def mutations(events: DataFrame) -> DataFrame:
    """(doc, seq_ts, seq_id, op) from events: the user is the document."""
    pairs = [F.lit(x) for kv in OPERATIONS.items() for x in kv]
    return events.select(F.col("user_id").alias("doc"), "ts", "event_id", F.create_map(*pairs)[F.col("event_type")].alias("op"), "value")


def annotate(log: DataFrame) -> DataFrame:
    """Each mutation with whether it takes effect: a create does only when the document is not
    live, the others only when it is (a tombstone also on a dead one that existed)."""
    w = Window.partitionBy("doc").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    n = F.row_number().over(Window.partitionBy("doc").orderBy("ts", "event_id"))
    rows = log.withColumn("n", n)
    born = F.max(F.when(F.col("op") == "create", F.col("n"))).over(w)
    died = F.max(F.when(F.col("op") == "tombstone", F.col("n"))).over(w)
    rows = rows.withColumn("born", born).withColumn("died", died)
    live = F.col("born").isNotNull() & (F.col("died").isNull() | (F.col("born") > F.col("died")))
    rows = rows.withColumn("live", live)
    return rows.withColumn("applied", F.when(F.col("op") == "create", ~F.col("live")).when(F.col("op") == "tombstone", F.col("born").isNotNull()).when(F.col("op") == "none", False).otherwise(F.col("live")))


def fold(log: DataFrame) -> DataFrame:
    """Final state of each document: state, epoch, counts and the last patch value."""
    a = annotate(log).where("applied")
    is_ = lambda op: F.col("op") == op
    g = a.groupBy("doc").agg(
        F.max(F.when(is_("create"), F.col("n"))).alias("born"),
        F.max(F.when(is_("tombstone"), F.col("n"))).alias("died"),
        F.count_if(is_("create")).alias("creates"),
        F.count_if(is_("update")).alias("updates"),
        F.count_if(is_("patch")).alias("patches"),
        F.count_if(F.col("op").isin("create", "update", "tombstone")).alias("epoch"),
        F.max_by(F.when(is_("patch"), F.col("value")), F.when(is_("patch"), F.col("n"))).alias("last_patch"),
    )
    state = F.when(F.col("died") > F.col("born"), "TOMBSTONED").when(F.col("updates") > 0, "ACTIVE_COLD_START").otherwise("ACTIVE_LEARNED")
    return g.select("doc", state.alias("state"), "creates", "updates", "patches", "epoch", F.round("last_patch", 6).alias("last_patch"))


def hot_ratio(registry: DataFrame) -> DataFrame:
    live = F.count_if(F.col("state").isin("ACTIVE_COLD_START", "ACTIVE_LEARNED", "LOW_COVERAGE"))
    return registry.agg(F.round(F.count_if(F.col("state") == "ACTIVE_COLD_START") / live, 6).alias("hot_ratio"), live.alias("live"))


def resolve(wanted: DataFrame, registry: DataFrame, aliases: DataFrame, as_of: str) -> DataFrame:
    """(sid) -> owner: the record that holds the identifier, else an alias not yet expired."""
    direct = wanted.join(registry.select("sid", F.col("doc").alias("direct")), "sid", "left")
    live = aliases.where(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz")).select("sid", F.col("doc").alias("by_alias"))
    r = direct.join(live, "sid", "left")
    return r.select("sid", F.coalesce("direct", "by_alias").alias("doc"), (F.col("direct").isNull() & F.col("by_alias").isNotNull()).alias("via_alias"))


def tier1(candidates: DataFrame, registry: DataFrame, tenant: str, roles: list[str], schema: int) -> DataFrame:
    """Each candidate with the first rule that drops it, or `kept`; a null state, tenant or schema drops it too."""
    r = candidates.join(registry, "doc", "left")
    held = F.array(*[F.lit(x) for x in roles]).cast("array<string>")
    roles_ = F.coalesce("roles", F.array().cast("array<string>"))
    acl = F.coalesce((F.col("tenant") == tenant) & ((F.size(roles_) == 0) | F.arrays_overlap(roles_, held)), F.lit(False))
    reason = (
        F.when(F.col("state").isNull(), "missing")
        .when(F.col("state") == "TOMBSTONED", "tombstoned")
        .when(~F.col("state").isin("ACTIVE_COLD_START", "ACTIVE_LEARNED", "LOW_COVERAGE"), "not_servable")
        .when(~acl, "acl")
        .when(~F.col("schema").eqNullSafe(F.lit(schema)), "schema")
        .otherwise("kept")
    )
    return r.withColumn("reason", reason)


def trailing_share(events: DataFrame, flag: str, hours: int = 24) -> DataFrame:
    """Share of flagged events over the trailing hours (the present instant included).

    An event counts from its instant on and no longer from just after the stretch, so what a window holds is a
    running sum of what comes and goes: over the instants of one stretch of time, from what all stretches before
    left. No event is read again for each window it lies in. Events without a time have no row."""
    step = hours * 3_600_000_000
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = cut(events.select("event_id", us.alias("us"), F.expr(flag).cast("long").alias("f")).where("us IS NOT NULL"))
    at = e.groupBy("us").agg(F.count("*").alias("n"), F.count("f").alias("known"), F.coalesce(F.sum("f"), F.lit(0)).alias("hits"))
    names = ["n", "known", "hits"]
    gone = at.select((F.col("us") + step + 1).alias("us"), *[(-F.col(c)).alias(c) for c in names])
    marks = at.unionByName(gone).groupBy("us").agg(*[F.sum(c).alias(c) for c in names]).withColumn("part", F.floor(F.col("us") / step))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch of time
    left = marks.groupBy("part").agg(*[F.sum(c).alias(c) for c in names]).select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_") for c in names])
    w = Window.partitionBy("part").orderBy("us").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.join(left, "part").select("us", *[(F.sum(c).over(w) + F.col(f"{c}_")).alias(c) for c in names])
    out = e.select("event_id", "us").join(held, "us")
    return out.select("event_id", F.round(F.col("hits") / F.nullif(F.col("known"), F.lit(0)), 6).alias("share"), "n")

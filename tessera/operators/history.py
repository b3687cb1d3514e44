"""Identifiers over time: who held an identifier at an instant, and what a document's update does to its units.

Defined results: an interval holds from valid_from (inclusive) to valid_to (exclusive); a null valid_to
is open, a null valid_from holds from the start; of several that hold, the latest valid_from
counts, then the greatest document; what nobody held has a null document; repeated questions are
answered once each; a null identifier or instant is held by nobody; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import fit as X

#: Days are numbered in LEVELS bits: until 2149. Others count as the first or the last day.
LEVELS = 16
_LAST = (1 << LEVELS) - 1


def _day(at: Column) -> Column:
    day = F.floor(F.unix_micros(at.cast("timestamp")) / 86_400_000_000).cast("long")
    return F.when(day.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(_LAST), day)))  # both pass nulls by


def _spans(lo: Column, hi: Column) -> Column:
    """The fewest aligned stretches (level, number) that make up the days lo to hi: two a level at most."""
    start = F.struct(lo.alias("lo"), hi.alias("hi"), F.array().cast("array<struct<level:int,n:bigint>>").alias("out"))

    def up(acc: Column, level: Column) -> Column:
        left = (acc["lo"] <= acc["hi"]) & (acc["lo"] % 2 == 1)
        lo_ = acc["lo"] + F.when(left, 1).otherwise(0)
        right = (lo_ <= acc["hi"]) & (acc["hi"] % 2 == 0)
        own = lambda n: F.struct(level.cast("int").alias("level"), n.cast("bigint").alias("n"))
        more = F.filter(F.array(F.when(left, own(acc["lo"])), F.when(right, own(acc["hi"]))), lambda x: x.isNotNull())
        hi_ = acc["hi"] - F.when(right, 1).otherwise(0)
        ended = lo_ > hi_  # nothing is left: stays so on all higher levels
        return F.struct(F.when(ended, 1).otherwise(F.shiftright(lo_, 1)).alias("lo"), F.when(ended, 0).otherwise(F.shiftright(hi_, 1)).alias("hi"), F.concat(acc["out"], more).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, up)["out"]


def held_at(wanted: DataFrame, history: DataFrame) -> DataFrame:
    """wanted (sid, at), history (sid, doc, valid_from, valid_to) -> (sid, at, doc, valid_from).

    An equality join: an interval stands at the few aligned stretches of whole days that make it up, an
    instant asks at the one stretch of each level that it lies in, and the two meet on (identifier,
    level, number). Of all intervals that hold throughout a stretch only the one that counts goes on, so
    rows are bounded by stretches, however many intervals overlap. Days that an interval holds in part
    meet the instants of that day one by one; of intervals with the same ends one goes on."""
    asked = wanted.select("sid", "at").distinct()
    since, until = _day(F.col("valid_from")), _day(F.col("valid_to"))
    midnight = lambda c: F.col(c).isNull() | (F.pmod(F.unix_micros(F.col(c).cast("timestamp")), F.lit(86_400_000_000)) == 0)
    inside = lambda c: F.col(c).isNull() | F.unix_micros(F.col(c).cast("timestamp")).between(86_400_000_000, _LAST * 86_400_000_000 - 1)  # noqa: E731  (days that are numbered)
    own = history.where("sid IS NOT NULL").groupBy("sid", "valid_from", "valid_to").agg(F.max("doc").alias("doc"))
    own = own.withColumns({
        "lo": F.coalesce(since, F.lit(0)), "hi": F.coalesce(until, F.lit(_LAST)), "from_whole": midnight("valid_from") & inside("valid_from"), "to_whole": midnight("valid_to") & inside("valid_to"),
    })
    first = F.when(F.col("valid_from").isNull() | F.col("from_whole"), F.col("lo")).otherwise(F.col("lo") + 1)
    last = F.when(F.col("valid_to").isNull(), F.col("hi")).otherwise(F.col("hi") - 1)
    rank = F.struct(F.col("valid_from").isNotNull().alias("k"), "valid_from", "doc")
    whole = own.withColumns({"first": first, "last": last}).where("first <= last").select("sid", rank.alias("b"), F.explode(_spans(F.col("first"), F.col("last"))).alias("s"))
    whole = whole.groupBy("sid", "s.level", "s.n").agg(F.max("b").alias("b"))
    days = F.array_distinct(F.filter(F.array(F.when(~F.col("from_whole"), F.col("lo")), F.when(F.col("valid_to").isNotNull() & ~F.col("to_whole"), F.col("hi"))), lambda x: x.isNotNull()))
    part = own.select("sid", rank.alias("b"), "valid_from", "valid_to", F.explode(days).alias("day"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    there = asked.where("sid IS NOT NULL AND at IS NOT NULL")
    met = there.select("sid", "at", levels).withColumn("n", _shifted(F.col("at"))).join(whole, ["sid", "level", "n"]).select("sid", "at", "b")
    some = there.withColumn("day", _day(F.col("at"))).join(part, ["sid", "day"]).where("(valid_from IS NULL OR valid_from <= at) AND (valid_to IS NULL OR at < valid_to)").select("sid", "at", "b")
    best = met.union(some).groupBy("sid", "at").agg(F.max("b").alias("b"))
    return asked.join(best, ["sid", "at"], "left").select("sid", "at", F.col("b.doc").alias("doc"), F.col("b.valid_from").alias("valid_from"))


def _shifted(at: Column) -> Column:
    return F.floor(_day(at) / F.pow(F.lit(2), F.col("level"))).cast("bigint")


def resolve(wanted: DataFrame, docs: DataFrame, aliases: DataFrame, history: DataFrame) -> DataFrame:
    """(sid, at) -> (sid, at, doc, via): the document that has the identifier now (living ones before
    tombstones), else an alias that has not expired at the instant, else who held it then."""
    dead = (F.col("state") == "TOMBSTONED").cast("int")
    now = docs.groupBy("sid").agg(F.min_by("doc", F.struct(F.coalesce(dead, F.lit(1)), "doc")).alias("now_"))
    alias = aliases.groupBy("sid").agg(F.max_by(F.col("doc"), F.struct("expires_at", "doc")).alias("alias_"), F.max("expires_at").alias("expires_"))
    r = held_at(wanted, history).join(now, "sid", "left").join(alias, "sid", "left")
    by_alias = F.when(F.col("expires_") > F.col("at"), F.col("alias_"))
    via = F.when(F.col("now_").isNotNull(), "registry").when(by_alias.isNotNull(), "alias").when(F.col("doc").isNotNull(), "history")
    return r.select("sid", "at", F.coalesce("now_", by_alias, "doc").alias("doc"), via.alias("via"))


# ------------------------------------------------------------ units of an updated document


def unit_changes(old: DataFrame, new: DataFrame, books: list[np.ndarray], margin: float = 0.05, max_alias_depth: int = 2) -> DataFrame:
    """What replacing documents' contents does to their units.

    old (parent, doc, chunk, state, hash, c1.., alias_depth) are the units there are, new (parent, pos, hash,
    vec, n1..) those of the new contents of each parent. Units meet by position among the living
    ones, in one full outer join. Result (parent, pos, doc, action, reason, reidentify, c1..):
    `kept` for equal hashes, `changed` with the reason why its codes move or stay, `new`, and
    `dropped` for those beyond the new end. Parents without living units are `unknown` and none
    of their units is made; parents that are not in `new` are left alone.

    Defined results: null hashes differ from everything; a changed unit without a usable vector keeps
    its codes (no_vector); units are ordered by chunk, then by doc."""
    codes = [f"c{i}" for i in range(1, len(books) + 1)]
    news = [f"n{i}" for i in range(1, len(books) + 1)]
    place = F.row_number().over(Window.partitionBy("parent").orderBy("chunk", "doc")).cast("long") - 1
    touched = new.select("parent").distinct()
    living = old.where("state <> 'TOMBSTONED'").join(touched, "parent", "left_semi").withColumn("pos", place)
    a = living.select("parent", "pos", "doc", F.col("hash").alias("was"), "alias_depth", *codes)
    b = new.select("parent", F.col("pos").cast("long").alias("pos"), "hash", "vec", *news, F.lit(True).alias("made"))
    known = living.select("parent", F.lit(True).alias("known")).distinct()
    both = a.join(b, ["parent", "pos"], "full_outer").join(known, "parent", "left")
    action = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("doc").isNull(), "new").when(F.col("made").isNull(), "dropped")
        .when(F.coalesce(F.col("was") == F.col("hash"), F.lit(False)), "kept").otherwise("changed")
    )
    rows = both.withColumn("action", action)
    moved = X.moves(rows.where("action = 'changed'").select("doc", "vec", "alias_depth", *codes, *news), books, margin, max_alias_depth)
    out = rows.join(moved, "doc", "left")
    reason = F.when(F.col("action") == "changed", F.coalesce("reason", F.lit("no_vector")))
    again = F.coalesce("reidentify", F.lit(False))
    take = again | (F.col("action") == "new")
    return out.select("parent", "pos", "doc", "action", reason.alias("reason"), again.alias("reidentify"), *[F.when(take, F.col(n)).otherwise(F.col(c)).alias(c) for c, n in zip(codes, news, strict=True)])

"""The registry's documents as a table: changes, look-ups, aliases, schema moves, shares.

A document row has doc, tenant, sid, schema, state, hash, uri, title, snippet, roles, metadata
(map), parent, epoch, deleted_at. Every change gives the whole table anew.

Defined results: a null state is not servable; null roles are no roles; ids that are not
in the table change nothing; several changes of one document in one call are an error of the
caller; empty tables give empty tables; further columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# States that are served, days an old identifier stays an alias, days in the hot set, shares of it.
SERVABLE = ["ACTIVE_COLD_START", "ACTIVE_LEARNED", "LOW_COVERAGE"]
ALIAS_DAYS, MIGRATION_DAYS, HOT_DAYS = 30, 365, 7
HOT_ALARM, HOT_BLOCK, HOT_LEAST = 0.05, 0.10, 100
CHANNELS = ["generative", "hot_lexical", "full_lexical"]

_EMPTY = "map<string,string>"


def records(docs: DataFrame, states: list[str] | None = None, schema: str | None = None) -> DataFrame:
    out = docs if states is None else docs.where(F.col("state").isin(states))
    return out if schema is None else out.where(F.col("schema") == schema)


def get(docs: DataFrame, doc) -> DataFrame:
    return docs.where(F.col("doc") == F.lit(doc))


def children(docs: DataFrame, parent) -> DataFrame:
    """A parent's units in the order of their chunk numbers."""
    return docs.where(F.col("parent") == F.lit(parent)).orderBy(F.col("metadata")["chunk"].cast("long"), "doc")


def snapshot_ids(docs: DataFrame, schema: str | None = None) -> DataFrame:
    """Identifiers that a trie is built of."""
    return records(docs, SERVABLE, schema).select("sid")


def issued_ids(history: DataFrame, schema: str | None = None) -> DataFrame:
    """Every identifier ever given out."""
    return (history if schema is None else history.where(F.col("schema") == schema)).select("sid").distinct()


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc", F.lit(True).alias("hit_")).distinct(), "doc", "left").withColumn("hit_", F.coalesce("hit_", F.lit(False)))


def _changed(rows: DataFrame, **new: Column) -> DataFrame:
    cols = {c: F.when(F.col("hit_"), v).otherwise(F.col(c)) for c, v in new.items()}
    return rows.withColumns(cols).drop("hit_")


def _next_epochs(rows: DataFrame) -> Column:
    """Epochs go on from the table's highest, in the order of the documents changed."""
    top = rows.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]
    return F.lit(top) + F.sum(F.col("hit_").cast("long")).over(Window.orderBy("doc").rowsBetween(Window.unboundedPreceding, 0))


def set_state(docs: DataFrame, ids: DataFrame, state: str) -> DataFrame:
    """Tombstones stay."""
    rows = _marked(docs, ids).withColumn("hit_", F.col("hit_") & (F.col("state") != "TOMBSTONED"))
    return _changed(rows, state=F.lit(state))


def tombstone(docs: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Also stamps anew what is one already; the epochs of those changed follow the table's."""
    rows = _marked(docs, ids)
    few = rows.where("hit_").select("doc", "hit_", "epoch")
    top = docs.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]
    epoch = few.withColumn("new_epoch", F.lit(top) + F.row_number().over(Window.orderBy("doc"))).select("doc", "new_epoch")  # the documents of one call
    rows = rows.join(epoch, "doc", "left")
    return _changed(rows, state=F.lit("TOMBSTONED"), deleted_at=F.lit(at).cast("timestamp_ntz"), epoch=F.col("new_epoch").cast("long")).drop("new_epoch")


def hard_delete(docs: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Tombstones without content: only the identifier stays, so that it is never given out again."""
    rows = _marked(tombstone(docs, ids, at), ids)
    none = F.lit(None).cast("string")
    return _changed(rows, uri=F.lit(""), title=none, snippet=none, metadata=F.create_map().cast(_EMPTY), roles=F.array().cast("array<string>"))


def patch(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (doc, title, metadata, roles): nulls change nothing, metadata is merged; no new epoch."""
    new = changes.select("doc", F.col("title").alias("title_"), F.col("metadata").alias("metadata_"), F.col("roles").alias("roles_"))
    rows = docs.join(new, "doc", "left")
    old, more = F.coalesce("metadata", F.create_map().cast(_EMPTY)), F.coalesce("metadata_", F.create_map().cast(_EMPTY))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(more), k))
    merged = F.when(F.col("metadata_").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, more))
    return rows.withColumns({"title": F.coalesce("title_", "title"), "metadata": merged, "roles": F.coalesce("roles_", "roles")}).drop("title_", "metadata_", "roles_")


def mark_learned(docs: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Learned, with the time in the metadata."""
    stamp = ids.select("doc").distinct().select("doc", F.lit(None).cast("string").alias("title"), F.create_map(F.lit("learned_at"), F.lit(at)).alias("metadata"), F.lit(None).cast("array<string>").alias("roles"))
    return patch(set_state(docs, ids, "ACTIVE_LEARNED"), stamp)


def sweep_hot(docs: DataFrame, hot: DataFrame, at: str, days: int = HOT_DAYS) -> DataFrame:
    """The hot index (sid, ...) without documents learned `days` ago or earlier."""
    since = F.try_to_timestamp(F.col("metadata")["learned_at"]).cast("timestamp_ntz")
    gone = docs.where((F.col("state") == "ACTIVE_LEARNED") & (since <= F.lit(at).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")))
    return hot.join(gone.select("sid"), "sid", "left_anti")


def hot_cap(docs: DataFrame) -> DataFrame:
    """(hot_ratio, live, status): blocked or alarmed by the share of documents not yet learned."""
    live = F.count_if(F.col("state").isin(SERVABLE))
    r = docs.agg(F.coalesce(F.count_if(F.col("state") == "ACTIVE_COLD_START") / F.nullif(live, F.lit(0)), F.lit(0.0)).alias("hot_ratio"), live.alias("live"))
    status = F.when((F.col("hot_ratio") >= HOT_BLOCK) & (F.col("live") >= HOT_LEAST), "block").when(F.col("hot_ratio") >= HOT_ALARM, "alarm").otherwise("ok")
    return r.select(F.round("hot_ratio", 6).alias("hot_ratio"), "live", status.alias("status"))


def audit(before: DataFrame, after: DataFrame, actor: str, op: str) -> DataFrame:
    """One row for each document that a change touched: what it was and what it is."""
    row = [c for c in before.columns if c != "doc"]
    a = before.select("doc", F.struct("sid", "state").alias("before"), F.xxhash64(F.to_json(F.struct(*row))).alias("x"))
    b = after.select("doc", F.struct("sid", "state").alias("after"), F.xxhash64(F.to_json(F.struct(*row))).alias("y"), F.col("epoch"))
    both = a.join(b, "doc", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
    return both.select(F.lit(actor).alias("actor"), F.lit(op).alias("op"), "doc", "before", "after", "epoch")


# ------------------------------------------------------------ identifiers of a new schema


def prepopulate(aliases: DataFrame, mapping: DataFrame, schema: str, at: str) -> DataFrame:
    """aliases (schema, sid, doc, reason, expires_at) with the new identifiers (doc, new_sid) staged."""
    ends = F.lit(at).cast("timestamp_ntz") + F.expr(f"INTERVAL {MIGRATION_DAYS} DAYS")
    new = mapping.select(F.lit(schema).alias("schema"), F.col("new_sid").alias("sid"), "doc", F.lit("SCHEMA_MIGRATION").alias("reason"), ends.alias("expires_at"))
    return aliases.join(new.select("schema", "sid"), ["schema", "sid"], "left_anti").select(new.columns).union(new)


def cutover(docs: DataFrame, aliases: DataFrame, history: DataFrame, counters: DataFrame, mapping: DataFrame, planned: DataFrame, schema: str, at: str) -> dict[str, DataFrame]:
    """Documents take their new identifiers; the old ones are aliases for a month, if none is there;
    staged aliases of the schema go; history (doc, sid, schema, valid_from, valid_to) closes
    and opens; counters (schema, prefix, next_ordinal) only rise."""
    now, cols = F.lit(at).cast("timestamp_ntz"), ["schema", "sid", "doc", "reason", "expires_at"]
    both = docs.join(mapping, "doc")
    old = both.where(F.col("schema") != schema).select("schema", "sid", "doc", F.lit("SCHEMA_MIGRATION").alias("reason"), (now + F.expr(f"INTERVAL {ALIAS_DAYS} DAYS")).alias("expires_at"))
    kept = aliases.where(~((F.col("schema") == schema) & (F.col("reason") == "SCHEMA_MIGRATION"))).select(cols)
    moved = docs.join(mapping, "doc", "left")
    moved = moved.withColumns({"sid": F.coalesce("new_sid", "sid"), "schema": F.when(F.col("new_sid").isNotNull(), schema).otherwise(F.col("schema"))}).drop("new_sid")
    closed = _marked(history, mapping).withColumn("valid_to", F.when(F.col("hit_") & F.col("valid_to").isNull(), now).otherwise(F.col("valid_to"))).drop("hit_")
    opened = mapping.select("doc", F.col("new_sid").alias("sid"), F.lit(schema).alias("schema"), now.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    raised = counters.unionByName(planned.withColumn("schema", F.lit(schema)).select(counters.columns)).groupBy("schema", "prefix").agg(F.max("next_ordinal").alias("next_ordinal"))
    return {"docs": moved, "aliases": kept.union(old.join(kept.select("schema", "sid"), ["schema", "sid"], "left_anti").select(cols)), "history": closed.select(history.columns).unionByName(opened.select(history.columns)), "counters": raised}


# ------------------------------------------------------------ filters of candidates


def without_tombstones(cands: DataFrame, docs: DataFrame) -> DataFrame:
    return cands.join(docs.where("state = 'TOMBSTONED'").select("doc"), "doc", "left_anti")


def bloom_shape(capacity: int, error: float = 1e-4) -> tuple[int, int]:
    """(bits, hashes) of a filter."""
    m = max(64, int(-capacity * math.log(error) / math.log(2) ** 2))
    m = (m + 7) // 8 * 8
    return m, max(1, round(m / capacity * math.log(2)))


def _places(key: Column, m: int, k: int) -> Column:
    text = key.cast("string")
    a, b = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.pmod(a, F.lit(m)) + i * F.pmod(b, F.lit(m - 1)) + i, F.lit(m)))


def bloom(keys: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """The bits that are set, as rows (place)."""
    return keys.where(F.col(column).isNotNull()).select(F.explode(_places(F.col(column), m, k)).alias("place")).distinct()


def maybe_in(rows: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """Distinct keys with `maybe`: false only for keys that never went in."""
    asked = rows.select(column).distinct().withColumn("place", F.explode(F.array_distinct(_places(F.col(column), m, k))))
    found = asked.join(bits.withColumn("on_", F.lit(1)), "place", "left")
    return found.groupBy(column).agg((F.count("on_") == F.count("*")).alias("maybe"))


def passes(metadata: Column, filters: dict[str, list[str]]) -> Column:
    """Every key has one of its allowed values; `metadata` maps keys to arrays of values."""
    ok = F.lit(True)
    for key, allowed in filters.items():
        values = F.coalesce(metadata[key.removeprefix("metadata.")], F.array().cast("array<string>"))
        ok = ok & F.arrays_overlap(values, F.array(*(F.lit(a) for a in allowed)).cast("array<string>"))
    return F.coalesce(ok, F.lit(False))


def merge_channels(kept: DataFrame) -> DataFrame:
    """(qid, doc, channel, gen, bm25, pos) -> one row a document: best scores, the generative channel if
    it found it, else the first one's, in first-seen order; `extra` rows fell together."""
    first = F.min_by("channel", "pos")
    return kept.groupBy("qid", "doc").agg(
        F.when(F.max((F.col("channel") == "generative").cast("int")) == 1, "generative").otherwise(first).alias("channel"),
        F.max("gen").alias("gen"), F.max("bm25").alias("bm25"), F.min("pos").alias("pos"), (F.count("*") - 1).alias("extra"),
    )


def preliminary(cands: DataFrame) -> DataFrame:
    """Rank before there is a common scale: by channel, then its own score (none last), then sid."""
    order = F.array_position(F.array(*(F.lit(c) for c in CHANNELS)), F.col("channel"))
    own = F.when(F.col("channel") == "generative", F.col("gen")).otherwise(F.col("bm25"))
    w = Window.partitionBy("qid").orderBy(order, own.desc_nulls_last(), F.col("sid").cast("string"))
    return cands.withColumn("rank", F.row_number().over(w).cast("long"))


def collapse(ranked: DataFrame) -> DataFrame:
    """The best-ranked row of each near-duplicate group; documents without one are their own."""
    group = F.coalesce(F.concat(F.lit("g"), F.col("near_dup_group").cast("string")), F.concat(F.lit("d"), F.col("doc").cast("string")))
    w = Window.partitionBy("qid", "group_").orderBy("rank")
    return ranked.withColumn("group_", group).withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("group_", "n_")


def diagnose(wanted: DataFrame, docs: DataFrame, results: DataFrame, trie: DataFrame, pool: DataFrame, survivors: DataFrame, tenant: str, roles: list[str], least: float = 0.35) -> DataFrame:
    """(qid, doc) -> (reason, survived): the first reason that a wanted document was not returned.
    results (qid, doc), trie (sid), pool (qid, doc, ce), survivors (qid, level, prefix)."""
    held = F.array(*[F.lit(x) for x in roles]).cast("array<string>")
    r = wanted.join(docs.select("doc", "sid", "state", "tenant", "roles"), "doc", "left").join(results.select("qid", "doc", F.lit(1).alias("back")).distinct(), ["qid", "doc"], "left")
    r = r.join(trie.select("sid", F.lit(1).alias("known")).distinct(), "sid", "left").join(pool.select("qid", "doc", "ce", F.lit(1).alias("pooled")), ["qid", "doc"], "left")
    levels = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.struct(n.alias("level"), F.array_join(F.slice(F.split("sid", r"\."), F.lit(1), n), ".").alias("prefix"))))
    own = r.select("qid", "doc", levels.alias("p")).select("qid", "doc", "p.level", "p.prefix")
    alive = own.join(survivors.select("qid", "level", "prefix", F.lit(1).alias("on_")).distinct(), ["qid", "level", "prefix"], "left")
    depth = alive.groupBy("qid", "doc").agg(F.coalesce(F.min(F.when(F.col("on_").isNull(), F.col("level"))) - 1, F.lit(4)).alias("survived"))
    allowed = (F.col("tenant") == tenant) & ((F.coalesce(F.size("roles"), F.lit(0)) <= 0) | F.arrays_overlap("roles", held))
    reason = (
        F.when(F.col("state").isNull(), "not_in_trie").when(F.col("state") == "TOMBSTONED", "filtered_tombstone").when(~F.coalesce(allowed, F.lit(False)), "filtered_acl")
        .when(F.col("back") == 1, "retrieved").when(F.col("known").isNull(), "not_in_trie")
        .when((F.col("pooled") == 1) & (F.col("ce") < least), "low_relevance").when((F.col("pooled") == 1) & (F.col("state") == "ACTIVE_COLD_START"), "cold_start_outranked")
        .when(F.col("pooled") == 1, "reranked_below_k").otherwise("pruned")
    )
    return r.join(depth, ["qid", "doc"], "left").select("qid", "doc", reason.alias("reason"), F.when(reason == "pruned", F.coalesce("survived", F.lit(0))).cast("long").alias("survived"))


# ------------------------------------------------------------ bundles


def approvals(log: DataFrame, needed: int = 2) -> DataFrame:
    """(at, bundle, operator) -> activations (at, bundle, place): each time as many different operators
    have approved a bundle since its last activation. One group is one bundle's approvals."""

    def fold(pdf):  # noqa: ANN001, ANN202
        seen, out = set(), []
        for at, operator in zip(*(pdf.sort_values(["at", "operator"])[c] for c in ("at", "operator")), strict=True):
            seen.add(operator)
            if len(seen) >= needed:
                out.append(at)
                seen = set()
        return pdf.iloc[: len(out)].assign(at=out)[["at", "bundle"]]

    done = log.select("at", "bundle", "operator").groupBy("bundle").applyInPandas(fold, log.select("at", "bundle").schema)
    return done.withColumn("place", F.row_number().over(Window.orderBy("at", "bundle")).cast("long"))


def hot_bundles(activations: DataFrame, n: int = 3) -> DataFrame:
    """The last n different bundles that were active, latest first."""
    last = activations.groupBy("bundle").agg(F.max("place").alias("place"))
    return last.orderBy(F.desc("place")).limit(n)


def compatible(bundle: DataFrame, codebook: DataFrame, trie: DataFrame, adapter: DataFrame) -> DataFrame:
    """(bundle_id, problem): all reasons why artefacts (version, sha256, id_schema; the adapter's backbone and
    trained_on_snapshot; the trie's corpus_snapshot) do not fit a bundle, and warnings on old adapters."""
    b = bundle.alias("b").join(codebook.alias("c"), F.col("b.codebooks") == F.col("c.version"), "left").join(trie.alias("t"), F.col("b.trie_snapshot") == F.col("t.version"), "left").join(adapter.alias("a"), F.col("b.adapter") == F.col("a.version"), "left")
    day = lambda c: F.to_date(F.substring(c, 4, 10), "yyyy_MM_dd")
    gap = F.date_diff(day(F.col("t.corpus_snapshot")), day(F.col("a.trained_on_snapshot")))
    tests = [
        ("codebook missing", F.col("c.version").isNull()), ("codebook sha256", F.col("c.sha256") != F.col("b.codebook_sha256")), ("codebook schema", F.col("c.id_schema") != F.col("b.id_schema")),
        ("trie missing", F.col("t.version").isNull()), ("trie sha256", F.col("t.sha256") != F.col("b.trie_sha256")), ("trie schema", F.col("t.id_schema") != F.col("b.id_schema")),
        ("adapter missing", F.col("b.adapter").isNotNull() & F.col("a.version").isNull()), ("adapter backbone", F.col("a.backbone") != F.col("b.backbone")),
        ("trie before adapter", gap < 0), ("alarm: old adapter", gap > 30), ("warning: old adapter", (gap > 7) & (gap <= 30)),
    ]
    found = F.array_compact(F.array(*(F.when(t, name) for name, t in tests)))
    return b.select("b.bundle_id", F.explode(found).alias("problem"))


def snapshot_name(at: Column) -> Column:
    return F.concat(F.lit("cs_"), F.date_format(at, "yyyy_MM_dd"))


def snapshot_date(name: Column) -> Column:
    return F.to_date(F.substring(name, 4, 10), "yyyy_MM_dd")


# ------------------------------------------------------------ requests


def breaker(calls: DataFrame, failures: int = 5, cooldown: float = 10.0) -> DataFrame:
    """(key, at, id, failed) -> with `open`: calls that are turned away. After so many failures in a row the
    breaker opens; after the cooldown one failure opens it again and one success closes it.
    A key's calls are one group, in order of at, id."""

    def fold(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["at", "id"])
        count, opened, out = 0, None, []
        for at, failed in zip(pdf["at"], pdf["failed"], strict=True):
            if opened is not None and at - opened >= cooldown:
                opened, count = None, failures - 1
            out.append(opened is not None)
            if opened is None:
                count = count + 1 if failed else 0
                opened = at if count >= failures else None
        return pdf.assign(open=out)

    one = calls.select("key", "at", "id", "failed")
    return one.groupBy("key").applyInPandas(fold, one.withColumn("open", F.lit(False)).schema)


def rate_limit(calls: DataFrame, per_second: float = 200.0) -> DataFrame:
    """(key, at, id) -> with `allowed`: a bucket of tokens for each key, filled at the rate it may hold."""

    def fold(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(["at", "id"])
        tokens, last, out = per_second, None, []
        for at in pdf["at"]:
            tokens = min(per_second, tokens + (0.0 if last is None else at - last) * per_second)
            out.append(tokens >= 1)
            if tokens >= 1:
                tokens, last = tokens - 1, at
            else:
                tokens = tokens if last is None else tokens - (at - last) * per_second  # a refusal leaves the bucket as it was
        return pdf.assign(allowed=out)

    one = calls.select("key", "at", "id")
    return one.groupBy("key").applyInPandas(fold, one.withColumn("allowed", F.lit(False)).schema)


def empty_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc long, tenant string, sid string, schema string, state string, hash string, uri string, title string, snippet string, roles array<string>, metadata map<string,string>, parent long, epoch long, deleted_at timestamp_ntz")

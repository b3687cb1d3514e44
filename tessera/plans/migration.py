"""Queries: a staged move to identifiers of new codebooks."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import register
from tessera.functions import ids
from tessera.operators import migration as M
from tessera.operators import quantize as Q
from tessera.plans import lifecycle as L
from tessera.sources.lineage import checkpoint_dir

AT, SALT = "2026-02-01 00:00:00", "v2 "


def _registry(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Vectors as documents with identifiers of the present codebooks."""
    issued = Q.allocate(L._codes(s, d)).select("doc", "sid")
    docs = issued.withColumns({"schema": F.when(F.col("doc") % 10 == 9, "v0").otherwise("v1"), "state": F.when(F.col("doc") % 13 == 0, "TOMBSTONED").otherwise("ACTIVE_LEARNED")})
    history = docs.select("doc", "sid", "schema", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    aliases = s.createDataFrame([], "schema string, sid string, doc long, reason string, expires_at timestamp_ntz")
    return {"docs": docs, "aliases": aliases, "history": history, "counters": s.createDataFrame([], "schema string, prefix string, next_ordinal long")}


def _planned(s: SparkSession, d: str) -> tuple[M.Migration, dict[str, DataFrame]]:
    m = M.Migration(s, f"{checkpoint_dir(s)}/migration-{uuid.uuid4().hex[:12]}", "v2", AT, escape_limit=1.0, balance_limit=16.0)
    registry = _registry(s, d)
    m.plan(registry["docs"], L._vectors(s, d), L._books(s, d, SALT))
    return m, registry


def migration_plan(s: SparkSession, d: str) -> DataFrame:
    return _planned(s, d)[0].read("plan", "mapping").select("doc", ids.short_text(F.col("old_sid")).alias("old_sid"), ids.short_text(F.col("new_sid")).alias("new_sid"))


def migration_report(s: SparkSession, d: str) -> DataFrame:
    return _planned(s, d)[0].read("plan", "report")


def migration_cutover(s: SparkSession, d: str) -> DataFrame:
    """The registry after all stages, each run twice: identifiers, aliases and open history of every document."""
    m, registry = _planned(s, d)
    for _ in range(2):
        m.prepopulate(registry)
    for _ in range(2):
        t = m.cutover(["ann", "bob"])
    n = t["aliases"].groupBy("doc").agg(F.count("*").alias("aliases"), F.max("sid").alias("alias"))
    h = t["history"].groupBy("doc").agg(F.count("*").alias("versions"), F.max(F.when(F.col("valid_to").isNull(), F.col("sid"))).alias("open_sid"))
    shown = [ids.short_text(F.col(c)).alias(c) for c in ("sid", "alias", "open_sid")]  # as the SQL states them
    return t["docs"].join(n, "doc", "left").join(h, "doc").select("doc", shown[0], "schema", F.coalesce("aliases", F.lit(0)).alias("aliases"), shown[1], "versions", shown[2])


def migration_counters(s: SparkSession, d: str) -> DataFrame:
    m, registry = _planned(s, d)
    m.prepopulate(registry)
    return m.cutover(["ann", "bob"])["counters"]


def _new_codes_sql() -> str:
    """The CTEs of codes once more, of the living and of the other sample: mcodes."""
    names = re.compile(r"\b(sample|[bkr][1-4]|codes)\b")
    parts = names.sub(r"m\1", L.RQ.split(", issued AS", 1)[0].split(", sample AS", 1)[1]).replace("sha256(CAST(doc AS VARCHAR))", f"sha256('{SALT}' || CAST(doc AS VARCHAR))")
    return f"msample AS{parts}, live AS (SELECT * FROM mcodes WHERE doc % 13 <> 0), missued AS (SELECT *, row_number() OVER (PARTITION BY c1, c2, c3, c4 ORDER BY doc) - 1 AS ordinal FROM live)"


_SID = f"{L._P} || '.' || {L._TAIL}"
MIGRATION_SQL = f"""WITH {L.RQ}, {_new_codes_sql()},
o AS (SELECT doc, {_SID} AS old_sid, CASE WHEN doc % 10 = 9 THEN 'v0' ELSE 'v1' END AS schema FROM issued), n AS (SELECT doc, {_SID} AS new_sid, {L._P} AS prefix, c1, ordinal, err FROM missued)"""

register("migration_plan", migration_plan, f"{MIGRATION_SQL} SELECT doc, old_sid, new_sid FROM n JOIN o USING (doc)")
register("migration_report", migration_report, f"""{MIGRATION_SQL}, g AS (SELECT c1, count(*) AS k FROM n GROUP BY c1), r AS (SELECT count(*) AS documents, round(avg((ordinal >= 255)::INT), 6) AS escape_rate, round(avg((split_part(old_sid, '.', 1) <> c1::VARCHAR)::INT), 6) AS moved_share,
  round((SELECT max(k) FROM g) * {L.K} / count(*), 6) AS l1_max_mean, round(avg(err), 6) AS error, CAST(0 AS BIGINT) AS without_vector FROM n JOIN o USING (doc)) SELECT *, escape_rate < 1.0 AS escape_ok, l1_max_mean <= 16 AS balance_ok FROM r""")
register("migration_cutover", migration_cutover, f"""{MIGRATION_SQL} SELECT o.doc, coalesce(new_sid, old_sid) AS sid, CASE WHEN new_sid IS NULL THEN schema ELSE 'v2' END AS schema, (new_sid IS NOT NULL)::BIGINT AS aliases, CASE WHEN new_sid IS NOT NULL THEN old_sid END AS alias,
  1 + (new_sid IS NOT NULL)::BIGINT AS versions, coalesce(new_sid, old_sid) AS open_sid FROM o LEFT JOIN n ON o.doc = n.doc""")
register("migration_counters", migration_counters, f"{MIGRATION_SQL} SELECT 'v2' AS schema, prefix, max(ordinal) + 1 AS next_ordinal FROM n GROUP BY prefix")

"""Artefacts as versioned tables: codebooks, trie snapshots with a pointer, contents, wire rows, options.

A version is written once; a digest stands beside it and is checked on reading. A trie becomes the
latest only if it holds exactly the identifiers expected of it.

Defined results: an unknown version, a wrong digest and a version that exists already are errors;
empty tables are valid; null texts have no content.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import quantize as Q


# ------------------------------------------------------------ codebooks


def codebook_digest(books: list[np.ndarray]) -> str:
    h = hashlib.sha256()
    for book in books:
        h.update(json.dumps(book.shape).encode())
        h.update(np.ascontiguousarray(book, "<f8").tobytes())
    return h.hexdigest()


def save_codebooks(spark: SparkSession, books: list[np.ndarray], directory: str, version: str, id_schema: str) -> str:
    """Writes levels of centroids as rows; gives their digest."""
    digest = codebook_digest(books)
    rows = [(level, code, [float(v) for v in c], id_schema, digest) for level, book in enumerate(books) for code, c in enumerate(book)]
    df = spark.createDataFrame(rows, "level int, code int, centroid array<double>, id_schema string, sha256 string")
    df.coalesce(1).write.mode("errorifexists").parquet(f"{directory}/{version}")  # a few thousand rows
    return digest


def load_codebooks(spark: SparkSession, directory: str, version: str, expected: str | None = None) -> tuple[list[np.ndarray], str]:
    """(codebooks, id schema) of a version, if the rows still have the digest."""
    rows = spark.read.parquet(f"{directory}/{version}").orderBy("level", "code").collect()
    levels = sorted({r["level"] for r in rows})
    books = [np.array([r["centroid"] for r in rows if r["level"] == n]) for n in levels]
    digest = codebook_digest(books)
    if digest != rows[0]["sha256"] or (expected is not None and digest != expected):
        raise ValueError(f"codebooks {version}: digest {digest} is not the expected one")
    return books, rows[0]["id_schema"]


# ------------------------------------------------------------ tries


def publish_trie(issued: DataFrame, expected: DataFrame, directory: str, version: str, id_schema: str) -> dict:
    """Writes a snapshot of identifiers (codes, tail, sid, packed), and makes it the latest if it
    has no identifier missing, extra or double. The result says which."""
    spark = issued.sparkSession
    path = f"{directory}/tries/{version}"
    issued.select("codes", "tail", "sid", "packed").sortWithinPartitions("packed").write.mode("errorifexists").parquet(path)
    written = spark.read.parquet(path)
    check = Q.validate(written, expected).first()
    found = {"version": version, "id_schema": id_schema, "leaves": check["leaves"], "missing": check["missing"], "extra": check["extra"], "digest": Q.ids_digest(written).first()["digest"]}
    found["double"] = check["leaves"] - written.select("packed").distinct().count()
    found["valid"] = not (found["missing"] or found["extra"] or found["double"])
    if found["valid"]:
        row = spark.createDataFrame([(json.dumps(found, sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(f"{directory}/latest")
    return found


def latest_trie(spark: SparkSession, directory: str, id_schema: str | None = None) -> DataFrame:
    """The latest valid snapshot, if its schema and its digest are as said."""
    said = json.loads(spark.read.text(f"{directory}/latest").first()["value"])
    if id_schema is not None and said["id_schema"] != id_schema:
        raise ValueError(f"trie {said['version']} has schema {said['id_schema']}, not {id_schema}")
    trie = spark.read.parquet(f"{directory}/tries/{said['version']}")
    if Q.ids_digest(trie).first()["digest"] != said["digest"]:
        raise ValueError(f"trie {said['version']}: its identifiers are not those published")
    return trie


def due(epochs: DataFrame, built_epoch: int, built_at: str, now: str, every_s: int = 900, most: int = 50_000) -> DataFrame:
    """Whether a new trie is due: the registry moved on, and long enough ago or far enough."""
    top = epochs.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("epoch"))
    late = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.lit(built_at)) >= every_s
    return top.select("epoch", ((F.col("epoch") > built_epoch) & (late | (F.col("epoch") - built_epoch >= most))).alias("due"))


# ------------------------------------------------------------ contents, rows on the wire, batches


def contents(docs: DataFrame) -> DataFrame:
    """(hash, uri, text) of distinct texts; what is not trusted gets a place of its own."""
    trusted = F.coalesce(F.col("trusted"), F.lit(True)) if "trusted" in docs.columns else F.lit(True)
    one = docs.where("text IS NOT NULL").select(F.sha2("text", 256).alias("hash"), "text", trusted.alias("trusted"))
    uri = F.concat(F.when(F.col("trusted"), "blobs/").otherwise("quarantine/"), F.substring("hash", 1, 2), F.lit("/"), F.col("hash"))
    return one.groupBy("hash", "trusted").agg(F.first("text").alias("text")).withColumn("uri", uri)


def to_wire(rows: DataFrame) -> DataFrame:
    """One JSON text a row, keys in order, nulls left out."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def from_wire(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def batches(rows: DataFrame, size: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Every row with the number of its batch in one shuffled pass: `size` rows each, the last one less.
    Sorted by a seeded hash over all machines and numbered without gathering."""
    shuffled = rows.orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), F.to_json(F.struct(*rows.columns))), *rows.columns)
    numbered = shuffled.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] // size))
    return rows.sparkSession.createDataFrame(numbered, rows.withColumn("batch", F.lit(0).cast("long")).schema)


# ------------------------------------------------------------ options


def _settings(options: dict) -> list[tuple[tuple[str, ...], object]]:
    """(path of names, value) of every value; a section without values stands for itself."""
    todo, found = [((), options)], []
    while todo:
        path, section = todo.pop()
        for name, value in section.items():
            if isinstance(value, dict) and value:
                todo.append(((*path, name), value))
            else:
                found.append(((*path, name), value))
    return found


def merged(base: dict, over: dict) -> dict:
    """Options with others laid over them: a value hides what stood at its path, below it or in its way."""
    table = dict(_settings(base))
    for path, value in _settings(over):
        below = [p for p in table if p[: len(path)] == path]
        if value == {} and any(len(p) > len(path) for p in below):
            continue  # an empty section changes nothing in one that has values
        above = [path[:k] for k in range(1, len(path)) if path[:k] in table]
        for p in (*below, *above):
            del table[p]
        table[path] = value
    out: dict = {}
    for path, value in table.items():
        at = out
        for name in path[:-1]:
            at = at.setdefault(name, {})
        at[path[-1]] = value
    return out


def load_options(spark: SparkSession, *paths: str) -> dict:
    """JSON files, the later ones over the earlier; read by Spark, so any store works."""
    out: dict = {}
    for path in paths:
        out = merged(out, json.loads(spark.read.option("wholetext", True).text(path).first()["value"]))
    return out

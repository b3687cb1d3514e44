"""Near-duplicate documents by one-permutation hashing.

A document's set holds the hashes of its distinct k-word shingles. Documents with one
set are one class and go on as a key made from it; a component is named by its smallest
doc_id. One-permutation hashing keeps the
least hash of each bin; empty bins are filled by optimal densification (each follows
its own universal probe sequence to a filled bin). ``BANDS`` bands of ``ROWS`` bins
give buckets; candidate edges are stars, from the member of a bucket that meets most
others (the text that copies derive from) to its other members, and are confirmed on
the full sets. A second round of stars has its centres outside each bucket's main
component. Buckets whose members still are of several components are completed: within
a task, on the full sets, and with one link for each join of two components, never with
all pairs. Components follow by star contraction.

At a similarity of 0.8 a pair shares no bucket with a chance of 0.738**50, 3e-7.

Defined results: only A-Z are lower-cased; with fewer than k words the whole sequence
is the one shingle; null, empty and blank texts have an empty set, link with nothing
and are kept; rows that share a doc_id count as one document when their texts are
equal, and otherwise as texts of one id that the result lists one by one; an empty
table gives no row; a null doc_id is left out of links; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread, trimmed
from .graph import components
from .hashing import _BASE, scramble, slice_hashes
from .words import blocks, word_runs

BANDS, ROWS = 50, 6
BINS = BANDS * ROWS
#: Rounds of stars before the exact completion.
STARS = 2
#: Members of a bucket, and hashes in their sets, that the completion compares at once.
TILE = 512
TILE_HASHES = 1 << 18
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def shingles(b: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    start, end, doc = word_runs(_LOWER[b], off)
    h = slice_hashes(_LOWER[b], start, end)
    n_docs = len(off) - 1
    n_words = np.bincount(doc, minlength=n_docs)
    factor = scramble(np.arange(1, k + 1, dtype=np.uint64))
    acc = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        acc[: len(h) - j] += scramble(h[j:] + factor[j]) if j else scramble(h + factor[0])
    acc = scramble(acc)
    out, at = [], 0
    for n in n_words.tolist():
        if n >= k:
            out.append(np.unique(acc[at : at + n - k + 1]))
        elif n:
            whole = np.uint64(n)
            for j in range(n):
                whole = scramble((h[at + j : at + j + 1] + factor[j]) ^ np.uint64(int(whole)))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Least hash by bin of each set, densified; rows of empty sets are zero."""
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):  # sorted, so a bin's first hash is its least
        if len(s):
            at = (s >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
            held, first = np.unique(at, return_index=True)
            out[i, held] = s[first]
            full[i, held] = True
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    filled, attempt = full.copy(), 0
    while len(rows):
        probe = scramble(cols.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(attempt * 0x9FB21C651E98DF25 % (1 << 64))) % np.uint64(bins)
        hit = full[rows, probe]
        out[rows[hit], cols[hit]] = out[rows[hit], probe[hit]]
        filled[rows[hit], cols[hit]] = True
        rows, cols, attempt = rows[~hit], cols[~hit], attempt + 1
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        keys = scramble(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS] + np.uint64(r + 1))
    return scramble(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


_SIGNED = "doc_id long, text_hash long, n long, digest binary, bands array<long>"


def text_hash() -> Column:
    """Tells the texts under one doc_id apart."""
    return F.xxhash64("text")


def _digests(sets: list[np.ndarray]) -> pa.Array:
    """128-bit digests of the sets; null for empty ones."""
    return pa.array([np.array([s.sum(dtype=np.uint64), scramble(s + _BASE).sum(dtype=np.uint64)]).tobytes() if len(s) else None for s in sets], pa.binary())


def _class_key() -> Column:
    """The key of a class of equal sets: a doc_id would not do, as texts may differ under one."""
    return F.xxhash64("digest", "n")


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash of the text, set size, 128-bit digest of the set and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi, b, off in blocks(batch.column("text"), 1 << 20):
                sets = shingles(b, off, k)
                keys = _band_keys(signatures(sets)).view(np.int64)
                yield pa.record_batch(
                    [ids.slice(lo, hi - lo), batch.column("text_hash").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), _digests(sets), pa.array([list(x) if len(s) else None for x, s in zip(keys, sets, strict=True)], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n", "digest", "bands"],
                )

    return docs.select("doc_id", "text", text_hash().alias("text_hash")).mapInArrow(trimmed(run), _SIGNED)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Key and whole set (sorted hashes, 8 bytes each) of each class among the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, b, off in blocks(batch.column("text"), 1 << 20):
                sets = shingles(b, off, k)
                yield pa.record_batch([pa.array([len(s) for s in sets], pa.int64()), _digests(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n", "digest", "hashes"])

    found = docs.select("text").mapInArrow(trimmed(run), "n long, digest binary, hashes binary").where("digest IS NOT NULL")
    return found.select(_class_key().alias("id"), "hashes").dropDuplicates(["id"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets share at least `percent` of their union."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").select("a", "b", "ha", "hb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, None
            for i, (p, q) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                buf = p.as_buffer()
                if last is None or buf.address != last:
                    x, last = np.frombuffer(buf, np.uint64), buf.address
                y = np.frombuffer(q.as_buffer(), np.uint64)
                joint = np.concatenate([x, y])
                joint.sort()
                shared = int((joint[1:] == joint[:-1]).sum())
                if 100 * shared >= percent * (len(joint) - shared):
                    keep.append(i)
            if keep:
                yield batch.select([0, 1]).take(pa.array(keep))

    return both.mapInArrow(trimmed(run), "a long, b long")


def _forest(ids: list[int], own: list[int], sets: list[np.ndarray], half: int, percent: int) -> tuple[list[int], list[int]]:
    """Links that join the components of one group, one for each join: from a member to one of
    each other component it is alike with. With `half`, members before it only meet those from it on."""
    sizes = np.array([len(h) for h in sets])
    root = np.unique(np.array(own), return_inverse=True)[1]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    a: list[int] = []
    b: list[int] = []
    for i, h in enumerate(sets[: half or len(sets)]):
        if (root == root[0]).all():
            break
        open_ = root != root[i]
        if half:
            open_[:half] = False
        open_ &= (100 * np.minimum(sizes, len(h)) >= percent * np.maximum(sizes, len(h)))
        if not open_.any():
            continue
        lo, hi = np.searchsorted(flat, h, "left"), np.searchsorted(flat, h, "right")
        many = hi - lo
        ends = np.cumsum(many)
        shared = np.bincount(owner[np.repeat(lo - (ends - many), many) + np.arange(ends[-1])], minlength=len(sets))
        for k in np.flatnonzero(open_ & (100 * shared >= percent * (sizes + len(h) - shared))).tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                a.append(min(ids[i], ids[k]))
                b.append(max(ids[i], ids[k]))
    return a, b


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _bucket_links(percent: int):
    """Rows by key, a bucket together: the links of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, sets, last = [], [], [], None
        for batch in batches:
            keys, id_, own_ = (batch.column(c).to_pylist() for c in ("key", "id", "own"))
            hashes = batch.column("hashes")
            for n, key in enumerate(keys):
                if key != last:
                    if len(ids) > 1:
                        yield _edges(*_forest(ids, own, sets, 0, percent))
                    ids, own, sets, last = [], [], [], key
                ids.append(id_[n])
                own.append(own_[n])
                sets.append(np.frombuffer(hashes[n].as_buffer(), np.uint64))
        if len(ids) > 1:
            yield _edges(*_forest(ids, own, sets, 0, percent))

    return run


def _blob(table: pa.Table) -> pa.Table:
    """A tile of a bucket as one row: ids, components, set sizes and sets."""
    hashes = table.column("hashes").to_pylist()
    sizes = np.array([len(h) // 8 for h in hashes], np.int64)
    cols = [pa.array([table.column(c)[0].as_py()], t) for c, t in (("key", pa.int64()), ("tile", pa.int32()))]
    cols += [pa.array([table.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("id", "own")]
    return pa.table([*cols, pa.array([sizes.tobytes()], pa.binary()), pa.array([b"".join(hashes)], pa.binary())], names=["key", "tile", "ids", "owns", "sizes", "sets"])


def _tile_links(percent: int):
    """Pairs of tiles: the links within a tile, or across two."""

    def members(row: dict, end: str) -> tuple[list[int], list[int], list[np.ndarray]]:
        cuts = np.cumsum(np.frombuffer(row["sizes" + end], np.int64))[:-1]
        return np.frombuffer(row["ids" + end], np.int64).tolist(), np.frombuffer(row["owns" + end], np.int64).tolist(), np.split(np.frombuffer(row["sets" + end], np.uint64), cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, own, sets = members(row, "")
                half = 0
                if row["tile"] != row["tile_b"]:
                    half, more = len(ids), members(row, "_b")
                    ids, own, sets = ids + more[0], own + more[1], sets + more[2]
                yield _edges(*_forest(ids, own, sets, half, percent))

    return run


def _finish(known: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links that the stars left open: of each bucket whose members are of several components,
    one link for each join of two of them, found on the full sets. A bucket is compared within
    a task, and only its joins come out. One of more than a tile (``TILE`` members or
    ``TILE_HASHES`` hashes) goes as tiles, each one row; each pair of its tiles is compared
    by itself, so rows grow with members and pairs of tiles only."""
    n = spread(scratch.spark) * 2
    mixed = known.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("m"), F.sum("size").alias("hashes")).where("low <> high")
    tiles = F.ceil(F.greatest(F.col("m") / TILE, F.col("hashes") / TILE_HASHES)).cast("int")
    mixed = scratch.write(mixed.select("key", tiles.alias("tiles")), "mixed")
    left = scratch.write(known.join(mixed, "key").select("key", "id", "own", "tiles"), "left")
    used = scratch.write(sets.join(left.select("id").distinct(), "id").select("id", "hashes"), "used")
    rows = left.join(used, "id")
    one = rows.where("tiles = 1").select("key", "id", "own", "hashes").repartition(n, "key").sortWithinPartitions("key").mapInArrow(trimmed(_bucket_links(percent)), "a long, b long")
    large = mixed.where("tiles > 1")
    if not large.limit(1).count():
        return one
    dealt = rows.where("tiles > 1").select("key", F.pmod(F.xxhash64("id"), "tiles").cast("int").alias("tile"), "id", "own", "hashes")
    body = scratch.write(dealt.groupBy("key", "tile").applyInArrow(_blob, "key long, tile int, ids binary, owns binary, sizes binary, sets binary"), "tiles")
    pairs = large.select("key", "tiles", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    pairs = pairs.select("key", "tile", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tile_b")).repartition(n, "key", "tile", "tile_b")
    body_b = body.select("key", F.col("tile").alias("tile_b"), *(F.col(c).alias(f"{c}_b") for c in ("ids", "owns", "sizes", "sets")))
    across = pairs.join(body, ["key", "tile"]).join(body_b, ["key", "tile_b"]).mapInArrow(trimmed(_tile_links(percent)), "a long, b long")
    return one.union(across)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, row_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; with `row_keys` also the text's
    hash and a key of the component, as two components may have one smallest doc_id."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.write(signed(docs, k), "signed")
    # classes of equal sets, by partial aggregation
    classes = scratch.write(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest", "n").agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands")).withColumn("id", _class_key()), "classes")
    members = classes.select("id", F.col("n").alias("size"), F.posexplode("bands").alias("band", "key")).select("id", "size", "key")
    buckets = scratch.write(members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    filled = scratch.write(members.join(buckets, "key"), "filled")
    # how often a member meets others: the text that copies derive from has the most
    degree = filled.groupBy("id").agg(F.sum("m").alias("degree"))
    filled = scratch.write(filled.join(degree, "id").select("key", "id", "size", "degree"), "ranked")
    wanted = classes.select("id", "doc").join(filled.select("id").distinct(), "id").select(F.col("doc").alias("doc_id")).distinct()
    sets = scratch.write(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id"), k), "sets")
    fits = "least(size, center_size) * 100 >= greatest(size, center_size) * " + str(percent)
    label = links = tried = None
    for r in range(STARS):
        own = filled.withColumn("own", F.col("id")) if label is None else filled.join(label, "id", "left").withColumn("own", F.coalesce("component", "id"))
        own = scratch.write(own.select("key", "id", "size", "degree", "own"), f"own{r}")
        # buckets that are not of one component, with their main component
        open_ = own.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.max(F.struct("degree", F.col("id"), F.col("own"), "size")).alias("top")).where("low <> high")
        if r:  # the centre is the chief member outside the main component
            outside = own.join(open_.select("key", F.col("top.own").alias("main")), "key").where("own <> main")
            open_ = outside.groupBy("key").agg(F.max(F.struct("degree", F.col("id"), F.col("own"), "size")).alias("top"))
        heads = scratch.write(open_.select("key", F.col("top.id").alias("center"), F.col("top.own").alias("home"), F.col("top.size").alias("center_size")), f"heads{r}")
        star = own.join(heads, "key").where("own <> home").where(fits).select(F.least("center", "id").alias("a"), F.greatest("center", "id").alias("b")).distinct()
        if tried is not None:
            star = star.join(tried, ["a", "b"], "left_anti")
        star = scratch.write(star, f"star{r}")
        found = scratch.write(confirm(star, sets, percent), f"links{r}")
        links = found if links is None else links.union(found)
        tried = star if tried is None else tried.union(star)
        label = scratch.write(components(links, scratch, f"cc{r}"), f"label{r}")
    # what the stars leave open: members of buckets that still are of several components
    known = filled.join(label, "id", "left").select("key", "id", "size", "degree", F.coalesce("component", "id").alias("own"))
    known = scratch.write(known, "known")
    more = scratch.write(_finish(known, sets, scratch, percent).distinct(), "more")
    if more.limit(1).count():
        label = scratch.write(components(links.union(more), scratch, "cc"), "label")
    least = classes.select("id", "doc").join(label, "id").groupBy("component").agg(F.min("doc").alias("least"))
    of_class = classes.select("id", "digest", "n", "doc").join(label, "id", "left").join(least, "component", "left")
    of_class = scratch.write(of_class.select("digest", "n", F.coalesce("component", "id").alias("component_key"), F.coalesce("least", "doc").alias("component")), "of_class")
    out = rows.select("doc_id", "text_hash", "n", "digest").join(of_class, ["digest", "n"], "left")
    own = F.coalesce("component", "doc_id")
    keys = ["text_hash", "component_key"] if row_keys else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), *keys)


#: Exact components in SQL, over all pairs of classes that share a shingle; for small tables.
COMPONENT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
c AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
x AS (SELECT id, n, unnest(s) AS g FROM c),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.n) + any_value(b.n) AS t, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (t - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s LEFT JOIN m ON m.id = c.id
"""

"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of
one role are merged by an array aggregation. The template is

    [INST]role[/INST]text<s>text</s>[INST]role[/INST]text</s>...

where ``<s>`` parts the texts of merged turns. Inside roles and texts a backslash
is doubled and a backslash goes into each control string, so every turn can be
read back. ``loss_spans`` are the code-point ranges of the assistant texts.

Defined results: a null role or text is empty; turns with equal numbers are in
order of role, then text, and repeated rows stay; a null turn comes first; a null
conv_id is a conversation of its own; an empty table gives no row; other columns
are ignored. A conversation is one row of the result and has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 4096


def escape(x: Column) -> Column:
    return F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), r"([\[<])(?=/?(?:INST\]|s>))", r"$1\\")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\\(.)", "$1")


def _held(rows: DataFrame, **named: Column) -> DataFrame:
    """Rows with further columns that are computed once a row: an expression used inside a lambda
    would else be moved into it and computed for each element."""
    for name, value in named.items():
        rows = rows.select("*", F.explode(F.array(value)).alias(name))
    return rows


def merge_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, blocks): blocks of adjacent turns with one role, array<struct<role, texts>>.

    A block begins where the role differs from the one before and is sliced out once."""
    n = F.size("turns")
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    held = _held(rows, begins=begins)
    bounds = F.arrays_zip(F.col("begins").alias("a"), F.concat(F.slice("begins", F.lit(2), F.size("begins")), F.array(n + 1)).alias("b"))
    own = lambda x: F.slice("turns", x["a"], x["b"] - x["a"])
    block = lambda x: F.struct(F.element_at("turns", x["a"])["role"].alias("role"), F.transform(own(x), lambda t: t["text"]).alias("texts"))
    return _held(held, bounds=bounds).select("conv_id", F.transform("bounds", block).alias("blocks"))


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start, end>>.

    Work grows with the turns: offsets are running sums over a conversation's pieces, which lie
    in order where the conversation does."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = merge_turns(_held(turns.withColumnRenamed("turns", "t_"), turns=F.col("t_")).select("conv_id", "turns"))

    def pieces(b: Column) -> Column:
        head = F.struct(F.concat(F.lit("[INST]"), escape(b["role"]), F.lit("[/INST]")).alias("s"), F.lit(False).alias("loss"))
        texts = F.transform(b["texts"], lambda x, i: F.array(F.struct(F.when(i > 0, "<s>").otherwise("").alias("s"), F.lit(False).alias("loss")), F.struct(escape(x).alias("s"), (b["role"] == loss_role).alias("loss"))))
        return F.concat(F.array(head), F.flatten(texts), F.array(F.struct(F.lit("</s>").alias("s"), F.lit(False).alias("loss"))))

    laid = blocks.select("conv_id", F.posexplode(F.flatten(F.transform("blocks", pieces))).alias("pos", "p")).select("conv_id", "pos", "p.s", "p.loss")
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("s").cast("long")
    placed = laid.withColumn("end", F.sum(size).over(upto)).withColumn("start", F.col("end") - size)
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("p"), F.sort_array(F.collect_list(F.when(F.col("loss"), F.struct("start", "end")))).alias("loss_spans"))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = unescape(F.regexp_extract(b, r"(?s)^\[INST\](.*?)\[/INST\]", 1))
        body = F.regexp_replace(b, r"(?s)^\[INST\].*?\[/INST\]", "")
        return F.transform(F.split(body, "<s>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(rows: DataFrame) -> DataFrame:
    """Rows of (formatted, loss_spans) with `loss`: all text under the mask, unescaped. A span is looked up in
    stretches of STRETCH characters, not counted off from the start of the text."""
    held = _held(rows, stretches=F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)))

    def text(x: Column) -> Column:
        first, last = F.floor(x["start"] / STRETCH).cast("int"), F.floor(x["end"] / STRETCH).cast("int")
        near = F.array_join(F.slice("stretches", first + 1, last - first + 1), "")
        return F.when(x["end"] == x["start"], "").otherwise(F.substring(near, (x["start"] % STRETCH + 1).cast("int"), (x["end"] - x["start"]).cast("int")))

    return held.withColumn("loss", F.array_join(F.transform("loss_spans", lambda x: unescape(text(x))), "")).drop("stretches")


DIGEST_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(replace(text, '\', '\\')) + len(regexp_extract_all(replace(text, '\', '\\'), '[\[<]/?(INST\]|s>)')) AS n,
    length(replace(role, '\', '\\')) + len(regexp_extract_all(replace(role, '\', '\\'), '[\[<]/?(INST\]|s>)')) AS r
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before IS NOT DISTINCT FROM role THEN 3 ELSE 13 + r + 4 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's digests, read back from the formatted output."""
    spark = conversations.sparkSession
    probe = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    out = read_loss(format_chats(rows)).withColumn("turns", read_turns(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

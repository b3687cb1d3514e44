"""Semantic identifiers: four codes and a tail whose ESCAPE bytes extend the ordinal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the identifier format.
LEVELS, K, ESCAPE, SPECIAL_TOKENS = 4, 256, 255, 8
MAX_ORDINALS = 3 * ESCAPE
# A full prefix goes on: three ESCAPE bytes and DIGITS digits to the base ESCAPE.
DIGITS = 4
MOST_ORDINALS = MAX_ORDINALS + ESCAPE**DIGITS


def tail(ordinal: Column) -> Column:
    """(255,) * depth + (rest,); ordinals from MAX_ORDINALS on are an error."""
    ok = F.concat(F.array_repeat(F.lit(ESCAPE), F.floor(ordinal / ESCAPE).cast("int")), F.array((ordinal % ESCAPE).cast("int")))
    return F.when((ordinal >= 0) & (ordinal < MAX_ORDINALS), ok).otherwise(F.raise_error(F.lit("prefix capacity exceeded")).cast("array<int>"))


def long_tail(ordinal: Column) -> Column:
    """Like `tail`, and for a full prefix (255, 255, 255) and the rest in DIGITS digits: tails stay unique, end
    themselves, go in the order of the ordinals, and have a bounded length."""
    over = ordinal - MAX_ORDINALS
    digits = [F.pmod(F.floor(over / ESCAPE**i), F.lit(ESCAPE)).cast("int") for i in range(DIGITS - 1, -1, -1)]
    more = F.array(*[F.lit(ESCAPE)] * 3, *digits)
    return F.when((ordinal >= MAX_ORDINALS) & (ordinal < MOST_ORDINALS), more).otherwise(tail(ordinal))


def ordinal(tail_: Column) -> Column:
    digits = F.slice(tail_, 4, DIGITS)
    long_ = MAX_ORDINALS + F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a * ESCAPE + x)
    return F.when(F.size(tail_) > 3, long_).otherwise(((F.size(tail_) - 1) * ESCAPE + F.element_at(tail_, -1)).cast("long"))


def short_tail(tail_: Column) -> Column:
    """At most three bytes, as the format without full prefixes has them: from MAX_ORDINALS on they repeat."""
    return F.when(F.size(tail_) > 3, F.array(F.lit(ESCAPE), F.lit(ESCAPE), F.element_at(tail_, -1))).otherwise(tail_)


def short_text(text: Column) -> Column:
    """An identifier's text with its short tail."""
    parts = parse(text)
    return F.when(F.size(parts) > LEVELS + 3, to_text(F.slice(parts, 1, LEVELS), short_tail(F.slice(parts, LEVELS + 1, 3 + DIGITS)))).otherwise(text)


def to_text(codes: Column, tail_: Column) -> Column:
    return F.array_join(F.concat(codes, tail_), ".")


def parse(text: Column) -> Column:
    return F.transform(F.split(text, r"\."), lambda x: x.try_cast("int"))


def pack(codes: Column, tail_: Column) -> Column:
    return F.unhex(F.array_join(F.transform(F.concat(codes, tail_), lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def unpack(raw: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("int"))


def tokens(codes_and_u: Column) -> Column:
    """Level-scoped ids of the four codes and the first tail byte."""
    return F.transform(codes_and_u, lambda c, i: F.lit(SPECIAL_TOKENS) + i * K + c)


def token_level(token: Column) -> Column:
    return (F.floor((token - SPECIAL_TOKENS) / K) + 1).cast("int")


def token_code(token: Column) -> Column:
    return ((token - SPECIAL_TOKENS) % K).cast("int")

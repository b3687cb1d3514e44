"""The queries opN_<name> on whole tables, and their DuckDB SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, embeddings, pii, quality, rules, toxicity
from . import search as lexical
from .common import table
from .huffman import token_files
from .minhash import COMPONENT_SQL, near_duplicates
from .mixing import mix
from .packing import pack
from .suffix import remove_repeats


def definition(name: str) -> str:
    """A tokenizer file's text: read on the driver, so machines need no copy."""
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), definition("byte_bpe_50k.json"), with_ids=False)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files(table(spark, sf_dir, "documents"), definition("word_bpe_49k.json"), 49_408)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("parts")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_token_files": op2_token_files,
    "op3_chat_format": op3_chat_format,
    "op4_quality_fm": op4_quality_fm,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_personal_data": op7_personal_data,
    "op8_minhash": op8_minhash,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": chat.DIGEST_SQL,
    "op5_quality_rules": rules.VERDICT_SQL,
    "op8_minhash": COMPONENT_SQL,
    "op9_embedding_dedup": embeddings.LINK_SQL,
    "op11_filter_audit": audit.AUDIT_SQL,
    "op12_lexical_search": lexical.SEARCH_SQL,
}

"""Queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from poolsift.llm import dialogue, topk
from poolsift.llm.bpe import round_trip_report
from poolsift.llm.common import table
from poolsift.llm.language import language_report
from poolsift.llm.line_dedup import line_report
from poolsift.llm.ngram_join import jaccard_groups
from poolsift.llm.packing import packing_report
from poolsift.llm.pii import personal_data_report
from poolsift.llm.simhash import fingerprint_report
from poolsift.llm.suffix_dedup import repeats_report
from poolsift.llm.token_counts import token_counts
from poolsift.llm.turns import repair_report
from poolsift.llm.whitening import whitened

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.perspectives(table(spark, sf_dir, "conversations"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_report(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(table(spark, sf_dir, "documents"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_perspectives": op2_perspectives,
    "op3_ngram_join": op3_ngram_join,
    "op4_bpe": op4_bpe,
    "op5_packing": op5_packing,
    "op6_repeats": op6_repeats,
    "op7_topk": op7_topk,
    "op8_language": op8_language,
    "op9_lines": op9_lines,
    "op10_pii": op10_pii,
    "op11_tokens": op11_tokens,
    "op12_whitening": op12_whitening,
    "op13_turns": op13_turns,
}

SQL: dict[str, str] = {"op2_perspectives": dialogue.SQL, "op7_topk": topk.SQL}

"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, langid, line_dedup, minhash, mixing, negatives, phrases, pieces, pii, quality, suffix_dedup, token_files, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file; ``TOKENIZER_DIR`` names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), ["doc_id"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_table(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_table(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_table(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_exact_dedup, op4_line_dedup, op5_mixing, op6_minhash, op7_suffix_array, op8_language_id, op9_warc, op10_token_files, op11_pii, op12_phrases, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "op9_warc": warc.ORACLE,
    "op11_pii": pii.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}

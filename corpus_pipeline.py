"""The training-data pipeline: clean, deduplicate, mix and tokenise ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and is written as Parquet and read again before the next one. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.llm import line_dedup, minhash, mixing, pieces, quality
from tapeworks.llm.common import stored
from tapeworks.llm.queries import table, tokenizer_file

#: Near-duplicates of the pipeline: five-word shingles, similarity 0.8 or more.
NEAR = minhash.Near(shingle=5, percent=80)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failing lines are removed from the others."""
    return _counted(quality.clean_documents(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated runs go, and documents made of nothing else."""
    return _counted(line_dedup.without_later_copies(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    return minhash.one_of_each(docs, near=NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents repeat by the rates that bring their sources to equal shares."""
    return mixing.mix(docs, bookkeeping=False)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row, with the check that they decode to its text."""
    return pieces.round_trip(docs, tokenizer_file("piece_bpe_32k.model"), ["doc_id", "lang", "source", "n_chars"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", clean),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", tokenise),
]

#: Near-duplicate groups and unigram segmentation have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

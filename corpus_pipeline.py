"""Corpus pipeline over ``documents``: five operators, each stage written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``docs``:

1. toxicity: rows that score 0.7 or more go; the model is learned from the labels of ``sf_dir``;
2. exact_dedup: of equal texts the row with the largest doc_id stays;
3. near_dedup: of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the row with the
   smallest doc_id stays (null last);
4. mixing: rows are repeated so that small sources gain weight; no row is lost, none is held more than twice;
5. tokens: SentencePiece ids of each row.

Every stage decides row by row: rows without a doc_id, or that share one, are judged by their own text. A null label
teaches nothing; a null text counts as empty, and all empty texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aerolith.llm.common import materialise, release
from aerolith.llm.exact_dedup import drop_exact_copies
from aerolith.llm.mixing import mix
from aerolith.llm.queries import tokenizer_path
from aerolith.llm.sentencepiece_codec import encode
from aerolith.llm.simhash_dedup import drop_near_copies
from aerolith.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, max_epochs=2.0)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: A learned score and fingerprints cannot be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; what is between stages is written to the shared checkpoint folder, read again, and
    deleted once the stage after it is written (the last one's input when the application ends)."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

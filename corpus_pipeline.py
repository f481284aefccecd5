"""The documents table as a training corpus: STAGES in order, each over all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowstream.llm.exact import drop_exact_copies
from flowstream.llm.mixing import mixed, mixing_table
from flowstream.llm.neardup import keep_one_of_class
from flowstream.llm.pieces import encode, load_pieces
from flowstream.llm.text import small_batches, stored
from flowstream.llm.toxicity import drop_toxic, fit_toxicity
from flowstream.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
PIECES = "piece_bpe_32k.model"


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. The model learns from the labelled rows among the documents."""
    _ready(spark)
    return drop_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.7)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are linked by a similarity of 0.8 or more on five-word n-grams."""
    _ready(spark)
    return keep_one_of_class(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3, repeating: a document has as many rows as its source's target takes it."""
    _ready(spark)
    return mixed(docs, mixing_table(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip and ids of every row of the mix."""
    _ready(spark)
    return encode(docs, load_pieces(public_tokenizers.path(PIECES)))


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("SentencePiece", tokens)]

#: Trained scores, hash-drawn shares and merge tables have no SQL form; the tests hold run() against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

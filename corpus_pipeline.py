"""A corpus pipeline: language ID, near-duplicates, decontamination, mixing and token output, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontamination import uncontaminated
from lodestone.llm.language_id import identify, learn_models
from lodestone.llm.mixing import mixed_rows
from lodestone.llm.near_duplicates import distinct_rows
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.session import shared_folder, table
from lodestone.llm.token_output import token_output

ORACLE_SQL = None  # learned models and rounding by hash have no SQL; tests compare with brute force


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; without letters, or unlike every language, they go."""
    models = learn_models(docs, "text", "lang", "doc_id")
    return identify(docs, models).where("lang_accepted").select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates (five-word shingles, similarity 0.8 or more), whatever their ids."""
    return distinct_rows(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark window, whatever their ids: a passage in a long text counts like one in a short text."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them: sources at weights 1, 2, 3 of all words."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document as read back from the files written."""
    return token_output(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_removal),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""A training corpus in four stages: toxic documents out, near copies out, repeated passages out, the rest packed.

Each stage takes all that the one before kept, as (spark, docs, sf_dir), and returns a DataFrame. All but the last return
the columns of documents. Nothing of a text is cut but by the stage that says so.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import checkpoint_dir
from millrace.llm.packing import best_fit_packing
from millrace.llm.simhash import without_similar
from millrace.llm.substring import remove_repeats
from millrace.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, doesn't call toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike by 0.8 or more in five-word shingles, the document of the smallest doc_id (null comes last)."""
    return without_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words that an earlier document has; a text that loses nothing stays as it is.

    Documents of which no word is left go, and n_chars follows the text.
    """
    cut = remove_repeats(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    left = cut.where("n_removed = 0 or n_removed < n_words")
    lost = F.col("n_removed") > 0
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[F.when(lost, changed[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids: a row for each piece of a document, with its sequence and place."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: The stages fit a model, draw on hashes and tokenize: SQL can't express them. tests/llm holds brute-force versions of the
#: stages' operators, and held-out rows for the model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

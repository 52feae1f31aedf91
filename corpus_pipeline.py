"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the stage
before kept; its result is written as Parquet and read again as the docs of
the next. All stages but the last return the columns of ``documents``.

In every stage NULL ids are allowed, repeated rows are rows of their own
unless it says otherwise, other columns pass through whatever their names,
an empty table gives an empty table, and texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshift.llm import decontaminate, linededup, packing, quality, simhash
from lakeshift.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and the likelihood ratio against documents labelled good.

    Null and empty texts have too few words and go. Without labels the rules alone decide.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return quality.keep_good(docs, trusted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of 50 words or more that occur earlier; ``n_chars`` follows the text.

    No row goes: a document deleted as a whole has an empty text, a null text stays null. Rows equal in id and text
    are one document. Ids that are NULL come first, so theirs is the first occurrence.
    """
    found = linededup.dedup_lines(docs, min_words=50)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col("n_cut") > 0, length).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: that with the smallest id (NULL ids last, then the text's hash).

    Of rows equal in id and text the first in the order of all columns stays. Texts without words are one component.
    """
    return simhash.keep_first(docs, shingle=3, seed=42, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with or without an id of its own.

    Null, empty and short texts hold none and stay.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens.

    Null and empty texts are one piece of the end token. Pieces of one length are interchangeable.
    """
    found = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return found.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Hashed n-grams, SimHash and tokens have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

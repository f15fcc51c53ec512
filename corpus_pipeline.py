"""A corpus pipeline: quality rules, quality classifier, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapelab.llm import jaccard, packing, quality, substrings
from tapelab.llm.common import bounded, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the monotone model. Null, empty and short texts go; ties and repeats share their verdict."""
    model = quality.rules_model(docs, table(spark, sf_dir, "labels"))
    return quality.filter_rows(docs, model, quality.passes_rules)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores at its threshold or above. Null texts are scored as empty ones; repeats share their verdict."""
    model = quality.classifier(docs, table(spark, sf_dir, "labels"))
    return quality.filter_rows(docs, model, quality.passes_classifier)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the least doc_id. Rows without words all stay; of rows that repeat one stays."""
    return jaccard.keep_one(bounded(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words in a window that stands elsewhere too are cut out of their texts. Null and short texts stay as they are."""
    return substrings.remove_repeats(bounded(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. A null text is the end id alone; rows that repeat are packed each; no rows give no pieces."""
    return packing.pack(bounded(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("packing", pack),
]

#: The fitted models and the tokenizer are beyond SQL; a test compares each stage's rows with a plain Python version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

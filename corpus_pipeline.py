"""The corpus pipeline: five stages from ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``.

Stages decide by ``doc_id``: rows without one are dropped by the first stage, a
null text counts as empty, empty tables give empty tables, and further columns of
the input are carried along by the stages that only choose rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tallywarden
from tallywarden.llm.common import stored
from tallywarden.llm.decontaminate import without_contaminated
from tallywarden.llm.jaccard import similar_documents
from tallywarden.llm.packing import packed, tokenized_pieces
from tallywarden.llm.quality import quality_scores
from tallywarden.llm.suffixes import without_repeats

cloudpickle.register_pickle_by_value(tallywarden)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality_scores(docs, labels).filter("predicted = 1").select("doc_id")
    return docs.join(good, "doc_id", "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one of smallest id stays."""
    first = similar_documents(docs).filter("doc_id = component_id").select("doc_id")
    return docs.join(first, "doc_id", "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings seen before go. Where a cut splits a character, what is left
    of the character goes as well; ``n_chars`` is counted anew."""
    kept = without_repeats(docs).select("doc_id", F.col("kept").cast("string").alias("__kept"))
    # The other columns are joined without the texts, which come from the result;
    # repeated rows of a document come back as often as they were.
    rest = docs.drop("text", "n_chars").dropDuplicates(["doc_id"])
    whole = F.regexp_replace(F.make_valid_utf8("__kept"), "\ufffd", "")
    text = F.when(F.is_valid_utf8("__kept"), F.col("__kept")).otherwise(whole)
    out = kept.join(rest, "doc_id").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of up to 2048 tokens."""
    return packed(tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", sequences),
]
# SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

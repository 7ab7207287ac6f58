"""Documents through five stages: judged, freed of repeated lines and near copies, decontaminated, packed.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows it is given and returns a frame; all but
the last keep the columns of ``documents``. ``run`` writes what a stage keeps and reads it for the
next, so a stage may scan its input as often as it likes and lost executors cost one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import decontaminate, line_dedup, ngram_join, packing, quality
from wardline.llm.common import Scratch
from wardline.llm.queries import HEADS, PACK_TOKENIZER, public_file, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither of low quality nor toxic, judged with the labels at hand."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"), HEADS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated_documents(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_file(PACK_TOKENIZER)).drop("_rid")


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed_sequences),
]

# SQL has neither the classifier nor the tokenizer; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{number}")
    return STAGES[-1][1](spark, docs, sf_dir)

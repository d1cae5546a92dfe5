"""The corpus pipeline: five stages over documents, each by one of the operators in pactlake.llm.

Every stage takes what its predecessor kept, decides on whole texts, and returns the documents that stay with all their
columns; the last one returns the packed pieces.

Defined cases, in every stage: null text counts as empty; texts of any length are read whole; a null id never keeps a document
from being judged; further columns are carried along to the last stage, whatever their names; no rows give no rows. An
empty text is scored like any other, and of several one stays. Equal texts and repeated rows are judged alike by quality; exact
dedup keeps one of them, by the largest id, ties by the other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactlake.llm import exact_dedup, mixing, near_dup, packing, quality
from pactlake.llm.common import bounded_batches, release, settle, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go; without labels of both classes all have one score and stay if it is accepted."""
    return quality.keep(docs, quality.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays: of two that are linked and verified, one goes; ties are settled by text hash."""
    return near_dup.survivors(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that domains meet their target weights; rows repeated with one id and text alike."""
    return mixing.mixed(docs, mixing.domains_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; an empty text is one separator, copies are packed each."""
    bounded_batches(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: SQL can't express the classifiers, SimHash or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage has settled on the way is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = settled()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        release(spark, [folder for folder in settled()[:-1] if folder not in others])
    return STAGES[-1][1](spark, docs, sf_dir)

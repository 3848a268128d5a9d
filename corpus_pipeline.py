"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing. Every stage works on all its predecessor
kept, which is written as Parquet and read again; all but the last return the columns of documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm.common import discard, materialize, release, scratch, table
from arborlens.llm.mixing import mixed_rows
from arborlens.llm.ngram_join import jaccard_join
from arborlens.llm.packing import pack_documents
from arborlens.llm.quality import keep_quality
from arborlens.llm.toxicity import keep_clean


def lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with the driver's garbage, such as plans of the stage before and what a model was fitted on, given back before and after."""

    @functools.wraps(stage)
    def run(*args: object) -> DataFrame:
        release()
        out = stage(*args)
        release()
        return out

    return run


@lean
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


@lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


@lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays, that of least doc_id (rows without id last). Rows are compared as rows,
    whether their ids repeat or are missing; texts without words link with nothing and stay."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), codec="zstd")
    linked = jaccard_join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "_row")
    first = linked.join(rows.select("_row", place.alias("_place")), "_row").groupBy("_group").agg(F.min("_place").alias("_place")).select("_place._row")
    return rows.join(first, "_row", "left_semi").select(*docs.columns)


@lean
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


@lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixing), ("best-fit packing", packing)]

#: Fitted models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before = docs
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), stays=True)
        discard(before)
    return docs

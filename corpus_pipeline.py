"""A corpus pipeline: quality rules, near-duplicate removal, removal of repeated passages, decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of the
documents table; a null text counts as empty, repeated rows are near duplicates of each other, ties (equal similarity, equal
length) go to the smaller id, and empty tables stay empty. Every stage reads all rows and whole texts.

When a stage begins, its predecessor's rows are written, so the tables that the predecessor needed on the way are deleted."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from showerframe.llm import decontaminate, near_dedup, packing, quality, suffix_array
from showerframe.llm.common import collecting, scratch, table

#: Application, stage and scratch tables of the stage that began last.
_last: tuple[str, str, list] = ("", "", [])


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _last
        here = spark.sparkContext.applicationId
        app, name, opened = _last
        if (app, name) != (here, work.__name__):
            for ws in opened if app == here else ():
                ws.close()
            opened = []
        with collecting() as new:
            out = work(spark, docs, sf_dir)
        _last = (here, work.__name__, [*opened, *new])
        return out
    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trained classifier reject go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on five-word shingles, the document with the smallest id stays."""
    return near_dedup.keep_one(docs, width=5, num=4, den=5)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of over 50 words or at least 400 bytes go: stretches in which every 100-byte string also starts
    elsewhere. All documents stay, some with a shorter text."""
    return suffix_array.remove_repeats(docs, rule=suffix_array.PASSAGES)


@_stage
def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, re-parameterised or not, go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", benchmark_items), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    ws = scratch(spark)
    for _, stage in STAGES:
        before, docs = docs, ws.save(stage(spark, docs, sf_dir), "stage")
        ws.release(before)
    return docs


#: The stages learn models, hash and tokenize, which SQL cannot express; tests hold them against plain versions.
ORACLE_SQL = None

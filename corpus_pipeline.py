"""A corpus pipeline over ``documents``: quality, line dedup, near copies, benchmark passages, mix.

``STAGES`` lists (name, function); each function takes (spark, docs, folder) and returns a
DataFrame, which is written as Parquet and read again as the documents of the next one. All but
the last return the columns of ``documents``. When a stage starts, the one before has been
written, so the tables that it kept for itself are removed; those of other results stay.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import keeping_for, release, table
from tracelake.llm.decontaminate import without_contaminated
from tracelake.llm.lines import remove_repeated_lines
from tracelake.llm.mixing import mix
from tracelake.llm.quality import of_quality
from tracelake.llm.simhash import one_of_each_group
from tracelake.session import folder_of, shared_folder


def _stage(work):
    """Runs after the stage before has been written: its tables go, and this one's are kept for the next to remove."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        release(spark, __name__)
        with keeping_for(__name__):
            return work(spark, docs, folder)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return of_quality(docs, table(spark, folder, "labels"))


@_stage
def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The same documents without lines that repeat an earlier one."""
    shorter = remove_repeated_lines(docs)
    return shorter.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


@_stage
def benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_contaminated(docs, table(spark, folder, "benchmark"))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words that the mix takes from each document."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing", mixed),
]

ORACLE_SQL = None  # a trained classifier and fingerprints by XXH64 are beyond SQL; see tests/llm


def run(spark: SparkSession, folder: str) -> DataFrame:
    """Apply all stages to ``documents`` and return the last one's rows."""
    docs = table(spark, folder, "documents")
    root = f"{shared_folder(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    files, place = folder_of(spark, root)
    files.deleteOnExit(place)
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{root}/{number}")
        docs = spark.read.parquet(f"{root}/{number}")
    return STAGES[-1][1](spark, docs, folder)

"""The corpus pipeline: five stages over documents, each over all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them
to the table documents, with each stage written to shared storage and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import decontaminate, line_dedup, near_dedup, quality, source_mix
from wirelens.llm.common import Work, read_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it is fitted on labelled rows of docs."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(quality.scorer(model)("text") >= quality.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of two lines or more from the texts, by chunks that a rolling hash bounds and then by line
    pairs where its boundaries miss some; sets n_chars anew; every document stays."""
    cut = line_dedup.dedup_passages(docs, Work(spark))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, the one with the smallest doc_id, of each group of near copies."""
    return near_dedup.without_copies(docs, Work(spark)).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return source_mix.mix(docs, Work(spark))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source mix", mix_sources),
]

#: The classifier and the searches aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark)
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = work.save(docs, name.replace(" ", "-"))
    return docs

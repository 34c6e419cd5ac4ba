"""The corpus pipeline: five stages, each on what the one before has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.llm.common import ensure_checkpoint_dir, read, remove, tables_kept
from hydrolith.llm.decontaminate import decontaminate
from hydrolith.llm.line_dedup import deduplicate_lines
from hydrolith.llm.mixing import mix
from hydrolith.llm.near_copies import deduplicate_similar
from hydrolith.llm.quality import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words from which on a line that repeats goes by itself.
LONG_LINE = 50
#: Tables that stages have kept and that nobody has removed yet.
_kept: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage that first removes what stages before it have kept, but for tables that docs still reads.

    What a stage returns must have been written before the next one is called, as ``run`` does.
    """

    @wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        for path in [p for p in _kept if not any(p.rsplit("/", 1)[1] in f for f in files)]:
            remove(spark, path)
            _kept.remove(path)
        with tables_kept() as paths:
            found = stage(spark, docs, sf_dir)
        _kept.extend(paths)
        return found

    return tidied


@tidy
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


@tidy
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines, and of single lines of LONG_LINE words, go; n_chars follows the text."""
    found = deduplicate_lines(docs, long=LONG_LINE)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


@tidy
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays."""
    return deduplicate_similar(docs)


@tidy
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


@tidy
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: The classifier and the fingerprints have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet to the checkpoint folder and read again.

    What a stage returned is removed once the next one is written; the last table stays for its reader.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = read(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return docs

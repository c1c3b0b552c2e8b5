"""From raw documents to packed token files: quality, near-duplicates, benchmark, mixture, tokens.

Each stage takes the documents that the one before it kept, and reads the other tables from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions.lineage import discard, new_folder, written
from tallyspark.llm.decontamination import decontaminate
from tallyspark.llm.mixing import mix
from tallyspark.llm.near_dedup import drop_near_duplicates
from tallyspark.llm.quality import keep_good
from tallyspark.llm.token_output import read_tokens, write_tokens


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on labels that aren't held out, scores 0.7 or more."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every near-duplicate class."""
    return drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mixture of sources takes."""
    return mix(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's place, length and checksum as the packed token files hold it."""
    return read_tokens(spark, write_tokens(docs, new_folder(spark, "pipeline-tokens")))


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", packed_tokens),
]

ORACLE_SQL = None  # tokens and alignment aren't SQL's; a test holds every stage and the result against plain loops


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each result but the last is written and read again.

    A stage's files are deleted once the next stage's are written.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

"""Merging batches into a table that lies in buckets of its keys, touching only the buckets that a batch has keys in.

A bucket is a partition folder of plain Parquet. A merge reads the folders of the batch's buckets alone, writes the merged
rows to a staging folder, checks them as they can be read there, and only then replaces those folders. Whatever fails
before leaves the table as it was, and folders that aren't touched keep their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.lineage import discard, written
from tallyspark.operators.ledger import supersede
from tallyspark.operators.picks import upsert

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """The bucket of a key; null is a key like others."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A new table in ``buckets`` folders. A bucket should hold about what one task handles well."""
    rows.select("*", bucket_of(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table without its bucket column; ``schema`` names its columns and types."""
    return spark.read.schema(schema).parquet(path).drop(BUCKET)


def merge_batch(
    path: str, batch: DataFrame, keys: list[str], buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame], *, check: Callable[[DataFrame, DataFrame], None] | None = None
) -> list[int]:
    """Merge ``batch`` into the table at ``path`` and return the buckets that were rewritten.

    ``merge(standing, batch)`` gives the rows that take the place of the touched buckets' standing ones; a row that it moves
    to a key of another bucket is an error. ``check(standing, merged)`` may raise. An empty batch touches nothing.
    """
    spark, schema = batch.sparkSession, batch.schema
    placed = written(batch.select("*", bucket_of(keys, buckets)), "merge-batch")
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())  # `buckets` numbers at most
    if not touched:
        discard(placed)
        return []
    table = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, {BUCKET} int").parquet(path)
    standing = table.where(F.col(BUCKET).isin(touched)).drop(BUCKET)  # prunes the other folders
    staged = written(merge(standing, placed.drop(BUCKET)).select(*schema.names).select("*", bucket_of(keys, buckets)), "merge-staged")
    strayed = staged.where(~F.col(BUCKET).isin(touched)).limit(1).count()
    if strayed:
        raise ValueError("the merge gives keys of buckets that the batch doesn't touch")
    if check is not None:
        check(standing, staged.drop(BUCKET))
    staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    discard(placed, staged)
    return touched


def unique_keys(keys: list[str]) -> Callable[[DataFrame, DataFrame], None]:
    """A check that no key stands twice after a merge, and that none is lost."""

    def check(standing: DataFrame, merged: DataFrame) -> None:
        counts = merged.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
        if (counts[0] or 0) > 1 or counts[1] < standing.select(*keys).distinct().count():
            raise ValueError("a key is lost or stands twice")

    return check


def upsert_into(path: str, batch: DataFrame, keys: list[str], buckets: int, rank: Column) -> list[int]:
    """``picks.upsert`` into a table in buckets: the batch wins unless the standing row's method ranks above."""
    return merge_batch(path, batch, keys, buckets, lambda standing, rows: upsert(standing, rows, keys, rank), check=unique_keys(keys))


def supersede_into(path: str, batch: DataFrame, document: str, buckets: int) -> list[int]:
    """``ledger.supersede`` into a table in buckets of ``document``: standing rows of the batch's documents are flagged."""

    def check(standing: DataFrame, merged: DataFrame) -> None:
        kept = merged.where("superseded").count()
        if kept > (before := standing.count()):
            raise ValueError(f"{kept} rows are superseded of {before} that stood")

    return merge_batch(path, batch, [document], buckets, lambda standing, rows: supersede(standing, rows.drop("superseded"), document), check=check)

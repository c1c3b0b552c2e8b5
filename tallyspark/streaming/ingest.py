"""Incremental ingest: every landed file is taken once, by its name and by its content.

The stream's checkpoint says which files Spark has seen; the ledger, a table beside the data, says what was taken. So
a file that lands again under another name, a checkpoint that is lost and a batch that is tried again all add nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators.picks import pick_first

LEDGER = "dataset string, file_name string, file_key string, n_rows bigint, n_rejected bigint"


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """What was taken: dataset, file_name, file_key (the content's fingerprint), rows kept and rejected; a row a file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_ledger")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(LEDGER).parquet(f"{out}/_ledger") if there else spark.createDataFrame([], LEDGER)


def fingerprints(rows: DataFrame, columns: list[str], file: str) -> DataFrame:
    """(file, file_key) by the rows a file holds, in whatever order: their number and the sums of two hashes of each."""
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (0, 1)]
    return rows.groupBy(file).agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[s.cast("string") for s in sums]), 256).alias("file_key"))


def ingest_new_files(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: T.StructType, required: list[str], *, dataset: str = "landed") -> None:
    """Validate new all-text CSV files and add them to a Parquet lake partitioned by ``file_key`` and ``fy``; then stop.

    A file is taken unless the ledger has its name or its content in the ``dataset``; of files of one content in a batch the
    first by name is. Its rows are partitions of its own and replace them, and the ledger's row is written after them, so
    a batch that breaks off anywhere is made good by the next call. A file whose header isn't the schema's stops the
    batch. A row with a blank required column goes to ``out/_rejected`` and stops nothing. Read the lake with
    ``read_ingested``.
    """
    bad = F.lit(False)
    for column in required:
        bad = bad | (F.coalesce(F.trim(F.col(column)), F.lit("")) == "")

    def write(batch: DataFrame, _: int) -> None:
        known = read_ledger(batch.sparkSession, out).where(F.col("dataset") == dataset)
        rows = batch.persist()
        landed = fingerprints(rows, schema.names, "file_name")
        unknown = landed.join(known.select("file_name"), "file_name", "left_anti").join(known.select("file_key"), "file_key", "left_anti")
        taken = pick_first(unknown, ["file_key"], [F.asc("file_name")]).persist()
        if not taken.isEmpty():
            flagged = rows.join(taken, "file_name").withColumn("is_bad", bad)
            for kept, folder in ((flagged.where(~F.col("is_bad")), "data"), (flagged.where("is_bad"), "_rejected")):
                writer = kept.drop("is_bad", "file_name").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
                writer.partitionBy("file_key", "fy").parquet(f"{out}/{folder}")
            counted = flagged.groupBy(F.lit(dataset).alias("dataset"), "file_name", "file_key").agg(F.count(F.when(~F.col("is_bad"), 1)).alias("n_rows"), F.count(F.when(F.col("is_bad"), 1)).alias("n_rejected"))
            counted.coalesce(1).write.mode("append").parquet(f"{out}/_ledger")  # a row a file
        taken.unpersist()
        rows.unpersist()

    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    stream = spark.readStream.schema(schema).option("header", True).option("enforceSchema", False).csv(landing).select("*", name.alias("file_name"))
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_ingested(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows of the files that the ledger has, with the columns of ``schema``."""
    stored = T.StructType([*schema.fields, T.StructField("file_key", T.StringType())])
    return spark.read.schema(stored).parquet(f"{out}/data").join(read_ledger(spark, out).select("file_key"), "file_key", "left_semi").select(*schema.names)

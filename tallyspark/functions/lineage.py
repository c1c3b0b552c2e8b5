"""Cutting a plan's lineage where a result is read more than once or built in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without that setting gets a temporary folder of its own; on a cluster a
    missing setting is an error, since executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
    context.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and go on from reliable checkpoint files, so a lost executor costs no rerun."""
    folder = shared_folder(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a compact, prunable checkpoint."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    result = df.sparkSession.read.schema(df.schema).parquet(path)
    result.written_to = path
    return result


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``written`` that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions_of(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for, which should follow its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

"""Append-only tables, and the intermediate tables that cut long lineages."""
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Append rows to a Parquet table; existing rows are never rewritten."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Save a table bucketed and sorted by its join key.

    Entries and snapshots bucketed alike by ``snapshot_id`` are grouped and
    joined by it without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def _shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``: executors write there, and all of them read it.

    Only a local session, whose one process sees its own folders, may do without.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vitrine-")
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{_shared_folder(spark)}/vitrine-{uuid.uuid4().hex}"


def materialized(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute once, write to shared storage, and go on from the written table.

    Survives the loss of executors, and later readers prune columns; a plain
    checkpoint would compute the rows twice and keep every column.
    """
    path = f"{folder}/vitrine-{uuid.uuid4().hex}" if folder else new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

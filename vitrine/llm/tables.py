"""Shared helpers of the operators: reading tables, and writing intermediate ones."""
from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local session, whose one process sees its own folders, may do without.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vitrine-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vitrine-{uuid.uuid4().hex}"


#: Rows of narrow columns that are sent to all executors at most, some 100 bytes each.
SENT_ROWS = 250_000


def sent(table: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """A narrow written table, marked for broadcast if it has at most ``most`` rows; else left to a shuffled join."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Append-only tables whose appends survive a retry.

A table is a folder of data folders and a manifest. A batch writes its rows to a data
folder of its own, then one manifest row that names the batch, its version and that
folder. Readers follow the manifest: of each batch the newest version counts, so a batch
that is run again replaces its own rows and no others, and rows of a run that failed
before its manifest row was committed are never seen. Nothing written is changed.
"""
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "batch string, version bigint, folder string, n bigint, committed_at timestamp"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each batch: batch, version, folder, n, committed_at; empty where no table is."""
    return _commits(spark, path).groupBy("batch").agg(
        F.max(F.struct("version", "folder", "n", "committed_at")).alias("_c")
    ).select("batch", "_c.*")


def _commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/_commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _stored(df: DataFrame, path: str) -> tuple[str, int]:
    """A new data folder with the rows of ``df``, and their number, which comes from the footers."""
    folder = uuid.uuid4().hex
    df.write.parquet(f"{path}/{folder}")
    return folder, df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}").count()


def _commit(spark: SparkSession, path: str, contents: dict[str, tuple[str, int]]) -> dict[str, int]:
    """One file with a manifest row per batch: readers see all of them or none."""
    known = dict(_commits(spark, path).where(F.col("batch").isin(*contents)).groupBy("batch").agg(F.max("version")).collect())
    versions = {batch: known.get(batch, 0) + 1 for batch in contents}
    rows = [(batch, versions[batch], *stored) for batch, stored in contents.items()]
    new = spark.createDataFrame(rows, "batch string, version bigint, folder string, n bigint").coalesce(1)
    new.withColumn("committed_at", F.current_timestamp()).write.mode("append").parquet(f"{path}/_commits")
    return versions


def append_batch(df: DataFrame, path: str, batch: str) -> int:
    """Add the rows of ``df`` as ``batch``; a batch of that name added before is replaced. Returns its version.

    Two runs of one batch at once may both commit; they hold the same batch, and readers
    take one of them, as a whole.
    """
    return _commit(df.sparkSession, path, {batch: _stored(df, path)})[batch]


def read_batches(spark: SparkSession, path: str, schema: StructType | str, batches: Iterable[str] | None = None, name: str | None = None) -> DataFrame:
    """All rows of a table, or of the given batches only; ``name`` adds a column with their batch.

    Columns that older batches lack are null. The list of folders, one per batch, is read
    by the driver, as the names of files are; ``compact`` keeps it short.
    """
    current = manifest(spark, path)
    if batches is not None:
        current = current.where(F.col("batch").isin(*batches))
    rows = current.where("n > 0").select("batch", "folder").orderBy("batch").collect()
    if not rows:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(name, F.lit(None).cast("string")) if name else empty
    table = spark.read.schema(schema).parquet(*(f"{path}/{r['folder']}" for r in rows))
    if not name:
        return table
    names = spark.createDataFrame(rows).select(F.col("batch").alias(name), F.col("folder").alias("_folder"))
    located = table.withColumn("_in", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return located.join(F.broadcast(names), F.col("_in") == F.col("_folder")).select(*table.columns, name)


def compact(spark: SparkSession, path: str, schema: StructType | str, batches: Iterable[str], into: str) -> int:
    """Put the rows of ``batches`` into one batch ``into``, which is new or one of them. Returns the number of rows.

    Old batches are emptied and the new one is filled by one commit, so readers see every
    row once at any time, and a run that fails leaves all as it was.
    """
    batches = set(batches)
    known = manifest(spark, path).where((F.col("batch") == into) & (F.col("n") > 0))
    if into not in batches and not known.isEmpty():
        raise ValueError(f"batch {into!r} holds rows of its own")
    stored = _stored(read_batches(spark, path, schema, batches), path)
    _commit(spark, path, {b: ("", 0) for b in batches} | {into: stored})
    return stored[1]


def superseded(spark: SparkSession, path: str) -> DataFrame:
    """Folders of older versions, which no reader follows any more: batch, version, folder."""
    newest = manifest(spark, path).select("batch", F.col("folder").alias("_kept"))
    return _commits(spark, path).join(newest, "batch").where("folder <> _kept").select("batch", "version", "folder")

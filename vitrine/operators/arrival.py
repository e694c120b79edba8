"""Numbers in the order of arrival, and places within groups, counted without one task.

Sorted ranges number their own rows; the counts of the ranges, one row each, become
offsets by running sums. Neither a table nor a group passes through one task, so a
group may hold most of the rows.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.sources.tables import materialized

#: ``monotonically_increasing_id`` keeps the partition above this bit.
_SHIFT = 33
_BEFORE = (Window.unboundedPreceding, -1)


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in sorted ranges, written, with ``_range`` and ``_i``, their place in it.

    Ranges are drawn anew by every run of a plan, so they are written before they are counted.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    kept = materialized(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return kept.select(
        *df.columns, F.shiftright("_id", _SHIFT).alias("_range"), F.col("_id").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("_i"),
    )


def with_sequence(df: DataFrame, *order: Column | str, name: str = "sequence", start: Column | int = 1) -> DataFrame:
    """Dense numbers from ``start`` on in the given order; equal rows get different numbers.

    Rows that are equal in ``order`` follow each other in no stated order. Nulls come
    first. An empty table stays empty. Without an order rows are numbered as they are
    read: partition by partition, nothing is sorted or shuffled.
    """
    ranged = _ranged(df, [F.col(o) if isinstance(o, str) else o for o in order])
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_offset"))
    first = F.lit(start) if isinstance(start, int) else start
    return ranged.join(offsets, "_range").select(*df.columns, (F.col("_offset") + F.col("_i") + first).alias(name))


def with_place(df: DataFrame, group: str, *order: Column | str, name: str = "place") -> DataFrame:
    """Each row's place, from 1 on, within its ``group`` (null is one) in the given order.

    What is known of a group reaches its rows by (range, group), so a group that fills
    many ranges stays in many tasks.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = _ranged(df, [F.col(group), *keys])
    runs = ranged.groupBy("_range", F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(*_BEFORE)
    runs = runs.select(
        F.col("_range").alias("_r"), "_group", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    joined = ranged.join(runs, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.select(*df.columns, (F.col("_i") + F.col("_shift")).alias(name))


def located(lines: DataFrame) -> DataFrame:
    """``value`` of a text read, batch or stream, with where it lies: file, its time, and the start of its split."""
    return lines.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_block_start").alias("_start"),
    )


def file_lines(lines: DataFrame) -> DataFrame:
    """``value, file, modified, line`` of ``located`` lines: dense numbers, from 1 on, by file and place in it.

    Every split of a file is read in order by one task; the numbers of its rows are shifted
    by what stands before it, in its file and in files of earlier names. Lines that are
    equal get different numbers, and the same files give the same numbers again. Nothing
    is sorted or shuffled but one row per split.
    """
    read = materialized(lines.withColumn("_id", F.monotonically_increasing_id()))
    splits = read.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("file", "_start").rowsBetween(*_BEFORE))
    shifts = splits.select("file", "_start", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return read.join(shifts, ["file", "_start"]).select("value", "file", "modified", (F.col("_id") + F.col("_shift")).alias("line"))

"""What the names and sizes of a listing suggest. Never part of the verdict."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.matching import hit_categories
from vitrine.operators.features import hit_counters, hit_struct, hits_long, snapshot_profiles


def interest_counts(entries: DataFrame) -> DataFrame:
    """Matching entries per snapshot and category; only categories with hits."""
    return hits_long(snapshot_profiles(entries), "interest_hits").filter("n > 0").drop("family")


def interest_examples(entries: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` names per snapshot and category, for local triage only.

    Names can be personal data: reports use the counts.
    """
    hits = entries.select(
        "snapshot_id", "pos", "name", F.explode(hit_categories(F.col("name"), P.INTEREST)).alias("category")
    )
    order = Window.partitionBy("snapshot_id", "category").orderBy("pos")
    first = hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    listed = F.array_sort(F.collect_list(F.struct("place", "name")))
    return first.groupBy("snapshot_id", "category").agg(
        F.transform(listed, lambda e: e["name"]).alias("examples")
    )


def _size_aggregates():
    is_file = ~F.coalesce(F.col("is_dir"), F.lit(False))
    size = F.when(is_file, F.col("size"))
    return [
        (F.count(size) > 0).alias("has_sizes"),
        F.count_if(is_file).alias("file_count"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.max(F.when(size.isNotNull(), F.struct(size.alias("size"), F.col("name")))).alias("_largest"),
        F.count_if(size >= P.BIG_FILE_BYTES).alias("files_over_100mb"),
    ]


def _with_largest(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "largest_bytes": F.coalesce(F.col("_largest.size"), F.lit(0)),
            "largest_name": F.coalesce(F.col("_largest.name"), F.lit("")),
        }
    ).drop("_largest")


def size_stats(entries: DataFrame) -> DataFrame:
    """Known sizes, total and largest file per snapshot (files only)."""
    return _with_largest(entries.groupBy("snapshot_id").agg(*_size_aggregates()))


def inventory(entries: DataFrame) -> DataFrame:
    """Interest counts and size statistics of each snapshot in one grouping."""
    grouped = entries.groupBy("snapshot_id").agg(
        *_size_aggregates(), *hit_counters(F.col("name"), "interest_hits")
    )
    plain = [c for c in grouped.columns if ":" not in c]
    return _with_largest(grouped.select(*plain, hit_struct("interest_hits")))

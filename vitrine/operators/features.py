"""Per-snapshot features from listing entries.

Entries are a flat table (``snapshot_id, pos, name, is_dir, size, mtime``), so a
listing of any length is aggregated with map-side partial sums and never has to
fit in one row or one task. Each counter is a fixed-width sum, which keeps the
grouping a hash aggregation; consumers that read only some counters get only
those computed, since unused aggregates are pruned.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.matching import category_tests

HITS = {
    "sensitive_hits": P.SENSITIVE,
    "payload_hits": P.PAYLOAD,
    "interest_hits": P.INTEREST,
    "bait_hits": P.BAIT,
}


def ext_col(name: Column) -> Column:
    """Short lower-case extension of a name; empty if it has none."""
    return F.regexp_extract(F.lower(name), P.EXT_PATTERN, 1)


def hit_counters(name: Column, column: str, keep: Column | None = None) -> list[Column]:
    """Counting aggregates of one dictionary, named ``<column>:<category>``."""
    return [counter.alias(key) for key, counter in _hit_counters(name, column, keep).items()]


def _hit_counters(name: Column, column: str, keep: Column | None = None) -> dict[str, Column]:
    return {
        f"{column}:{category}": F.count_if(test if keep is None else keep & test)
        for category, test in category_tests(name, HITS[column]).items()
    }


def hit_struct(column: str) -> Column:
    """The counters of one dictionary gathered in a struct."""
    return F.struct(
        *[F.col(f"`{column}:{c}`").alias(c) for c in HITS[column]]
    ).alias(column)


def snapshot_profiles(entries: DataFrame, *carry: str, exts: int | None = None) -> DataFrame:
    """Everything the verdict and the reports need to know about each listing.

    One pass over the entries, one row per snapshot that has any. With ``exts`` each row
    also has ``top_exts``, the ``exts`` most frequent file extensions (``ext, n``; by
    count, then name): entries are first counted by snapshot and extension, with partial
    sums in the map tasks, and one exchange by snapshot then serves both the ranking of
    extensions and the sums of the counts, so no list longer than ``exts`` is built.
    """
    name, size = F.col("name"), F.col("size")
    is_file = ~F.coalesce(F.col("is_dir"), F.lit(False))
    counters = {
        "entry_count": F.count(F.lit(1)),
        "file_count": F.count_if(is_file),
        "mirror_files": F.count_if(is_file & ext_col(name).isin(P.MIRROR_EXTS)),
        "known_sizes": F.count_if(is_file & size.isNotNull()),
        "total_bytes": F.coalesce(F.sum(F.when(is_file, size)), F.lit(0)),
        "files_over_100mb": F.count_if(is_file & (size >= P.BIG_FILE_BYTES)),
        "dated_or_sized": F.count_if(is_file & (size.isNotNull() | (F.col("mtime") != ""))),
        **_hit_counters(name, "sensitive_hits"),
        **_hit_counters(name, "payload_hits"),
        **_hit_counters(name, "interest_hits"),
        **_hit_counters(name, "bait_hits", is_file),
    }
    aliased = [c.alias(n) for n, c in counters.items()]
    if exts is None:
        grouped = entries.groupBy("snapshot_id", *carry).agg(*aliased)
    else:
        by_ext = entries.groupBy("snapshot_id", *carry, F.when(is_file, ext_col(name)).alias("_ext")).agg(*aliased)
        named = F.coalesce("_ext", F.lit("")) != ""
        order = Window.partitionBy("snapshot_id", *carry).orderBy(F.desc(named), F.desc("file_count"), "_ext")
        ranked = by_ext.withColumn("_place", F.row_number().over(order))
        # at most ``exts`` structs a listing: the others are null and not collected
        listed = F.when(named & (F.col("_place") <= exts), F.struct("_place", F.col("_ext").alias("ext"), F.col("file_count").alias("n")))
        top = F.transform(F.array_sort(F.collect_list(listed)), lambda x: F.struct(x["ext"].alias("ext"), x["n"].alias("n")))
        grouped = ranked.groupBy("snapshot_id", *carry).agg(*[F.sum(f"`{n}`").alias(n) for n in counters], top.alias("top_exts"))
    return grouped.select(
        "snapshot_id",
        *carry,
        "entry_count",
        "file_count",
        (F.col("entry_count") - F.col("file_count")).alias("dir_count"),
        "mirror_files",
        "known_sizes",
        "total_bytes",
        "files_over_100mb",
        (F.col("dated_or_sized") > 0).alias("has_meta"),
        *[hit_struct(column) for column in HITS],
        *(["top_exts"] if exts is not None else []),
    )


def _filled(column: str) -> Column:
    return F.struct(
        *[F.coalesce(F.col(column)[c], F.lit(0)).alias(c) for c in HITS[column]]
    ).alias(column)


def extract_features(snapshots: DataFrame, entries: DataFrame, exts: int | None = P.TOP_EXTS) -> DataFrame:
    """Features of every snapshot, straight from its entries."""
    return features_of(snapshots, snapshot_profiles(entries, exts=exts))


def features_of(snapshots: DataFrame, profiles: DataFrame) -> DataFrame:
    """Features of every snapshot; an empty listing has zeros.

    ``snapshots`` keeps its own columns; ``tls`` is optional. Both sides are
    partitioned by ``snapshot_id``, so the join adds no shuffle to the grouping.
    """
    joined = snapshots.join(profiles, "snapshot_id", "left")
    numbers = [
        "entry_count", "file_count", "dir_count", "mirror_files",
        "known_sizes", "total_bytes", "files_over_100mb",
    ]
    signed = F.col("tls")["self_signed"] if "tls" in snapshots.columns else F.lit(None).cast("boolean")
    return joined.select(
        *snapshots.columns,
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in numbers],
        F.coalesce("has_meta", F.lit(False)).alias("has_meta"),
        *[_filled(column) for column in HITS],
        mirror_ratio_col(
            F.coalesce("mirror_files", F.lit(0)), F.coalesce("file_count", F.lit(0))
        ).alias("mirror_ratio"),
        cert_flag_col(signed).alias("cert_self_signed"),
        *([F.coalesce("top_exts", F.array()).alias("top_exts")] if "top_exts" in profiles.columns else []),
    )


def mirror_ratio_col(mirror_files: Column, file_count: Column) -> Column:
    """Share of files that are distribution artifacts."""
    return mirror_files / F.greatest(file_count, F.lit(1))


def cert_flag_col(self_signed: Column) -> Column:
    """No certificate counts as not self-signed."""
    return F.coalesce(self_signed, F.lit(False))


def top_exts(entries: DataFrame, k: int = P.TOP_EXTS) -> DataFrame:
    """The ``k`` most frequent file extensions per snapshot, by count then name.

    Long form (``snapshot_id, place, ext, n``). The filter sits on the window,
    so each map task sends at most ``k`` rows per snapshot.
    """
    files = entries.filter(~F.col("is_dir")).select("snapshot_id", ext_col(F.col("name")).alias("ext"))
    counts = files.filter(F.col("ext") != "").groupBy("snapshot_id", "ext").agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("snapshot_id").orderBy(F.desc("n"), "ext")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hits_long(profiles: DataFrame, *columns: str) -> DataFrame:
    """Unpivot hit structs to (``snapshot_id, family, category, n``), zeros kept."""
    rows = [
        F.struct(
            F.lit(column.removesuffix("_hits")).alias("family"),
            F.lit(category).alias("category"),
            F.col(column)[category].alias("n"),
        )
        for column in columns
        for category in HITS[column]
    ]
    return profiles.select("snapshot_id", F.explode(F.array(*rows)).alias("hit")).select(
        "snapshot_id", "hit.*"
    )

"""The newest view of the corpus: latest open directories with their verdict."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.urls import split_url


def latest_open(snapshots: DataFrame, *carry: str) -> DataFrame:
    """The newest open-directory snapshot of each candidate.

    A later snapshot that is not a listing does not hide it. ``first_open_at``
    and ``first_open_id`` tell when the candidate was first seen open. Carry only
    narrow columns; join wide ones back by ``snapshot_id``.
    """
    seen = F.struct("fetched_at", "snapshot_id")
    newest = F.max_by(F.struct("snapshot_id", "fetched_at", *carry), seen)
    grouped = snapshots.filter("is_open_dir").groupBy("candidate_id").agg(
        newest.alias("_s"), F.min(seen).alias("_first")
    )
    return grouped.select(
        "candidate_id", "_s.*",
        F.col("_first.fetched_at").alias("first_open_at"),
        F.col("_first.snapshot_id").alias("first_open_id"),
    )


def merged_latest(state: DataFrame, batch: DataFrame, *carry: str) -> DataFrame:
    """``latest_open`` of all snapshots, from its stored result and the new ones only.

    ``state`` is the result of ``latest_open`` (or of this) with the same ``carry``. Newest
    and first are a maximum and a minimum, so a candidate's row and the rows of its new
    snapshots merge by key in any order; a snapshot that comes twice changes nothing.
    """
    seen = F.struct("fetched_at", "snapshot_id")
    new = latest_open(batch, *carry)
    columns = ["candidate_id", "snapshot_id", "fetched_at", *carry, "first_open_at", "first_open_id"]
    both = state.select(*columns).unionByName(new.select(*columns))
    first = F.min(F.struct("first_open_at", "first_open_id")).alias("_first")
    merged = both.groupBy("candidate_id").agg(F.max_by(F.struct("snapshot_id", "fetched_at", *carry), seen).alias("_s"), first)
    return merged.select("candidate_id", "_s.*", "_first.*")


def newest_classification(
    latest: DataFrame, classifications: DataFrame, *carry: str, ruleset_version: str | None = None, label: bool = True
) -> DataFrame:
    """Latest snapshots with the newest verdict on them (of one ruleset, if given), its ``label`` if asked for.

    Snapshots without a verdict are left out. The join comes first: it drops the
    history of older snapshots before anything is grouped.
    """
    rows = classifications
    if ruleset_version is not None:
        rows = rows.filter(F.col("ruleset_version") == ruleset_version)
    found = ["label"] * label + [*carry]
    verdicts = rows.select("snapshot_id", "ruleset_version", "classified_at", *found).join(
        latest.select("snapshot_id"), "snapshot_id"
    )
    newest = verdicts.groupBy("snapshot_id").agg(
        F.max_by(F.struct(*found), F.struct("classified_at", F.transform(F.split("ruleset_version", r"\."), lambda x: x.try_cast("int")))).alias("_v")
    )
    return latest.join(newest, "snapshot_id").select(*latest.columns, "_v.*")


def directory_records(
    latest: DataFrame, classifications: DataFrame, candidates: DataFrame, profiles: DataFrame
) -> DataFrame:
    """One row per latest directory with a verdict: what the host rollups read.

    The host is that of the candidate URL, not of the final URL after redirects; it is
    null where the URL has none, and each rollup chooses what that means.
    """
    places = candidates.withColumn("_u", split_url(F.col("url"))).select(
        "candidate_id", "url",
        F.col("_u.host").alias("host"), F.col("_u.port").alias("port"),
    )
    stored = classifications.select(
        "snapshot_id", "label", "ruleset_version", "classified_at",
        F.col("features.sensitive_hits").alias("sensitive_hits"),
        F.col("features.payload_hits").alias("payload_hits"),
    )
    judged = newest_classification(latest, stored, "sensitive_hits", "payload_hits")
    mined = profiles.select(
        "snapshot_id", "interest_hits", "bait_hits", "known_sizes", "total_bytes",
        "files_over_100mb", "has_meta", "file_count",
    )
    return (
        judged.join(mined, "snapshot_id", "left")
        .join(places, "candidate_id")
        .withColumns(
            {
                "file_count": F.coalesce("file_count", F.lit(0)),
                "has_meta": F.coalesce("has_meta", F.lit(False)),
            }
        )
    )

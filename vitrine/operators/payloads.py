"""Selecting files that may be hashed, and the state of their hashes and reports."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import patterns as P
from vitrine.functions.binding import let
from vitrine.functions.files import is_payload
from vitrine.functions.urls import directory_url, is_plain_name, resolved_path, resolved_url, split_url
from vitrine.operators.arrival import with_sequence


def select_payloads(
    entries: DataFrame, urls: DataFrame, max_files: int | None = None
) -> DataFrame:
    """The allowlisted files of each snapshot (the first ``max_files``, if given), with absolute URLs.

    ``urls`` gives the candidate URL of each snapshot (``snapshot_id, url``).
    """
    href = F.col("href") if "href" in entries.columns else F.lit(None).cast("string")
    files = entries.filter(~F.col("is_dir") & is_payload(F.col("name"))).select(
        "snapshot_id", "pos", "name", href.alias("href")
    )
    if max_files is not None:
        order = Window.partitionBy("snapshot_id").orderBy("pos")
        files = files.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_files)
    joined = files.join(urls.select("snapshot_id", F.col("url").alias("_base_url")), "snapshot_id").withColumn(
        "_text", F.coalesce(F.nullif(F.col("href"), F.lit("")), F.col("name"))
    )
    # a plain name follows the directory of the page; only other references are split
    plain = is_plain_name(F.col("_text"))
    whole = let(
        F.struct(split_url(F.col("_base_url")).alias("base"), split_url(F.col("_text")).alias("ref")),
        lambda u: resolved_url(u["base"], u["ref"], resolved_path(u["base"], u["ref"])),
    )
    url = F.when(plain, F.concat(let(split_url(F.col("_base_url")), directory_url), F.col("_text"))).otherwise(whole)
    return joined.select("snapshot_id", "pos", "name", url.alias("url"))


def hash_pending(
    snapshots: DataFrame,
    classifications: DataFrame,
    hashes: DataFrame,
    labels=("sensitive_exposure", "malicious_staging"),
    limit: int | None = None,
) -> DataFrame:
    """Flagged open directories none of whose files has been hashed yet."""
    flagged = classifications.filter(
        (F.col("ruleset_version") == P.RULESET_VERSION) & F.col("label").isin(*labels)
    ).select("snapshot_id")
    pending = (
        snapshots.filter("is_open_dir")
        .join(flagged, "snapshot_id", "left_semi")
        .join(hashes.select("snapshot_id"), "snapshot_id", "left_anti")
    )
    return pending if limit is None else pending.orderBy("snapshot_id").limit(limit)


def load_hashes(
    results: DataFrame, selected: DataFrame, hashed_at: Column | None = None, order: tuple[str, ...] = (), above: int = 0
) -> DataFrame:
    """Hash results to ``payload_hashes`` rows, still without a report; the name comes back by URL.

    ``hash_id`` counts up from ``above``, the largest id given before, in the ``order`` of
    the results (columns of theirs; without any, as they are read), so the largest id of a
    file is its last result and the smallest ids have waited longest.
    """
    names = selected.groupBy(F.col("snapshot_id").alias("_snapshot"), F.col("url").alias("_url")).agg(F.max_by("name", "pos").alias("name"))
    # a plain equality of URLs would filter the selected ones for null first, and so resolve each again
    same = (F.col("snapshot_id") == F.col("_snapshot")) & F.col("url").eqNullSafe(F.col("_url"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    numbered = with_sequence(results, *order, name="hash_id", start=above + 1)
    return numbered.join(names, same, "left").withColumn("name", F.when(F.col("url").isNotNull(), F.col("name"))).select(
        "hash_id", "snapshot_id", text("name"), "url", text("sha256"), text("md5"), text("tlsh"),
        F.coalesce("size", F.lit(0)).alias("size"), text("error"),
        F.lit(None).cast(f"struct<{schemas.VT}>").alias("vt"),
        (F.current_timestamp() if hashed_at is None else hashed_at).alias("hashed_at"),
    )


def hash_summary(hashes: DataFrame) -> DataFrame:
    """One row: hashed, skipped and errored counts."""
    return hashes.agg(
        F.count_if(F.col("sha256") != "").alias("hashed"),
        F.count_if(F.col("sha256") == "").alias("skipped"),
        F.count_if(F.col("error") != "").alias("errored"),
    )


def hashed_types(hashes: DataFrame) -> DataFrame:
    """Hashed files by lower-case extension."""
    named = hashes.filter((F.col("sha256") != "") & F.col("name").contains("."))
    return named.groupBy(F.lower(F.substring_index("name", ".", -1)).alias("ext")).agg(
        F.count(F.lit(1)).alias("n")
    )


def vt_pending(hashes: DataFrame, limit: int | None = None) -> DataFrame:
    """Hashed rows still without a report."""
    pending = hashes.filter(F.col("vt").isNull() & (F.col("sha256") != ""))
    return pending if limit is None else pending.orderBy("hash_id").limit(limit)


def vt_enrich(hashes: DataFrame, reports: DataFrame) -> DataFrame:
    """Attach reports (``sha256, vt``) to pending rows; done rows are untouched.

    Only pending rows enter the join: rows without a hash would all meet in one
    task. Error reports are stored too, so they are not asked for again.
    """
    waiting = F.col("vt").isNull() & (F.col("sha256") != "")
    one_each = reports.groupBy("sha256").agg(F.max("vt").alias("vt"))
    enriched = (
        hashes.filter(waiting).drop("vt").join(one_each, "sha256", "left").select(*hashes.columns)
    )
    return hashes.filter(~waiting).unionByName(enriched)


def vt_summary(hashes: DataFrame) -> DataFrame:
    """One row: looked up, found, reported malicious."""
    return hashes.agg(
        F.count_if(F.col("vt").isNotNull()).alias("looked_up"),
        F.count_if(F.col("vt.found")).alias("found"),
        F.count_if(F.col("vt.malicious") > 0).alias("malicious"),
    )


def vt_state_col(error: Column, vt: Column) -> Column:
    """``error``, ``pending``, ``flagged`` or ``clean``."""
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "error")
        .when(~F.coalesce(vt["found"], F.lit(False)), "pending")
        .when(F.coalesce(vt["malicious"], F.lit(0)) > 0, "flagged")
        .otherwise("clean")
    )

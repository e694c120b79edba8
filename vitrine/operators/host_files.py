"""The per-host file inventory: notable files under a disclosure policy.

Origin hosts appear only as salted tokens. Programs and scripts are shown by
name, with hashes where known; every other file as type, size and date, because
its name can itself be personal data, unless the caller asks for full disclosure.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.files import extension, file_rank, is_alarm, is_payload
from vitrine.functions.tokens import host_token
from vitrine.functions.urls import host_of
from vitrine.operators.arrival import with_place
from vitrine.operators.hosts import host_summary, named


def hashes_by_file(hashes: DataFrame) -> DataFrame:
    """The newest hash row per (host, file name), by ``hash_id``, which counts up; rows without a hash are left out."""
    located = hashes.filter("sha256 <> ''").withColumn("_host", host_of(F.col("url")))
    newest = F.max_by(F.struct("sha256", "tlsh", "vt"), F.col("hash_id"))
    return (
        located.groupBy(F.coalesce("_host", F.lit("")).alias("host"), "name")
        .agg(newest.alias("hash"))
    )


def host_entries(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Files (not directories) of the given records, with host and record order."""
    owners = records.select("snapshot_id", "host", "first_open_at", "first_open_id")
    files = entries.filter(~F.col("is_dir")).select("snapshot_id", "pos", "name", "size", "mtime")
    return files.join(owners, "snapshot_id")


def join_hashes(files: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """Adds the ``hash`` struct of each file, matched by host and file name."""
    if hashes is None:
        return files.withColumn("hash", F.lit(None).cast("struct<sha256:string,tlsh:string,vt:struct<malicious:bigint>>"))
    return files.join(hashes_by_file(hashes), ["host", "name"], "left")


def ranked_files(files: DataFrame) -> DataFrame:
    """Adds ``rank`` (0 most notable) and ``alarm``."""
    malicious = F.col("hash.vt.malicious")
    return files.withColumns(
        {
            "rank": file_rank(F.col("name"), F.col("size"), malicious),
            "alarm": is_payload(F.col("name")) & is_alarm(F.col("name"), malicious),
        }
    )


def notable_order() -> list[Column]:
    """Rank, larger first, then the order in which files were seen."""
    return [
        F.col("rank"), F.coalesce("size", F.lit(0)).desc(),
        F.col("first_open_at"), F.col("first_open_id"), F.col("pos"),
    ]


def top_files(files: DataFrame, n: int | None = 12) -> DataFrame:
    """The ``n`` most notable ranked files per host, numbered by ``place``.

    The filter sits on the window, so map tasks send at most ``n`` rows per host
    however many files it has, for ``n`` up to ``spark.sql.optimizer.windowGroupLimitThreshold``.
    ``n=None`` keeps and numbers all files, in sorted ranges: no task has to hold a host.
    """
    if n is None:
        return with_place(files, "host", *notable_order())
    order = Window.partitionBy("host").orderBy(*notable_order())
    return files.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def disclose_files(files: DataFrame, disclose: bool = False) -> DataFrame:
    """Ranked files under the disclosure policy: ``file`` holds what may be shown."""
    name, program = F.col("name"), is_payload(F.col("name"))
    ext = extension(name)
    shown = F.struct(
        F.when(program, "exec").otherwise("data").alias("kind"),
        F.when(program | F.lit(disclose), name).alias("name"),
        F.when(~program & (ext == ""), "(no ext)").otherwise(ext).alias("ext"),
        F.col("size").alias("size"),
        F.nullif(F.col("mtime"), F.lit("")).alias("mtime"),
        F.when(program, F.col("alarm")).alias("alarm"),
        F.when(program, F.nullif(F.col("hash.sha256"), F.lit(""))).alias("sha256"),
        F.when(program, F.nullif(F.col("hash.tlsh"), F.lit(""))).alias("tlsh"),
        F.when(program, F.col("hash.vt")).alias("vt"),
    )
    kept = [c for c in files.columns if c not in ("name", "size", "mtime", "hash", "pos")]
    return files.select(*kept, shown.alias("file"))


def flagged_records(records: DataFrame, flagged_only: bool = True) -> DataFrame:
    """Records of hosts with at least one flagged record (all, if not asked)."""
    if not flagged_only:
        return records
    records = named(records)
    hosts = records.filter(F.col("label").isin("malicious_staging", "sensitive_exposure")).select("host")
    return records.join(hosts.distinct(), "host", "left_semi")


def host_file_inventory(
    records: DataFrame,
    entries: DataFrame,
    salt: str,
    hashes: DataFrame | None = None,
    max_files: int = 12,
    flagged_only: bool = True,
    disclose: bool = False,
) -> DataFrame:
    """One row per host: token, verdict, signals, notable files, honeypot; worst first.

    ``records`` are the latest directories with verdict and profile; ``entries``
    their listing entries. The verdict is the worst of a host's records, benign
    records included in its files. For a listing of all files, which has no bound
    per host, use ``host_file_rows``.
    """
    if max_files is None:
        raise ValueError("an array of all files has no bound per host: use host_file_rows")
    kept = flagged_records(named(records), flagged_only)
    files = ranked_files(join_hashes(host_entries(kept, entries), hashes))
    shown = disclose_files(top_files(files, max_files), disclose)
    # at most max_files structs per host
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "file"))), lambda f: f["file"])
    per_host = shown.groupBy("host").agg(
        listed.alias("files"),
        F.count(F.lit(1)).alias("shown"),
        F.count_if(F.col("file.alarm")).alias("alarms"),
    )
    joined = host_summary(kept).join(per_host, "host", "left")
    count = F.coalesce("shown", F.lit(0))
    return (
        joined.select(
            host_token(F.col("host"), salt).alias("token"),
            "verdict",
            "signals",
            F.coalesce("files", F.array()).alias("files"),
            count.alias("shown"),
            "total",
            (F.col("total") - count).alias("hidden"),
            "has_meta",
            F.when(F.col("honeypot.flag"), F.col("honeypot")).alias("honeypot"),
            F.coalesce("severity", F.lit(9)).alias("_severity"),
            F.coalesce("alarms", F.lit(0)).alias("_alarms"),
            F.col("first_seen").alias("_first_seen"),
        )
        .orderBy("_severity", F.desc("_alarms"), F.desc("total"), "_first_seen", "token")
        .drop("_severity", "_alarms", "_first_seen")
    )


def host_file_rows(
    records: DataFrame,
    entries: DataFrame,
    salt: str,
    hashes: DataFrame | None = None,
    flagged_only: bool = True,
    disclose: bool = False,
) -> DataFrame:
    """Every file of every host as rows (``token, place, rank, file``), most notable first.

    ``place`` counts a host's files from 1 on. Written out flat, in sorted ranges that number
    their own rows, so one huge host is spread over many tasks.
    """
    kept = flagged_records(named(records), flagged_only)
    files = ranked_files(join_hashes(host_entries(kept, entries), hashes))
    placed = with_place(files.withColumn("token", host_token(F.col("host"), salt)), "token", *notable_order())
    return disclose_files(placed, disclose).select("token", "place", "rank", "file").orderBy("token", "place")

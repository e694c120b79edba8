"""Rollups per origin host. No address, port or path leaves these functions.

``records`` holds one row per captured directory: ``host, port, label``, the hit
structs of its profile, ``raw_html_sha256`` and ``file_count``. Every rollup is a
chain of partial aggregations, so a host with a third of all records costs its
tasks no more than any other.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.matching import category_tests
from vitrine.operators.features import HITS

_SIGNAL_SOURCE = {
    category: column
    for column in ("sensitive_hits", "payload_hits", "interest_hits")
    for category in HITS[column]
}
_SEVERITY = {label: rank for rank, label in enumerate(P.LABELS)}
_SHOWN = {"malicious_staging": "malicious", "sensitive_exposure": "sensitive"}


def _severity(label: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in _SEVERITY.items():
        rank = F.when(label == name, F.lit(value)).otherwise(rank)
    return rank


def _from_severity(severity: Column, names: list[str]) -> Column:
    result = F.lit(None).cast("string")
    for value, name in enumerate(names):
        result = F.when(severity == value, F.lit(name)).otherwise(result)
    return result


def signal_flags() -> list[Column]:
    """Aggregates telling which signals any record of the group shows."""
    return [
        F.max(F.coalesce(F.col(column)[c], F.lit(0)) > 0).alias(f"signal:{c}")
        for c, column in _SIGNAL_SOURCE.items()
    ]


def _merge_flags(prefix: str, keys) -> list[Column]:
    return [F.max(f"`{prefix}:{k}`").alias(f"{prefix}:{k}") for k in keys]


def _named(prefix: str, names: dict[str, str]) -> Column:
    """The names whose flag is set, in the order of ``names``."""
    return F.array_compact(
        F.array(*[F.when(F.col(f"`{prefix}:{k}`"), F.lit(name)) for k, name in names.items()])
    )


def signal_labels() -> Column:
    """Readable signal names, worst first."""
    return _named("signal", P.SIGNAL_LABELS)


def named(records: DataFrame) -> DataFrame:
    """Records with the host as text; those whose URL has none share the empty one."""
    return records.withColumn("host", F.coalesce("host", F.lit("")))


def host_signals(records: DataFrame) -> DataFrame:
    """The signals each host shows over all its records (``host, signals``)."""
    return named(records).groupBy("host").agg(*signal_flags()).select("host", signal_labels().alias("signals"))


def host_breakdown(records: DataFrame, flagged_only: bool = True) -> DataFrame:
    """One anonymous row per host: ``verdict, signals, ports``, worst first.

    Records are grouped by (host, port) and then by host, which counts distinct
    ports without a second pass. ``records`` may name hosts by ``host`` (null
    falls back to ``url``).
    """
    host = F.coalesce("host", "url") if "url" in records.columns else F.col("host")
    per_port = records.groupBy(host.alias("host"), "port").agg(
        F.min(_severity(F.col("label"))).alias("severity"), *signal_flags()
    )
    per_host = per_port.groupBy("host").agg(
        F.least(F.coalesce(F.min("severity"), F.lit(3)), F.lit(3)).alias("severity"),
        F.count_if(F.coalesce("port", F.lit(0)) > 0).alias("ports"),
        *_merge_flags("signal", _SIGNAL_SOURCE),
    )
    by_key = {k: k for k in sorted(_SIGNAL_SOURCE)}
    rows = per_host.select(
        "severity",
        signal_labels().alias("signals"),
        _named("signal", by_key).alias("_keys"),
        F.greatest("ports", F.lit(1)).alias("ports"),
    )
    if flagged_only:
        rows = rows.filter((F.col("severity") <= 1) & (F.size("signals") > 0))
    verdicts = [_SHOWN.get(label, label) for label in P.LABELS]
    return (
        rows.orderBy("severity", F.desc(F.size("signals")), "_keys", "ports")
        .select(_from_severity(F.col("severity"), verdicts).alias("verdict"), "signals", "ports")
    )


def bait_categories(entries: DataFrame, *by: str) -> DataFrame:
    """Distinct lure categories among the file names of each group, sorted."""
    tests = category_tests(F.col("name"), P.BAIT)
    flags = entries.groupBy(*by).agg(*[F.max(t).alias(f"bait:{c}") for c, t in tests.items()])
    return flags.select(*by, _named("bait", {c: c for c in sorted(P.BAIT)}).alias("bait"))


def identical_fanout(records: DataFrame) -> DataFrame:
    """Per host, the most records that share one page hash; 1 if none has a hash."""
    per_hash = named(records).groupBy("host", "raw_html_sha256").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("raw_html_sha256") != "", F.col("n"))), F.lit(1)).alias("fanout")
    )


def honeypot_col(bait: Column, fanout: Column) -> Column:
    """Flag, score and reasons of a potential trap."""
    curated = F.size(bait) >= P.MIN_BAIT
    fanned = fanout >= P.MIN_FANOUT
    listed = F.format_string(P.REASON_BAIT, F.size(bait), F.array_join(F.array_sort(bait), ", "))
    spread = F.format_string(P.REASON_FANOUT, fanout)
    return F.struct(
        (curated | fanned).alias("flag"),
        (F.size(bait) + F.when(fanned, 3).otherwise(0)).alias("score"),
        F.array_compact(F.array(F.when(curated, listed), F.when(fanned, spread))).alias("reasons"),
    )


def honeypot(bait: DataFrame, fanout: DataFrame) -> DataFrame:
    """``host, flag, score, reasons`` from the bait and fan-out of each host."""
    joined = fanout.join(bait, "host", "left").select(
        "host", F.coalesce("bait", F.array().cast("array<string>")).alias("bait"), "fanout"
    )
    return joined.select("host", honeypot_col(F.col("bait"), F.col("fanout")).alias("h")).select("host", "h.*")


def host_summary(records: DataFrame) -> DataFrame:
    """All host-level facts of the file inventory, but for the files themselves.

    Grouped by (host, page hash) and then by host: the first step gives the
    fan-out, the second reduces everything else.
    """
    flagged = _severity(F.col("label"))
    flagged = F.when(flagged <= 1, flagged)
    per_page = named(records).groupBy("host", "raw_html_sha256").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(flagged).alias("severity"),
        F.sum("file_count").alias("total"),
        F.max("has_meta").alias("has_meta"),
        F.min(F.struct("first_open_at", "first_open_id")).alias("first_seen"),
        *signal_flags(),
        *[F.max(F.col("bait_hits")[c] > 0).alias(f"bait:{c}") for c in P.BAIT],
    )
    per_host = per_page.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("raw_html_sha256") != "", F.col("n"))), F.lit(1)).alias("fanout"),
        F.min("severity").alias("severity"),
        F.sum("total").alias("total"),
        F.max("has_meta").alias("has_meta"),
        F.min("first_seen").alias("first_seen"),
        *_merge_flags("signal", _SIGNAL_SOURCE),
        *_merge_flags("bait", P.BAIT),
    )
    return per_host.select(
        "host",
        "severity",
        F.coalesce(_from_severity(F.col("severity"), ["malicious", "sensitive"]), F.lit("flagged")).alias("verdict"),
        signal_labels().alias("signals"),
        "total",
        "has_meta",
        "first_seen",
        honeypot_col(_named("bait", {c: c for c in sorted(P.BAIT)}), F.col("fanout")).alias("honeypot"),
    )

"""The report: one table per section, each small, all from per-snapshot tables."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.urls import host_of
from vitrine.operators.features import snapshot_profiles
from vitrine.operators.host_files import flagged_records, host_file_inventory
from vitrine.operators.hosts import host_summary
from vitrine.operators.network import network_profile
from vitrine.operators.payloads import hash_summary, hashed_types, vt_summary
from vitrine.operators.records import directory_records, latest_open, newest_classification


def top_n(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The ``n`` most frequent values of a column, ties by value."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), key).limit(n)


def _with_share(counts: DataFrame) -> DataFrame:
    """Adds each count's share of the total; for a handful of rows only."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def _side_by_side(*parts: DataFrame) -> DataFrame:
    """Several single-row tables of counts as one row, without a join."""
    names = [name for part in parts for name in part.columns]
    long = None
    for part in parts:
        pairs = F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("bigint").alias("v")) for c in part.columns])
        rows = part.select(F.explode(pairs).alias("p")).select("p.*")
        long = rows if long is None else long.unionByName(rows)
    return long.agg(*[F.max(F.when(F.col("k") == name, F.col("v"))).alias(name) for name in names])


def corpus_funnel(candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: candidates, by status, open directories, candidates shown to be no listing."""
    found = candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("captured", "error", "pending")],
    )
    return _side_by_side(found, _validated(snapshots))


def _validated(snapshots: DataFrame) -> DataFrame:
    """One row: candidates seen open, and candidates seen as ordinary pages.

    Flags are reduced per candidate first, so both distinct counts come from one
    grouping.
    """
    flags = snapshots.groupBy("candidate_id").agg(
        F.max("is_open_dir").alias("opened"),
        F.max((F.col("http_status") == 200) & ~F.col("is_open_dir")).alias("ordinary"),
    )
    return flags.agg(
        F.count_if("opened").alias("open_dirs"), F.count_if("ordinary").alias("not_listing")
    )


def false_positive_rate(snapshots: DataFrame) -> DataFrame:
    """One row: the share of validated candidates that were no listing."""
    total = F.col("open_dirs") + F.col("not_listing")
    return _validated(snapshots).select(
        "open_dirs", "not_listing", F.try_divide(F.col("not_listing"), total).alias("rate")
    )


def network_hosts(latest: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per address: the owner and country of its first directory."""
    places = candidates.select(
        "candidate_id",
        F.coalesce(F.nullif(F.col("source_meta.ip"), F.lit("")), host_of(F.col("url"))).alias("ip"),
        F.col("source_meta.org").alias("org"),
        F.coalesce(F.nullif(F.col("source_meta.country"), F.lit("")), F.lit("?")).alias("country"),
    )
    joined = latest.select("candidate_id", "first_open_at", "first_open_id").join(places, "candidate_id")
    first = joined.groupBy("ip").agg(
        F.min_by(F.struct("org", "country"), F.struct("first_open_at", "first_open_id")).alias("_f")
    )
    return first.select("ip", "_f.*")


def _categorised(hosts: DataFrame) -> DataFrame:
    """Hosts per owner, with category and provider: the patterns run once per owner."""
    owners = hosts.groupBy("org").agg(F.count(F.lit(1)).alias("hosts"))
    return network_profile(owners)


def network_report(latest: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hosts and share per network category."""
    owners = _categorised(network_hosts(latest, candidates))
    return _with_share(owners.groupBy("category").agg(F.sum("hosts").alias("n")))


def top_providers(latest: DataFrame, candidates: DataFrame, n: int | None = 8) -> DataFrame:
    owners = _categorised(network_hosts(latest, candidates))
    counts = owners.groupBy("provider").agg(F.sum("hosts").alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), "provider").limit(n)


def top_countries(latest: DataFrame, candidates: DataFrame, n: int | None = 10) -> DataFrame:
    return top_n(network_hosts(latest, candidates), "country", n)


def label_shares(latest: DataFrame, classifications: DataFrame) -> DataFrame:
    """Verdicts of the latest directories at the current ruleset, worst first."""
    judged = newest_classification(latest, classifications, ruleset_version=P.RULESET_VERSION)
    place = F.array_position(F.array(*[F.lit(x) for x in P.REPORT_LABELS]), F.col("label"))
    return _with_share(top_n(judged, "label", None)).orderBy(place)


def _prevalence(rows: DataFrame, hits: dict[str, list[str]]) -> DataFrame:
    """Rows with at least one hit, per family and category (``family, category, dirs``).

    One pass of plain sums; the single wide row is then unpivoted.
    """
    sums = [
        F.count_if(F.col(column)[c] > 0).alias(f"{column}:{c}")
        for column, categories in hits.items()
        for c in categories
    ]
    unpivot = F.array(
        *[
            F.struct(
                F.lit(column.removesuffix("_hits")).alias("family"),
                F.lit(c).alias("category"),
                F.col(f"`{column}:{c}`").alias("dirs"),
            )
            for column, categories in hits.items()
            for c in categories
        ]
    )
    return rows.agg(*sums).select(F.explode(unpivot).alias("p")).select("p.*").filter("dirs > 0")


_VERDICT_HITS = {"sensitive_hits": list(P.SENSITIVE), "payload_hits": list(P.PAYLOAD)}


def signal_prevalence(latest: DataFrame, classifications: DataFrame) -> DataFrame:
    """Directories showing each verdict signal, by their newest verdict of any ruleset."""
    hits = classifications.select(
        "snapshot_id", "label", "ruleset_version", "classified_at",
        *[F.struct(*[(F.col("features")[column][c] > 0).alias(c) for c in names]).alias(column) for column, names in _VERDICT_HITS.items()],
    )
    flat = newest_classification(latest, hits, *_VERDICT_HITS).select(
        *[F.struct(*[F.col(column)[c].cast("int").alias(c) for c in names]).alias(column) for column, names in _VERDICT_HITS.items()]
    )
    return _prevalence(flat, _VERDICT_HITS).orderBy(F.desc("dirs"), "family", "category")


def ext_prevalence(latest: DataFrame, classifications: DataFrame, n: int | None = 12) -> DataFrame:
    """Directories having an extension among their top ones, as stored with the newest verdict; the ``n`` most common."""
    stored = classifications.select("snapshot_id", "ruleset_version", "classified_at", F.col("features.top_exts.ext").alias("exts"))
    judged = newest_classification(latest.select("snapshot_id"), stored, "exts", label=False)
    return top_n(judged.select(F.explode("exts").alias("ext")), "ext", n)


def server_software(latest: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("server_kind"), F.lit("")), F.lit("unknown"))
    return latest.groupBy(kind.alias("server_kind")).agg(F.count(F.lit(1)).alias("n"))


def interest_prevalence(latest: DataFrame, profiles: DataFrame) -> DataFrame:
    """Latest directories with at least one entry per interest category."""
    mined = latest.select("snapshot_id").join(profiles.select("snapshot_id", "interest_hits"), "snapshot_id")
    rows = _prevalence(mined, {"interest_hits": list(P.INTEREST)})
    return rows.select("category", "dirs").orderBy(F.desc("dirs"), "category")


def exposed_volume(latest: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row: directories with sizes, their bytes, and single files over 100 MB."""
    sized = latest.select("snapshot_id").join(
        profiles.select("snapshot_id", "known_sizes", "total_bytes", "files_over_100mb"), "snapshot_id"
    )
    known = F.col("known_sizes") > 0
    return sized.agg(
        F.count_if(known).alias("sized_dirs"),
        F.coalesce(F.sum(F.when(known, F.col("total_bytes"))), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(known, F.col("files_over_100mb"))), F.lit(0)).alias("files_over_100mb"),
    )


def one_in_col(total: Column, part: Column) -> Column:
    """``1 in N``: at least 2, halves to even; null when there is no part."""
    return F.greatest(F.lit(2), F.rint(F.try_divide(total, part)).cast("bigint"))


def kpis(shares: DataFrame, prevalence: DataFrame, summary: DataFrame) -> DataFrame:
    """One row of headline figures from two other sections and the summary of the flagged hosts.

    ``credential_key`` sums four prevalences, so a directory may count four times.
    """
    label = lambda *names: F.coalesce(F.sum(F.when(F.col("label").isin(*names), F.col("n"))), F.lit(0))
    labels = shares.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("classified"),
        label("malicious_staging", "sensitive_exposure").alias("sensitive"),
        label("malicious_staging").alias("malicious"),
    )
    dirs = lambda test: F.coalesce(F.sum(F.when(test, F.col("dirs"))), F.lit(0))
    signals = prevalence.agg(
        dirs((F.col("family") == "payload") & (F.col("category") == "webshell")).alias("webshell_dirs"),
        dirs((F.col("family") == "sensitive") & F.col("category").isin(P.CREDENTIAL_KEYS)).alias("credential_key"),
    )
    traps = summary.agg(F.count_if("honeypot.flag").alias("honeypot_hosts"))
    joined = _side_by_side(labels, signals, traps)
    return joined.withColumn("one_in", one_in_col(F.col("classified"), F.col("sensitive")))


def report_inputs(
    candidates: DataFrame, snapshots: DataFrame, classifications: DataFrame, entries: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The latest directories, their profiles, and one record per directory: write each once for a large report."""
    latest = latest_open(snapshots, "server_kind", "raw_html_sha256")
    current = entries.join(latest.select("snapshot_id"), "snapshot_id", "left_semi")
    profiles = snapshot_profiles(current)
    return latest, profiles, directory_records(latest, classifications, candidates, profiles)


def report_tables(
    candidates: DataFrame,
    snapshots: DataFrame,
    classifications: DataFrame,
    entries: DataFrame,
    hashes: DataFrame,
    salt: str,
    max_files: int = 10,
    hosts_shown: int | None = None,
    inputs: tuple[DataFrame, DataFrame, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All report sections, by name.

    ``inputs`` are the three tables of ``report_inputs``, as the caller has written
    them (``materialized``): every section but the file lists reads those, which are as many
    rows as there are directories. Building the report runs no job.
    """
    latest, profiles, records = inputs or report_inputs(candidates, snapshots, classifications, entries)
    inventory = host_file_inventory(records, entries, salt, hashes, max_files)
    shares = label_shares(latest, classifications)
    prevalence = signal_prevalence(latest, classifications)
    return {
        "corpus_funnel": corpus_funnel(candidates, snapshots),
        "false_positive_rate": false_positive_rate(snapshots),
        "network_report": network_report(latest, candidates),
        "top_providers": top_providers(latest, candidates),
        "top_countries": top_countries(latest, candidates),
        "label_shares": shares,
        "signal_prevalence": prevalence,
        "ext_prevalence": ext_prevalence(latest, classifications),
        "server_software": server_software(latest),
        "interest_prevalence": interest_prevalence(latest, profiles),
        "exposed_volume": exposed_volume(latest, profiles),
        "kpis": kpis(shares, prevalence, host_summary(flagged_records(records))),
        "host_inventory": inventory if hosts_shown is None else inventory.limit(hosts_shown),
        "hash_summary": hash_summary(hashes),
        "hashed_types": hashed_types(hashes),
        "vt_summary": vt_summary(hashes),
    }


def report_records(
    candidates: DataFrame, snapshots: DataFrame, classifications: DataFrame, profiles: DataFrame, ruleset_version: str = P.RULESET_VERSION
) -> DataFrame:
    """One row per candidate with all that the counts of the report need: each input is read once.

    The newest listing with its newest verdict (label of the current rule set, hits and
    extensions of any), the profile of that listing, the owner and place of the candidate.
    """
    is_listing = F.coalesce("is_open_dir", F.lit(False))
    seen = F.struct("fetched_at", "snapshot_id")
    per_candidate = snapshots.groupBy("candidate_id").agg(
        F.max_by(F.struct("snapshot_id", "server_kind"), F.when(is_listing, seen)).alias("_s"),
        F.min(F.when(is_listing, seen)).alias("first_open"),
        F.max(F.when((F.col("http_status") == 200) & ~is_listing, 1)).alias("not_listing"),
    )
    order = F.struct("classified_at", F.transform(F.split("ruleset_version", r"\."), lambda x: x.try_cast("int")))
    current = F.col("ruleset_version") == ruleset_version
    verdicts = classifications.groupBy("snapshot_id").agg(
        F.max_by("label", F.when(current, order)).alias("label"),
        F.max_by(F.struct("features.sensitive_hits", "features.payload_hits", F.col("features.top_exts.ext").alias("exts")), order).alias("features"),
    )
    owners = candidates.select(
        "candidate_id", "status", F.col("source_meta.org").alias("org"), F.coalesce(F.nullif(F.col("source_meta.country"), F.lit("")), F.lit("?")).alias("country"),
        F.coalesce(F.nullif(F.col("source_meta.ip"), F.lit("")), host_of(F.col("url"))).alias("place"),
    )
    sums = profiles.select("snapshot_id", "interest_hits", "known_sizes", "total_bytes", "files_over_100mb")
    # candidates without a listing get join keys of their own, not one null that they share
    listed = per_candidate.select("candidate_id", "_s.*", "first_open", "not_listing").withColumn(
        "_k", F.coalesce("snapshot_id", F.xxhash64("candidate_id")))
    for part in (verdicts, sums):
        part = part.withColumnRenamed("snapshot_id", "_id")
        listed = listed.join(part, (F.col("_k") == F.col("_id")) & F.col("snapshot_id").isNotNull(), "left").drop("_id")
    return owners.join(listed.drop("_k"), "candidate_id", "left")


def report_rows(records: DataFrame, network_top: int | None = None) -> DataFrame:
    """``section, key, value``: every count of the report from one pass over written ``report_records``.

    Each record is turned into the (section, key, value) triples it counts for, at most a
    few dozen, and one combined sum by section and key yields all sections; map tasks send
    one row per key. Hosts are counted once for their first listing, by a minimum per
    address that is combined as well, and join the same sum. Zero counts have no row.
    """
    def triple(section: str, key: Column | str, value: Column | int = 1) -> Column:
        key = F.lit(key) if isinstance(key, str) else key
        value = F.lit(value) if isinstance(value, int) else value
        return F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("bigint").alias("value"))

    is_open = F.col("snapshot_id").isNotNull()
    hits = lambda section, column, names: [
        F.when(column[c] > 0, triple(section, c)) for c in names]
    kind = F.coalesce(F.nullif(F.col("server_kind"), F.lit("")), F.lit("unknown"))
    triples = F.array_compact(F.array(
        triple("corpus", "candidates"),
        triple("corpus", F.coalesce("status", F.lit("unknown"))),
        F.when(is_open, triple("corpus", "open_dirs")),
        F.when(F.col("not_listing") == 1, triple("corpus", "not_listing")),
        F.when(is_open, triple("server", kind)),
        F.when(F.col("label").isNotNull(), triple("label", F.col("label"))),
        *hits("sensitive", F.col("features.sensitive_hits"), P.SENSITIVE),
        *hits("payload", F.col("features.payload_hits"), P.PAYLOAD),
        *hits("interest", F.col("interest_hits"), P.INTEREST),
        *[F.when(F.col("known_sizes") > 0, triple("volume", name, value)) for name, value in (
            ("sized_dirs", F.lit(1)), ("total_bytes", F.col("total_bytes")), ("files_over_100mb", F.col("files_over_100mb")))],
    ))
    exts = F.transform(F.coalesce("features.exts", F.array()), lambda e: triple("ext", e))
    counted = records.select(F.explode(F.concat(triples, F.when(is_open, exts).otherwise(F.array()))).alias("_t")).select("_t.*")
    first = records.where(is_open).groupBy("place").agg(F.min_by(F.struct("org", "country"), "first_open").alias("_o")).select("_o.*")
    profiled = network_profile(first)
    network = profiled.select(F.explode(F.array(
        triple("network", F.col("category")), triple("provider", F.col("provider")), triple("country", F.col("country")),
    )).alias("_t")).select("_t.*")
    rows = counted.unionByName(network).groupBy("section", "key").agg(F.sum("value").alias("value")).where("value > 0")
    if network_top is None:
        return rows
    order = Window.partitionBy("section").orderBy(F.desc("value"), "key")
    cut = F.col("section").isin("provider", "country", "ext")
    return rows.withColumn("_n", F.row_number().over(order)).where(~cut | (F.col("_n") <= network_top)).drop("_n")

"""Candidates: scope, dedup, queues, status, browsing."""
import ipaddress
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.binding import let
from vitrine.functions.urls import dedup_form, host_of, normal_form, repaired, split_url
from vitrine.operators.text_index import search_indexed

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def normalize_urls(df: DataFrame, col: str = "url") -> DataFrame:
    """Adds ``normalized_url``."""
    split = df.withColumn("_u", split_url(repaired(F.col(col))))
    return split.withColumn("normalized_url", normal_form(F.col("_u"))).drop("_u")


def with_dedup_key(df: DataFrame, col: str = "url") -> DataFrame:
    """Adds ``dedup_key``."""
    split = df.withColumn("_u", split_url(repaired(F.col(col))))
    return split.withColumn("dedup_key", dedup_form(F.col("_u"))).drop("_u")


def with_host_port(df: DataFrame, col: str = "url") -> DataFrame:
    """Adds ``host`` and ``port`` as written in the URL."""
    split = df.withColumn("_u", split_url(F.col(col)))
    return split.withColumns({"host": F.col("_u.host"), "port": F.col("_u.port")}).drop("_u")


def _networks(cidrs) -> list:
    networks = []
    for cidr in cidrs:
        try:
            networks.append(ipaddress.ip_network(cidr, strict=False))
        except ValueError:
            continue
    return networks


def _ipv4_blocked(host: Column, cidrs) -> Column:
    number = F.aggregate(
        F.split(host, r"\."), F.lit(0).cast("bigint"), lambda n, octet: n * 256 + octet.cast("bigint")
    )

    def in_any(n: Column) -> Column:
        blocked = F.lit(False)
        for net in _networks([*P.SPECIAL_IPV4, *cidrs]):
            if net.version == 4:
                blocked = blocked | n.between(int(net.network_address), int(net.broadcast_address))
        return blocked

    return let(number, in_any)


def _ipv6_digits(literal: Column) -> Column:
    """The 32 hex digits of an IPv6 literal; null if it is none."""
    tail = r"^(.*:)(\d+)\.(\d+)\.(\d+)\.(\d+)$"
    pair = lambda i: F.lower(F.hex(F.regexp_extract(literal, tail, i).cast("bigint") * 256 + F.regexp_extract(literal, tail, i + 1).cast("bigint")))
    plain = F.when(
        literal.rlike(rf":{_OCTET}(?:\.{_OCTET}){{3}}$"), F.concat(F.regexp_extract(literal, tail, 1), pair(2), F.lit(":"), pair(4))
    ).otherwise(literal)
    groups = "(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?"

    def digits(text: Column) -> Column:
        halves = F.split(text, "::")
        side = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
        joined = lambda parts: F.array_join(F.transform(parts, lambda g: F.lpad(g, 4, "0")), "")
        count = F.size(side(0)) + F.size(side(1))
        whole = F.when(text.contains("::"), count <= 7).otherwise(count == 8)
        return F.when(
            text.rlike(f"^{groups}(?:::{groups})?$") & whole,
            F.concat(joined(side(0)), F.repeat(F.lit("0000"), 8 - count), joined(side(1))),
        )

    return let(plain, digits)


def _ipv6_blocked(literal: Column, cidrs) -> Column:
    """Outside the public range, in a special block of it, in an extra block, or no address at all."""
    def within(digits: Column, networks) -> Column:
        found = F.lit(False)
        for net in networks:
            found = found | digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
        return found

    special, spared = _networks(P.SPECIAL_IPV6), _networks(P.PUBLIC_IN_SPECIAL_IPV6)
    extra = [n for n in _networks(cidrs) if n.version == 6]
    return let(_ipv6_digits(literal), lambda d: F.coalesce(
        ~within(d, _networks([P.PUBLIC_IPV6])) | (within(d, special) & ~within(d, spared)) | within(d, extra), F.lit(True)
    ))


def with_blocked(df: DataFrame, col: str = "url", cidrs=(), suffixes=P.BLOCKED_SUFFIXES) -> DataFrame:
    """Adds ``blocked``: the target is out of scope.

    The URL is judged as given, so one without a scheme has no host and is blocked.
    """
    host = let(
        F.rtrim(F.coalesce(host_of(F.col(col)), F.lit("")), F.lit(".")),
        lambda h: F.when(h.rlike(P.HOST_CHARS), h),
    )
    placed = df.withColumn("_host", host)

    def judge(name: Column) -> Column:
        numeric = name.rlike(rf"^(?:{P.NUMERIC_LABEL})(?:\.(?:{P.NUMERIC_LABEL}))*$")
        suffix = F.lit(False)
        for s in suffixes:
            suffix = suffix | (name == s.lstrip(".")) | name.endswith(s)
        return (
            F.when(name.isNull(), True)
            .when(name.contains(":"), _ipv6_blocked(name, cidrs))
            .when(name.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), _ipv4_blocked(name, cidrs))
            .otherwise(numeric | suffix)
        )

    return placed.withColumn("blocked", let(F.col("_host"), judge)).drop("_host")


def scope_filter(df: DataFrame, col: str = "url", cidrs=(), suffixes=P.BLOCKED_SUFFIXES) -> DataFrame:
    """Rows whose URL may be visited."""
    return with_blocked(df, col, cidrs, suffixes).filter(~F.col("blocked")).drop("blocked")


def ingest_candidates(
    discovered: DataFrame, existing: DataFrame | None = None, order: str = "input_order", cidrs=(),
    seen_at: Column | None = None,
) -> DataFrame:
    """New candidates: in scope, one per dedup key (the first seen), not known yet.

    ``candidate_id`` is a hash of the dedup key, so reruns agree and no counter is kept.
    """
    admitted = scope_filter(discovered, "url", cidrs)
    split = admitted.withColumn("_u", split_url(repaired(F.col("url"))))
    keyed = split.select(
        dedup_form(F.col("_u")).alias("dedup_key"),
        F.col(order).alias("_order"),
        F.struct(
            normal_form(F.col("_u")).alias("url"),
            *[F.col(c) for c in ("source", "source_meta") if c in discovered.columns],
        ).alias("_row"),
    )
    first = keyed.groupBy("dedup_key").agg(F.min_by("_row", "_order").alias("_row"))
    if existing is not None:
        first = first.join(existing.select("dedup_key"), "dedup_key", "left_anti")
    return first.select(
        F.xxhash64("dedup_key").alias("candidate_id"), "dedup_key", "_row.*",
        (F.current_timestamp() if seen_at is None else seen_at).alias("first_seen"),
        F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("last_captured_at"),
    )


def pending_queue(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates waiting for a capture, oldest first."""
    queue = candidates.filter("status = 'pending'").orderBy("first_seen", "candidate_id")
    return queue if limit is None else queue.limit(limit)


def pending_count(candidates: DataFrame) -> DataFrame:
    return candidates.filter("status = 'pending'").agg(F.count(F.lit(1)).alias("pending"))


def recapture_queue(candidates: DataFrame, snapshots: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates that ever showed an open directory, oldest first."""
    shown = snapshots.filter("is_open_dir").select("candidate_id")
    queue = candidates.join(shown, "candidate_id", "left_semi").orderBy("first_seen", "candidate_id")
    return queue if limit is None else queue.limit(limit)


def advance_status(candidates: DataFrame, new_snapshots: DataFrame) -> DataFrame:
    """Candidates after an ingest: the last new snapshot of each decides its status."""
    outcome = F.when(F.coalesce("error", F.lit("")) != "", "error").otherwise("captured")
    last = new_snapshots.groupBy("candidate_id").agg(
        F.max_by(outcome, F.struct("fetched_at", "snapshot_id")).alias("_status"),
        F.max("fetched_at").alias("_at"),
    )
    changed = {
        "status": F.coalesce("_status", "status"),
        "last_captured_at": F.coalesce("_at", "last_captured_at"),
    }
    joined = candidates.join(last, "candidate_id", "left")
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in candidates.columns])


def browse(
    df: DataFrame,
    filters: dict | None = None,
    search: str = "",
    search_columns: tuple[str, ...] = (),
    date_column: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    index: tuple[DataFrame, str] | None = None,
) -> DataFrame:
    """Rows with the given column values whose text columns contain ``search``.

    Every condition is a plain predicate on a column, so it reaches the scan.
    Newest first by ``date_column``. ``index`` (a ``build_index`` table of the search
    columns, and the key column) finds the rows to be searched by trigrams.
    """
    rows = df
    for column, value in (filters or {}).items():
        rows = rows.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    if search and index:
        rows = search_indexed(rows, *index, search_columns, search)
    elif search:
        found = F.lit(False)
        for column in search_columns:
            found = found | F.contains(F.lower(column), F.lit(search.lower()))
        rows = rows.filter(found)
    if date_column and start is not None:
        rows = rows.filter(F.col(date_column) >= F.lit(start))
    if date_column and end is not None:
        rows = rows.filter(F.col(date_column) <= F.lit(end))
    return rows.orderBy(F.desc(date_column)) if date_column else rows

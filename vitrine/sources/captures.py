"""Capture results (JSON lines) to snapshots, with every line accounted for."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions import patterns as P
from vitrine.functions.texts import strip
from vitrine.operators.arrival import file_lines, located

_RESULT = (
    "url string, error string, http_status int, final_url string, "
    "headers array<array<string>>, server_banner string, server_kind string, title string, "
    f"is_open_dir boolean, listing_entries array<struct<{schemas.ENTRY}>>, entry_count bigint, "
    "raw_html_sha256 string, header_order_sha256 string, template_sha256 string, "
    f"favicon_sha256 string, tls struct<{schemas.TLS}>"
)
_ONLY_OK = [
    "server_banner", "server_kind", "title", "is_open_dir", "listing_entries", "entry_count",
    "raw_html_sha256", "header_order_sha256", "template_sha256", "favicon_sha256", "tls",
]


def route_captures(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """Lines (``value``) with their outcome: ok, error, unmatched, mistyped or malformed.

    Blank lines are dropped. A line belongs to the lowest candidate id with
    exactly its URL; an unknown URL is unmatched whatever else the line lacks. A
    line whose keys are there but hold values of other types is mistyped, so no
    value is lost unseen. Lines of any length are read; of a repeated key the last counts.
    """
    present = lines.filter(strip(F.col("value")) != "")
    parsed = present.withColumn(
        "r", F.from_json("value", f"{_RESULT}, _whole string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_whole"} | schemas.ANY_LENGTH)
    )
    # the typed parser also reads numbers such as NaN, which the key reader rejects
    loose = F.map_keys(F.from_json("value", "map<string, string>", schemas.ANY_LENGTH))
    keyed = parsed.withColumn("_keys", F.coalesce(F.json_object_keys("value"), F.when(F.col("r._whole").isNull(), loose)))
    owners = candidates.groupBy(F.col("url").alias("_url")).agg(
        F.min("candidate_id").alias("candidate_id")
    )
    # a line without a URL gets a key that no candidate has, its own, not one that all such lines share
    own = F.concat(F.lit("\0"), F.xxhash64("value").cast("string"))
    joined = keyed.withColumn("_key", F.coalesce(F.nullif(F.col("r.url"), F.lit("")), own)).join(
        owners, F.col("_key") == F.col("_url"), "left"
    )
    missing = F.size(F.array_except(F.array(*[F.lit(k) for k in P.CAPTURE_KEYS]), F.col("_keys"))) > 0
    outcome = (
        F.when(F.col("_keys").isNull(), "malformed")
        .when(F.col("r").isNull(), "mistyped")
        .when(F.col("candidate_id").isNull(), "unmatched")
        .when(F.col("r._whole").isNotNull(), "mistyped")
        .when(F.coalesce("r.error", F.lit("")) != "", "error")
        .when(missing, "malformed")
        .otherwise("ok")
    )
    return joined.withColumns({"outcome": outcome, "r": F.col("r").dropFields("_whole")}).drop("_keys", "_url", "_key")


def snapshots_of(routed: DataFrame) -> DataFrame:
    """Snapshot rows of the ok and error lines; an error keeps status and URL only."""
    ok = F.col("outcome") == "ok"
    headers = F.transform("r.headers", lambda h: F.struct(F.get(h, F.lit(0)).alias("k"), F.get(h, F.lit(1)).alias("v")))
    kept = routed.filter(F.col("outcome").isin("ok", "error"))
    extra = [c for c in routed.columns if c not in ("value", "r", "outcome", "candidate_id")]
    return kept.select(
        *extra, "candidate_id",
        F.col("r.http_status").alias("http_status"),
        F.coalesce("r.final_url", F.lit("")).alias("final_url"),
        F.when(ok, headers).alias("headers"),
        *[F.when(ok, F.col(f"r.{c}")).alias(c) for c in _ONLY_OK],
        F.coalesce("r.error", F.lit("")).alias("error"),
    )


def ingest_captures(lines: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots to append, rejected lines, and counts per outcome."""
    routed = route_captures(lines, candidates)
    return snapshots_of(routed), rejects_of(routed), outcome_counts(routed)


def rejects_of(routed: DataFrame) -> DataFrame:
    """Lines that gave no snapshot, with the reason."""
    return routed.filter(F.col("outcome").isin("unmatched", "mistyped", "malformed")).select("value", "outcome")


def outcome_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def identified(lines: DataFrame, above: int = 0) -> DataFrame:
    """``located`` lines with ``snapshot_id``, which counts up from ``above`` by file and line, and ``fetched_at``.

    Equal lines get different ids; the same files give the same ids again.
    """
    return file_lines(lines).select(
        "value", (F.col("line") + above).alias("snapshot_id"), F.col("modified").alias("fetched_at"),
    )


def read_captures(spark: SparkSession, path: str, above: int = 0) -> DataFrame:
    """Capture result lines with the id and time that their snapshots keep; ``above`` is the largest id given before."""
    return identified(located(spark.read.text(path)), above)

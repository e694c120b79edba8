"""Host exports and reputation reports, read from files already collected.

A discovery source is any function that returns ``url, source, source_meta``. Every
record of a source has an outcome (``*_outcomes``): what a parser leaves out is counted
by reason, and what cannot be read at all is handed out (``*_rejects``).
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.functions.texts import strip
from vitrine.sources.split_json import read_array_objects

_MATCH = (
    "ip_str string, port int, asn string, org string, hostnames array<string>, "
    "location struct<country_code: string>, product string"
)
_HOST = (
    "ip string, autonomous_system struct<asn: bigint, name: string>, "
    "services array<struct<port: int, service_name: string, "
    "extended_service_name: string, transport_protocol: string>>"
)
_PAGE = "matches array<string>, _whole string"
_CORRUPT = {"columnNameOfCorruptRecord": "_whole"} | schemas.ANY_LENGTH
_REPORT = (
    "data struct<attributes: struct<last_analysis_stats: map<string, bigint>, "
    "type_description: string, meaningful_name: string>>"
)


def _service_url(ip: Column, port: Column, https: Column) -> Column:
    """Root URL of a service; IPv6 in brackets, the default port left out."""
    scheme = F.when(https, "https").otherwise("http")
    host = F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
    default = F.when(https, 443).otherwise(80)
    suffix = F.when(port == default, "").otherwise(F.concat(F.lit(":"), port.cast("string")))
    return F.concat(scheme, F.lit("://"), host, suffix, F.lit("/"))


def _read_pages(pages: DataFrame) -> DataFrame:
    """Pages with their matches as texts; ``_outcome`` is set where a page has none that can be read."""
    read = pages.withColumn("_p", F.from_json("value", _PAGE, _CORRUPT))
    outcome = (
        F.when(F.json_object_keys("value").isNull(), "unreadable")
        .when(F.col("_p._whole").isNotNull(), "mistyped")
        .when(F.col("_p.matches").isNull(), "no_matches")
    )
    return read.select("value", F.col("_p.matches").alias("_matches"), outcome.alias("_outcome"))


def _read_matches(pages: DataFrame) -> DataFrame:
    """Every match with its outcome: ok, mistyped (a value of another type, or no object) or no_address."""
    return _parsed(_read_pages(pages).where("_outcome IS NULL").select(F.explode("_matches").alias("raw")))


def _parsed(matches: DataFrame) -> DataFrame:
    parsed = matches.select(
        F.from_json("raw", f"{_MATCH}, _whole string", _CORRUPT).alias("m"),
        F.coalesce(F.array_contains(F.json_object_keys("raw"), "ssl"), F.lit(False)).alias("has_ssl"),
        F.json_object_keys("raw").isNull().alias("no_object"),
    )
    addressed = (F.coalesce("m.ip_str", F.lit("")) != "") & F.col("m.port").isNotNull()
    # a match whose other fields hold values of another type still has its address
    outcome = F.when(addressed, "ok").when(F.col("no_object") | F.col("m._whole").isNotNull(), "mistyped").otherwise("no_address")
    return parsed.withColumn("outcome", outcome)


def parse_host_search(pages: DataFrame) -> DataFrame:
    """Search result pages (``value``: JSON with ``matches``) to discovered URLs.

    https is told by the presence of an ``ssl`` key, whatever its value, which a
    typed read cannot see; each match is therefore kept as text once.
    """
    return _discovered(_read_matches(pages))


def _discovered(matches: DataFrame) -> DataFrame:
    parsed = matches.where("outcome = 'ok'")
    https = F.col("has_ssl") | (F.col("m.port") == 443)
    return parsed.select(
        _service_url(F.col("m.ip_str"), F.col("m.port"), https).alias("url"),
        F.lit("host_search").alias("source"),
        F.struct(
            F.col("m.ip_str").alias("ip"), "m.port", "m.asn", "m.org", "m.hostnames",
            F.col("m.location.country_code").alias("country"), "m.product",
        ).alias("source_meta"),
    )


def host_search_rejects(pages: DataFrame) -> DataFrame:
    """Pages that gave no match: ``value, outcome`` (unreadable, mistyped or no_matches)."""
    return _read_pages(pages).where("_outcome IS NOT NULL").select("value", F.col("_outcome").alias("outcome"))


def host_search_outcomes(pages: DataFrame) -> DataFrame:
    """``outcome, n`` of rejected pages and of all matches."""
    return _counted(host_search_rejects(pages).select("outcome").unionByName(_read_matches(pages).select("outcome")))


def _counted(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def read_host_search(spark: SparkSession, path: str) -> DataFrame:
    """Host-search export: one JSON result page per file, read as one row each."""
    return parse_host_search(spark.read.text(path, wholetext=True))


def read_large_host_search(spark: SparkSession, path: str) -> DataFrame:
    """Host-search export whose files are too large for one row: the matches of each file are found by many tasks."""
    return _discovered(_parsed(read_array_objects(spark, path, "matches").select(F.col("value").alias("raw"))))


def _read_hosts(lines: DataFrame) -> DataFrame:
    """Host lines (``value``), typed; ``outcome`` is set where a line is unreadable, mistyped or has no services."""
    read = lines.where(strip(F.col("value")) != "").withColumn("h", F.from_json("value", f"{_HOST}, _whole string", _CORRUPT))
    outcome = (
        F.when(F.json_object_keys("value").isNull(), "unreadable")
        .when(F.col("h.services").isNull() & F.col("h._whole").isNotNull(), "mistyped")
        .when(F.coalesce(F.size("h.services"), F.lit(0)) < 1, "no_services")
    )
    return read.withColumn("outcome", outcome)


def _service_outcome(service: Column) -> Column:
    name = F.upper(F.coalesce(service["service_name"], F.lit("")))
    extended = F.upper(F.coalesce(service["extended_service_name"], F.lit("")))
    web = name.isin("HTTP", "HTTPS") | extended.isin("HTTP", "HTTPS")
    return F.when(~web, "other_service").when(service["port"].isNull(), "no_port").otherwise("ok")


def host_services_rejects(lines: DataFrame) -> DataFrame:
    """Host lines that gave no service: ``value, outcome`` (unreadable, mistyped or no_services)."""
    return _read_hosts(lines).where("outcome IS NOT NULL").select("value", "outcome")


def host_services_outcomes(lines: DataFrame) -> DataFrame:
    """``outcome, n`` of rejected lines and of all services; blank lines are no records."""
    read = _read_hosts(lines)
    services = read.where("outcome IS NULL").select(F.explode("h.services").alias("s"))
    return _counted(read.where("outcome IS NOT NULL").select("outcome").unionByName(services.select(_service_outcome(F.col("s")).alias("outcome"))))


def parse_host_services(hosts: DataFrame) -> DataFrame:
    """Host records (typed) to one URL per HTTP or HTTPS service with a port."""
    services = hosts.select("ip", "autonomous_system", F.explode("services").alias("s"))
    web = services.filter(_service_outcome(F.col("s")) == "ok")
    extended = F.upper(F.coalesce("s.extended_service_name", F.lit("")))
    https = (extended == "HTTPS") | (F.col("s.port") == 443)
    no_text = F.lit(None).cast("string")
    return web.select(
        _service_url(F.col("ip"), F.col("s.port"), https).alias("url"),
        F.lit("host_services").alias("source"),
        F.struct(
            F.col("ip"),
            F.lit(None).cast("int").alias("port"),
            F.col("autonomous_system.asn").cast("string").alias("asn"),
            no_text.alias("org"),
            F.lit(None).cast("array<string>").alias("hostnames"),
            no_text.alias("country"),
            no_text.alias("product"),
        ).alias("source_meta"),
    )


def read_host_services(spark: SparkSession, path: str) -> DataFrame:
    """Host/service export: one JSON host per line, of any length."""
    lines = spark.read.text(path)
    return parse_host_services(_read_hosts(lines).where("outcome IS NULL").select("h.*"))


def host_services_schema() -> str:
    return _HOST


def parse_reputation(reports: DataFrame) -> DataFrame:
    """Stored lookup answers (``sha256, status, body``) to ``sha256, vt``."""
    attributes = F.col("_r.data.attributes")
    stats = attributes["last_analysis_stats"]
    total = F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda s, n: s + n)
    number = lambda key: F.coalesce(stats[key], F.lit(0).cast("bigint"))
    text = lambda key: F.coalesce(attributes[key], F.lit(""))
    none, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def report(found, malicious, suspicious, total, kind, name, error):
        return F.struct(
            F.lit(found).alias("found"), malicious.alias("malicious"),
            suspicious.alias("suspicious"), total.alias("total"), kind.alias("type"),
            name.alias("name"), error.alias("error"),
        )

    read = F.from_json("body", f"{_REPORT}, _whole string", _CORRUPT)
    # an object is an answer even where a field of it has another type
    is_json = F.col("_r._whole").isNull() & (strip(F.col("body")) != "") | F.json_object_keys("body").isNotNull()
    answered = (F.col("status") == 200) & F.coalesce(is_json, F.lit(False))
    parsed = reports.withColumn("_r", read)
    vt = (
        F.when(answered, report(
            True, number("malicious"), number("suspicious"), F.coalesce(total, F.lit(0)),
            text("type_description"), text("meaningful_name"), no_text))
        .when(F.col("status") == 404, report(False, none, none, none, no_text, no_text, no_text))
        .when(F.col("status") == 200, report(
            False, none, none, none, no_text, no_text, F.lit("unreadable report")))
        .otherwise(report(
            False, none, none, none, no_text, no_text,
            F.concat(F.lit("vt "), F.col("status").cast("string"))))
    )
    return parsed.select("sha256", vt.cast(f"struct<{schemas.VT}>").alias("vt"))


_ANSWER = "sha256 string, status int, body string"


def _read_answers(lines: DataFrame) -> DataFrame:
    """Answer lines (``value``), typed, with their outcome: ok, unreadable, mistyped or no_key."""
    read = lines.where(strip(F.col("value")) != "").withColumn("a", F.from_json("value", f"{_ANSWER}, _whole string", _CORRUPT))
    outcome = (
        F.when(F.json_object_keys("value").isNull(), "unreadable")
        .when(F.col("a._whole").isNotNull(), "mistyped")
        .when(F.coalesce("a.sha256", F.lit("")) == "", "no_key")
        .otherwise("ok")
    )
    return read.withColumn("outcome", outcome)


def reputation_rejects(lines: DataFrame) -> DataFrame:
    """Answer lines that belong to no hash: ``value, outcome``."""
    return _read_answers(lines).where("outcome <> 'ok'").select("value", "outcome")


def reputation_outcomes(lines: DataFrame) -> DataFrame:
    """``outcome, n`` of all answer lines; blank lines are no records."""
    return _counted(_read_answers(lines))


def read_reputation(spark: SparkSession, path: str) -> DataFrame:
    """Reputation export: JSON lines of ``sha256, status, body``, of any length."""
    answers = _read_answers(spark.read.text(path)).where("outcome = 'ok'").select("a.*")
    return parse_reputation(answers.drop("_whole"))

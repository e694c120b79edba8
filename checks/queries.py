"""Every operator as a registered query over the given tables.

Nested results are flattened (arrays joined by ``|``) so that both engines give
plain columns.
"""
from pyspark.sql import Column, DataFrame
from functools import partial

from pyspark.sql import functions as F

from checks import tables as T
from vitrine.functions import files, fingerprints, texts, tokens, urls
from vitrine.functions import patterns as P
from vitrine.operators import candidates as cand
from vitrine.operators import classify as cls
from vitrine.operators import features as feat
from vitrine.operators import host_files as hf
from vitrine.operators import clusters, hosts, inventory, listing, network, payloads, records, text_index
from vitrine.plans import report
from vitrine.sources import batches, captures, exports, payload_files
from vitrine.sources.tables import materialized, new_folder


def _joined(column: str, name: str | None = None) -> Column:
    return F.array_join(column, "|").alias(name or column)


def _flat_hits(df: DataFrame, column: str) -> DataFrame:
    return df.select("snapshot_id", f"{column}.*")


def _features(s, d):
    return feat.extract_features(T.snapshots(s, d), T.entries(s, d))


def _judged(s, d):
    """Verdicts, which ask for no extensions: entries are grouped once, by snapshot."""
    return cls.classify(feat.extract_features(T.snapshots(s, d), T.entries(s, d), exts=None))


def _latest_profiles(s, d):
    return T.latest(s, d), T.profiles(s, d)


def _hosted(s, d):
    """Snapshots with the host of their candidate."""
    places = cand.with_host_port(T.candidates(s, d)).select("candidate_id", "host", "port", "url")
    return T.snapshots(s, d).join(places, "candidate_id")


def _ranked(s, d):
    files_ = hf.host_entries(T.records(s, d), T.entries(s, d))
    joined = hf.join_hashes(files_, T.payload_hashes(s, d))
    return hf.ranked_files(joined)


def _inventory(s, d):
    return hf.host_file_inventory(T.records(s, d), T.entries(s, d), T.SALT, T.payload_hashes(s, d))


# --- sources ---------------------------------------------------------------

def src_host_search(s, d):
    rows = exports.parse_host_search(T.search_pages(s, d))
    return rows.select("url", "source", "source_meta.*").withColumn("hostnames", F.array_join("hostnames", "|"))


def src_large_host_search(s, d):
    """The same pages written to files that are cut anywhere."""
    path = new_folder(s)
    T.search_pages(s, d).write.text(path)
    rows = exports.read_large_host_search(s, path)
    return rows.select("url", "source", "source_meta.*").withColumn("hostnames", F.array_join("hostnames", "|"))


def src_host_services(s, d):
    lines = T.service_lines(s, d).select(F.from_json("value", exports.host_services_schema()).alias("h"))
    rows = exports.parse_host_services(lines.select("h.*"))
    return rows.select("url", "source", F.col("source_meta.ip").alias("ip"), F.col("source_meta.asn").alias("asn"))


def ingest_captures(s, d):
    snaps, _, _ = captures.ingest_captures(T.capture_lines(s, d), T.candidates(s, d))
    entry = lambda e: F.concat_ws(":", e["name"], e["href"], e["is_dir"].cast("string"), F.coalesce(e["size"].cast("string"), F.lit("-")), e["path"])
    return snaps.select(
        "snapshot_id", "candidate_id", "http_status", "final_url", "server_kind", "title", "is_open_dir",
        "entry_count", "error", "template_sha256", "favicon_sha256",
        F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["k"], h["v"])), "|").alias("headers"),
        F.array_join(F.transform("listing_entries", entry), "|").alias("entries"),
    )


def ingest_stats(s, d):
    return captures.ingest_captures(T.capture_lines(s, d), T.candidates(s, d))[2]


def ingest_rejects(s, d):
    return captures.ingest_captures(T.capture_lines(s, d), T.candidates(s, d))[1]


def pages_to_snapshots(s, d):
    return listing.snapshots_from_pages(T.table(s, d, "pages")).drop("listing_entries", "template_sha256")


def listing_snapshots(s, d):
    """Rendered listings and given pages to snapshots, entries and template included."""
    pages = T.all_pages(s, d)
    snaps, hashed = listing.snapshots_from_pages(pages).drop("template_sha256"), listing.template_hashes(pages)
    entry = lambda e: F.concat_ws("|", *[F.coalesce(e[c].cast("string"), F.lit("-")) for c in ("name", "href", "is_dir", "size", "mtime", "path")])
    first = hashed.groupBy("template_sha256").agg(F.min("page_id").alias("first_page"))
    return snaps.join(hashed.join(first, "template_sha256"), "page_id").select(
        "page_id", "final_url", "title", "is_open_dir", "server_kind", "entry_count",
        F.array_join(F.transform("listing_entries", entry), ";").alias("entries"), "first_page",
    )


def _selected(s, d):
    return payloads.select_payloads(T.entries(s, d), _hosted(s, d))


def _hash_results(s, d):
    """Hash results of the selected files, some failed, some of unknown URLs."""
    key = F.col("snapshot_id")
    url = F.when(key % 13 == 5, F.concat("url", F.lit("?x"))).otherwise(F.col("url"))
    failed = key % 4 == 3
    return _selected(s, d).dropDuplicates(["snapshot_id", "url"]).select(
        "snapshot_id", url.alias("url"),
        F.when(~failed, F.sha2("url", 256)).alias("sha256"),
        F.when(~failed, F.md5("url")).alias("md5"),
        F.lit(None).cast("string").alias("tlsh"),
        F.when(~failed, F.length("url")).alias("size"),
        F.when(failed, "http 404").alias("error"),
    )


def load_hashes(s, d):
    rows = payloads.load_hashes(_hash_results(s, d), _selected(s, d))
    return rows.drop("hash_id", "vt", "hashed_at")


def src_reputation(s, d):
    return exports.parse_reputation(T.report_lines(s, d)).select("sha256", "vt.*")


def hash_payload_files(s, d):
    return payload_files.hash_landed(T.landed_files(s, d))


# --- candidates ------------------------------------------------------------

def _all_urls(s, d):
    real = T.table(s, d, "pages").select("url")
    return real.unionByName(T.discovered(s, d).select("url"))


def normalize_urls(s, d):
    return cand.normalize_urls(_all_urls(s, d))


def dedup_keys(s, d):
    return cand.with_dedup_key(_all_urls(s, d))


def host_port(s, d):
    return cand.with_host_port(_all_urls(s, d))


def scope_filter(s, d):
    return cand.scope_filter(T.discovered(s, d), cidrs=("8.0.0.0/7",)).select("input_order", "url")


def ingest_candidates(s, d):
    known = cand.with_dedup_key(T.discovered(s, d).filter("input_order % 36 = 1")).select("dedup_key")
    new = cand.ingest_candidates(T.discovered(s, d), known)
    return new.select("dedup_key", "url", "source", F.col("source_meta.seed").alias("seed"), "status")


# --- listings --------------------------------------------------------------

def extract_entries(s, d):
    return listing.extract_entries(T.all_pages(s, d), ("name", "href", "is_dir"))


def entry_paths(s, d):
    return listing.extract_entries(T.all_pages(s, d), ("path",))


def entry_meta(s, d):
    return listing.extract_entries(T.all_pages(s, d), ("size", "mtime"))


def entry_size(s, d):
    return T.size_texts(s, d).withColumn("size", texts.size_col(F.col("text")))


def entry_mtime(s, d):
    rows = T.mtime_texts(s, d).withColumn("mtime", texts.mtime_col(F.col("text")))
    return rows.withColumn("known", texts.mtime_ts(F.col("mtime")).isNotNull())


def validate_listing(s, d):
    return listing.validate_listing(T.all_pages(s, d))


def server_kind(s, d):
    return listing.with_server_kind(T.all_pages(s, d)).select("page_id", "server_kind")


def server_banner(s, d):
    return T.header_rows(s, d).select("snapshot_id", fingerprints.server_banner(F.col("headers")).alias("server_banner"))


def fp_body(s, d):
    return T.table(s, d, "pages").select("page_id", fingerprints.body_hash(F.col("html")).alias("raw_html_sha256"))


def fp_headers(s, d):
    return T.header_rows(s, d).select("snapshot_id", fingerprints.header_hash(F.col("headers")).alias("header_order_sha256"))


def fp_template(s, d):
    hashed = listing.template_hashes(T.all_pages(s, d))
    first = hashed.groupBy("template_sha256").agg(F.min("page_id").alias("first_page"))
    return hashed.join(first, "template_sha256").select("page_id", "first_page")


def fp_favicon(s, d):
    status = F.when(F.col("o_orderstatus") == "P", 404).otherwise(200)
    body = F.when(F.col("o_orderkey") % 6 == 0, "").when(F.col("o_orderkey") % 6 != 1, F.col("o_orderpriority"))
    return T.table(s, d, "orders").select("o_orderkey", fingerprints.favicon_hash(status, body).alias("favicon_sha256"))


def _certificates(s, d):
    cn = lambda c: F.concat(F.lit("CN="), (c % 7).cast("string"))
    return T.table(s, d, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"),
        cn(F.col("o_custkey")).alias("issuer"), cn(F.col("o_orderkey")).alias("subject"))


def tls_flags(s, d):
    return _certificates(s, d).withColumn("self_signed", fingerprints.self_signed(F.col("issuer"), F.col("subject")))


# --- features and verdict --------------------------------------------------

def feature_counts(s, d):
    return _features(s, d).select("snapshot_id", "entry_count", "file_count", "dir_count")


def sensitive_hits(s, d):
    return _flat_hits(_features(s, d), "sensitive_hits")


def payload_hits(s, d):
    return _flat_hits(_features(s, d), "payload_hits")


def top_exts(s, d):
    return feat.top_exts(T.entries(s, d))


def mirror_ratio(s, d):
    return _features(s, d).select("snapshot_id", "mirror_files", "mirror_ratio")


def cert_flag(s, d):
    signed = fingerprints.self_signed(F.col("issuer"), F.col("subject"))
    tls = F.when(F.col("snapshot_id") % 3 != 0, F.struct(signed.alias("self_signed")))
    snaps = _certificates(s, d).select("snapshot_id", tls.alias("tls"))
    return feat.extract_features(snaps, T.entries(s, d)).select("snapshot_id", "cert_self_signed")


def classify(s, d):
    return _judged(s, d).select("snapshot_id", "label", "extractor_version", "ruleset_version")


def confidence(s, d):
    return _judged(s, d).select("snapshot_id", "confidence")


def reasons(s, d):
    return _judged(s, d).select("snapshot_id", _joined("reasons"))


def classify_pending(s, d, limit=200):
    done = cls.classify_pending(T.snapshots(s, d), T.classifications(s, d), T.entries(s, d), limit, exts=None)
    return done.select("snapshot_id", "label", "confidence", _joined("reasons"), "ruleset_version")


def label_distribution(s, d):
    return cls.label_distribution(T.classifications(s, d))


def _gold(s, d):
    """Snapshots with the verdict their block of names is made for."""
    meant = ["benign_index", "intentional_public", "sensitive_exposure", "malicious_staging"]
    expected = F.get(F.array(*[F.lit(x) for x in meant]), (F.col("snapshot_id") % 8 % 4).cast("int"))
    return _judged(s, d).select("snapshot_id", "label", expected.alias("expected"))


def goldset_eval(s, d):
    return cls.goldset_eval(_gold(s, d))[1]


def goldset_accuracy(s, d):
    return cls.goldset_eval(_gold(s, d))[0]


def reclassify(s, d):
    return cls.reclassify(T.classifications(s, d), "2.0.0").select("snapshot_id", "label", "confidence", "ruleset_version")


# --- inventory, network ----------------------------------------------------

def interest_counts(s, d):
    return inventory.interest_counts(T.entries(s, d))


def interest_examples(s, d):
    return inventory.interest_examples(T.entries(s, d), 2).select("snapshot_id", "category", _joined("examples"))


def size_stats(s, d):
    return inventory.size_stats(T.entries(s, d))


def inventory_all(s, d):
    rows = inventory.inventory(T.entries(s, d))
    return rows.select(*[c for c in rows.columns if c != "interest_hits"], "interest_hits.*")


def network_profile(s, d):
    orgs = T.candidates(s, d).select("candidate_id", F.col("source_meta.org").alias("org"))
    return network.network_profile(orgs)


def profile_breakdown(s, d):
    return network.profile_breakdown(T.candidates(s, d).select(F.col("source_meta.org").alias("org")))


# --- hosts -----------------------------------------------------------------

def host_signals(s, d):
    return hosts.host_signals(T.records(s, d)).select("host", _joined("signals"))


def host_breakdown(s, d):
    return hosts.host_breakdown(T.records(s, d)).select("verdict", _joined("signals"), "ports")


def host_breakdown_all(s, d):
    return hosts.host_breakdown(T.records(s, d), flagged_only=False).select("verdict", _joined("signals"), "ports")


def bait_categories(s, d):
    files_ = T.entries(s, d).filter("not is_dir").join(_hosted(s, d).select("snapshot_id", "host"), "snapshot_id")
    return hosts.bait_categories(files_, "host").select("host", _joined("bait"))


def identical_fanout(s, d):
    return hosts.identical_fanout(_hosted(s, d))


def honeypot(s, d):
    placed = _hosted(s, d)
    files_ = T.entries(s, d).filter("not is_dir").join(placed.select("snapshot_id", "host"), "snapshot_id")
    flagged = hosts.honeypot(hosts.bait_categories(files_, "host"), hosts.identical_fanout(placed))
    return flagged.select("host", "flag", "score", _joined("reasons"))


# --- payloads, reputation --------------------------------------------------

def payload_names(s, d):
    return T.entries(s, d).select("name", files.is_payload(F.col("name")).alias("is_payload"))


def select_payloads(s, d, limit=2):
    return payloads.select_payloads(T.entries(s, d), _hosted(s, d), limit).select("snapshot_id", "name", "url")


def hash_pending(s, d, limit=50):
    pending = payloads.hash_pending(T.snapshots(s, d), T.classifications(s, d), T.payload_hashes(s, d).filter("snapshot_id % 10 < 3"), limit=limit)
    return pending.select("snapshot_id")


def hash_summary(s, d):
    return payloads.hash_summary(T.payload_hashes(s, d))


def hashed_types(s, d):
    return payloads.hashed_types(T.payload_hashes(s, d))


def vt_pending(s, d, limit=100):
    return payloads.vt_pending(T.payload_hashes(s, d), limit).select("snapshot_id", "name", "sha256")


def vt_enrich(s, d):
    hashes = T.payload_hashes(s, d)
    waiting = hashes.filter(F.col("vt").isNull() & (F.col("snapshot_id") % 4 != 0)).select(
        "sha256", F.struct(F.lit(True).alias("found"), F.col("snapshot_id").alias("malicious")).alias("vt")
    )
    return payloads.vt_enrich(hashes, waiting).select("snapshot_id", "name", "sha256", "vt.*")


def vt_summary(s, d):
    return payloads.vt_summary(T.payload_hashes(s, d))


def vt_state(s, d):
    return T.payload_hashes(s, d).select(
        "snapshot_id", "name", payloads.vt_state_col(F.col("error"), F.col("vt")).alias("state"))


# --- host files ------------------------------------------------------------

def host_tokens(s, d):
    host = urls.split_url(F.col("url"))
    rows = T.candidates(s, d).withColumn("_u", host).select(F.col("_u.host").alias("host")).distinct()
    return rows.withColumn("token", tokens.host_token(F.col("host"), T.SALT))


def file_alarms(s, d):
    vt = F.when(F.col("snapshot_id") % 30 == 1, 3)
    return T.entries(s, d).select("snapshot_id", "name", files.is_alarm(F.col("name"), vt).alias("alarm"))


def file_rank(s, d):
    vt = F.when(F.col("snapshot_id") % 30 == 1, 3)
    return T.entries(s, d).select(
        "snapshot_id", "name", "size", files.file_rank(F.col("name"), F.col("size"), vt).alias("rank"))


def _disclosed(s, d, disclose):
    vt = F.struct((F.col("snapshot_id") % 30 == 1).cast("bigint").alias("malicious"))
    hash_ = F.when(F.col("snapshot_id") % 2 == 0, F.struct(
        F.sha2("name", 256).alias("sha256"), F.lit("").alias("tlsh"), vt.alias("vt")))
    rows = hf.ranked_files(T.entries(s, d).filter("not is_dir").withColumn("hash", hash_))
    shown = hf.disclose_files(rows, disclose)
    return shown.select("snapshot_id", "rank", "file.kind", "file.name", "file.ext", "file.size", "file.mtime",
                        "file.alarm", "file.sha256", "file.tlsh", F.col("file.vt.malicious").alias("malicious"))


def file_disclosure(s, d):
    return _disclosed(s, d, False)


def file_disclosure_full(s, d):
    return _disclosed(s, d, True)


def _loaded(s, d):
    """Hash rows as the library loads them, two per file, numbered as they arrive."""
    found = T.results(s, d)
    return payloads.load_hashes(found.drop("name"), found.withColumn("pos", F.lit(0)), order=("arrived",))


def load_hashes_in_order(s, d):
    return _loaded(s, d).select("hash_id", "snapshot_id", "name", "sha256", "size", "error")


def vt_pending_in_order(s, d, limit=100):
    return payloads.vt_pending(_loaded(s, d), limit).select("hash_id", "snapshot_id", "name", "sha256")


def hash_join_loaded(s, d):
    """The last loaded result of a host's file counts, as where ids count up."""
    files_ = hf.host_entries(T.records(s, d), T.entries(s, d))
    return hf.join_hashes(files_, _loaded(s, d)).select("snapshot_id", "host", "name", "size", "hash.sha256")


def hash_join(s, d):
    files_ = hf.host_entries(T.records(s, d), T.entries(s, d))
    return hf.join_hashes(files_, T.payload_hashes(s, d)).select(
        "snapshot_id", "host", "name", "size", "hash.sha256", F.col("hash.vt.malicious").alias("malicious"))


def top_files_per_host(s, d):
    return hf.top_files(_ranked(s, d), 12).select("host", "place", "rank", "name", "size", "mtime", "alarm")


def host_inventory(s, d):
    rows = _inventory(s, d)
    names = F.transform("files", lambda f: F.coalesce(f["name"], f["ext"]))
    return rows.select(
        "token", "verdict", _joined("signals"), F.array_join(names, "|").alias("files"),
        F.array_join(F.transform("files", lambda f: F.coalesce(f["size"].cast("string"), F.lit("-"))), "|").alias("sizes"),
        "shown", "total", "hidden", "has_meta",
        F.array_join("honeypot.reasons", "|").alias("honeypot"),
    )


def host_file_rows(s, d):
    rows = hf.host_file_rows(T.records(s, d), T.entries(s, d), T.SALT, T.payload_hashes(s, d), disclose=True)
    return rows.select("token", "place", "rank", "file.kind", "file.name", "file.size", "file.alarm")


# --- report ----------------------------------------------------------------

def corpus_funnel(s, d):
    return report.corpus_funnel(T.candidates(s, d), T.snapshots(s, d))


def latest_open(s, d):
    rows = T.latest(s, d)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("candidate_id", "snapshot_id", day("fetched_at"), day("first_open_at"), "first_open_id", "server_kind")


def false_positive_rate(s, d):
    return report.false_positive_rate(T.snapshots(s, d))


def network_report(s, d):
    return report.network_report(T.latest(s, d), T.candidates(s, d))


def top_providers(s, d):
    return report.top_providers(T.latest(s, d), T.candidates(s, d))


def top_countries(s, d):
    return report.top_countries(T.latest(s, d), T.candidates(s, d))


def label_shares(s, d):
    return report.label_shares(T.latest(s, d), T.classifications(s, d))


def signal_prevalence(s, d):
    return report.signal_prevalence(T.latest(s, d), T.classifications(s, d))


def _stored(s, d):
    """Classifications with the extensions of each listing stored beside the other features."""
    return T.classifications(s, d, T.profiles(s, d, P.TOP_EXTS))


def ext_prevalence(s, d):
    return report.ext_prevalence(T.latest(s, d), _stored(s, d))


def stored_exts(s, d):
    """Extensions as stored with the verdict, kept when stored features are judged again."""
    again = cls.reclassify(_stored(s, d), "2.0.0")
    listed = F.array_join(F.transform("features.top_exts", lambda e: F.concat_ws("=", e["ext"], e["n"].cast("string"))), "|")
    return again.select("snapshot_id", "label", listed.alias("top_exts"), "ruleset_version")


def server_software(s, d):
    return report.server_software(T.latest(s, d))


def interest_prevalence(s, d):
    return report.interest_prevalence(*_latest_profiles(s, d))


def exposed_volume(s, d):
    return report.exposed_volume(*_latest_profiles(s, d))


def kpis(s, d):
    latest, verdicts = T.latest(s, d), T.classifications(s, d)
    return report.kpis(report.label_shares(latest, verdicts), report.signal_prevalence(latest, verdicts),
                       hosts.host_summary(hf.flagged_records(T.records(s, d))))


def one_in(s, d):
    counts = _judged(s, d).groupBy("server_kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label").isin("malicious_staging", "sensitive_exposure")).alias("k"))
    return counts.withColumn("one_in", report.one_in_col(F.col("n"), F.col("k")))


# --- queues, browsing ------------------------------------------------------

def pending_queue(s, d, limit=50):
    return cand.pending_queue(T.candidates(s, d), limit).select("candidate_id", "url")


def pending_count(s, d):
    return cand.pending_count(T.candidates(s, d))


def recapture_queue(s, d, limit=50):
    return cand.recapture_queue(T.candidates(s, d), T.snapshots(s, d), limit).select("candidate_id", "url")


def advance_status(s, d):
    new = T.snapshots(s, d).withColumn("error", F.when(F.col("http_status") == 404, "timeout").otherwise(""))
    last = F.lit(None).cast("timestamp_ntz")
    rows = cand.advance_status(T.candidates(s, d).withColumn("last_captured_at", last), new)
    return rows.select("candidate_id", "status", F.date_format("last_captured_at", "yyyy-MM-dd").alias("last_captured_at"))


def browse(s, d):
    rows = _hosted(s, d).select("snapshot_id", "url", "server_kind", "is_open_dir", "http_status", "fetched_at")
    found = cand.browse(
        rows, {"server_kind": ["apache", "nginx"], "is_open_dir": True, "http_status": 200},
        search="H1", search_columns=("url",), date_column="fetched_at", start="1996-01-01", end="1999-12-31")
    return found.select("snapshot_id", "url", "server_kind")


def _fingerprints(s, d):
    return materialized(clusters.fingerprint_values(T.fingerprinted(s, d), T.FINGERPRINTS))


def host_clusters(s, d):
    return clusters.host_clusters(_fingerprints(s, d))


def cluster_profiles(s, d):
    values = _fingerprints(s, d)
    return clusters.cluster_profiles(clusters.host_clusters(values), values)


def _in_batches(s, d):
    """Snapshots appended as three batches by day, the second one twice: first with other rows, then rightly."""
    snaps = T.snapshots(s, d)
    day = F.col("fetched_at")
    parts = {"a": day < "1994-01-01", "b": (day >= "1994-01-01") & (day < "1997-01-01"), "c": day >= "1997-01-01"}
    path = new_folder(s)
    batches.append_batch(snaps.filter(parts["a"]), path, "a")
    batches.append_batch(snaps.filter(parts["b"]).withColumn("server_kind", F.lit("lost")), path, "b")
    batches.append_batch(snaps.filter(parts["c"]), path, "c")
    batches.append_batch(snaps.filter(parts["b"]), path, "b")
    return path


def append_twice(s, d):
    """Appended batches read back, one of them added twice."""
    path = _in_batches(s, d)
    rows = batches.read_batches(s, path, T.snapshots(s, d).schema, name="batch")
    return rows.select("batch", "snapshot_id", "candidate_id", "server_kind", "http_status")


def append_manifest(s, d):
    """What the manifest says after the retry and a compaction of two batches into one."""
    path = _in_batches(s, d)
    batches.compact(s, path, T.snapshots(s, d).schema, ["a", "b"], "ab")
    return batches.manifest(s, path).select("batch", "version", "n")


def latest_open_merged(s, d):
    """The newest listings kept up to date batch by batch: stored state and new rows only."""
    path = _in_batches(s, d)
    schema, state = T.snapshots(s, d).schema, None
    for batch in "abc":
        new = batches.read_batches(s, path, schema, [batch])
        merged = records.latest_open(new, "server_kind") if state is None else records.merged_latest(state, new, "server_kind")
        state = materialized(merged)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return state.select("candidate_id", "snapshot_id", day("fetched_at"), day("first_open_at"), "first_open_id", "server_kind")


def pending_merged(s, d):
    """Listings without a verdict, kept up to date batch by batch."""
    path = _in_batches(s, d)
    schema, verdicts = T.snapshots(s, d).schema, T.classifications(s, d).select("snapshot_id", "ruleset_version")
    state = T.snapshots(s, d).limit(0)
    for batch in "abc":
        new = batches.read_batches(s, path, schema, [batch])
        state = materialized(cls.merged_pending(state, new, verdicts.join(new.select("snapshot_id"), "snapshot_id", "left_semi")))
    return state.select("snapshot_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_at"))


def report_tables(s, d):
    """All count sections of the report from one pass over one table."""
    found = report.report_records(T.candidates(s, d), T.snapshots(s, d), _stored(s, d), T.profiles(s, d))
    return report.report_rows(materialized(found))


def browse_indexed(s, d):
    rows = materialized(_hosted(s, d).select("snapshot_id", "url", "server_kind", "is_open_dir", "http_status", "fetched_at"))
    path = new_folder(s)
    text_index.save_index(text_index.build_index(rows, "snapshot_id", ("url", "server_kind")), path)
    index = s.read.parquet(path)
    found = cand.browse(rows, {"http_status": 200}, "H10", ("url", "server_kind"), "fetched_at", index=(index, "snapshot_id"))
    return found.select("snapshot_id", "url", "server_kind")


def search_documents(s, d):
    """Whole document texts searched by trigrams, a rare term and a common one."""
    docs = T.table(s, d, "documents").select("doc_id", "text")
    index = materialized(text_index.build_index(docs, "doc_id", ("text",)))
    parts = [text_index.search_indexed(docs, index, "doc_id", ("text",), t).select("doc_id", F.lit(t).alias("term")) for t in ("license", "Ung der", "zz")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def source_outcomes(s, d):
    """Every record of the three sources by outcome, unreadable ones among them."""
    broken = T.broken_lines(s, d)
    answers = T.report_lines(s, d).select(F.to_json(F.struct("sha256", "status", "body")).alias("value"))
    parts = {
        "host_search": exports.host_search_outcomes(T.search_pages(s, d).unionByName(broken)),
        "host_services": exports.host_services_outcomes(T.service_lines(s, d).unionByName(broken)),
        "reputation": exports.reputation_outcomes(answers.unionByName(broken)),
    }
    rows = [part.select(F.lit(name).alias("source"), "outcome", "n") for name, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


QUERIES = {
    "src_large_host_search": src_large_host_search, "listing_snapshots": listing_snapshots,
    "host_clusters": host_clusters, "cluster_profiles": cluster_profiles,
    "append_twice": append_twice, "append_manifest": append_manifest,
    "latest_open_merged": latest_open_merged, "pending_merged": pending_merged,
    "load_hashes_in_order": load_hashes_in_order, "vt_pending_in_order": vt_pending_in_order, "hash_join_loaded": hash_join_loaded,
    "stored_exts": stored_exts, "report_tables": report_tables,
    "browse_indexed": browse_indexed, "search_documents": search_documents, "source_outcomes": source_outcomes,
    "src_host_search": src_host_search, "src_host_services": src_host_services,
    "ingest_captures": ingest_captures, "ingest_stats": ingest_stats, "ingest_rejects": ingest_rejects,
    "pages_to_snapshots": pages_to_snapshots, "load_hashes": load_hashes, "src_reputation": src_reputation,
    "hash_payload_files": hash_payload_files,
    "normalize_urls": normalize_urls, "dedup_keys": dedup_keys, "host_port": host_port,
    "scope_filter": scope_filter, "ingest_candidates": ingest_candidates,
    "extract_entries": extract_entries, "entry_paths": entry_paths, "entry_meta": entry_meta,
    "entry_size": entry_size, "entry_mtime": entry_mtime, "validate_listing": validate_listing,
    "server_kind": server_kind, "server_banner": server_banner,
    "fp_body": fp_body, "fp_headers": fp_headers, "fp_template": fp_template, "fp_favicon": fp_favicon,
    "tls_flags": tls_flags,
    "feature_counts": feature_counts, "sensitive_hits": sensitive_hits, "payload_hits": payload_hits,
    "top_exts": top_exts, "mirror_ratio": mirror_ratio, "cert_flag": cert_flag,
    "classify": classify, "confidence": confidence, "reasons": reasons, "classify_pending": classify_pending,
    "label_distribution": label_distribution, "goldset_eval": goldset_eval, "goldset_accuracy": goldset_accuracy,
    "reclassify": reclassify,
    "interest_counts": interest_counts, "interest_examples": interest_examples, "size_stats": size_stats,
    "inventory": inventory_all, "network_profile": network_profile, "profile_breakdown": profile_breakdown,
    "host_signals": host_signals, "host_breakdown": host_breakdown, "host_breakdown_all": host_breakdown_all,
    "bait_categories": bait_categories, "identical_fanout": identical_fanout, "honeypot": honeypot,
    "payload_names": payload_names, "select_payloads": select_payloads, "hash_pending": hash_pending,
    "hash_summary": hash_summary, "hashed_types": hashed_types,
    "vt_pending": vt_pending, "vt_enrich": vt_enrich, "vt_summary": vt_summary, "vt_state": vt_state,
    "host_tokens": host_tokens, "file_alarms": file_alarms, "file_rank": file_rank,
    "file_disclosure": file_disclosure, "file_disclosure_full": file_disclosure_full,
    "hash_join": hash_join, "top_files_per_host": top_files_per_host, "host_inventory": host_inventory,
    "host_file_rows": host_file_rows,
    "corpus_funnel": corpus_funnel, "latest_open": latest_open, "false_positive_rate": false_positive_rate,
    "network_report": network_report, "top_providers": top_providers, "top_countries": top_countries,
    "label_shares": label_shares, "signal_prevalence": signal_prevalence, "ext_prevalence": ext_prevalence,
    "server_software": server_software, "interest_prevalence": interest_prevalence,
    "exposed_volume": exposed_volume, "kpis": kpis, "one_in": one_in,
    "pending_queue": pending_queue, "pending_count": pending_count, "recapture_queue": recapture_queue,
    "advance_status": advance_status, "browse": browse,
}

for _name in ("classify_pending", "pending_queue", "recapture_queue", "hash_pending", "vt_pending", "select_payloads"):
    QUERIES[f"{_name}_all"] = partial(QUERIES[_name], limit=None)

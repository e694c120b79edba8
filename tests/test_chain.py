"""From an export to the host inventory: the rows of each stage are what the next one reads."""
import json

from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import candidates as cand
from vitrine.operators import payloads
from vitrine.operators.classify import classify_pending
from vitrine.operators.listing import explode_entries
from vitrine.plans.report import report_inputs, report_tables
from vitrine.sources import captures, exports, tables


def _capture(url, names):
    entries = [{"name": n, "href": n, "is_dir": False, "size": 9, "mtime": None, "path": f"/{n}"} for n in names]
    return json.dumps({
        "url": url, "error": "", "http_status": 200, "final_url": url, "headers": [], "server_banner": "", "server_kind": "nginx",
        "title": "Index of /", "is_open_dir": True, "listing_entries": entries, "entry_count": len(entries), "raw_html_sha256": url,
        "header_order_sha256": "", "template_sha256": "", "favicon_sha256": None, "tls": None})


def test_export_to_inventory(spark, tmp_path):
    (tmp_path / "export").mkdir()
    hosts = ["198.41.0.4", "198.41.0.4", "199.9.14.201", "10.1.1.1"]
    matches = [{"ip_str": h, "port": 80, "org": "Halm"} for h in hosts]
    (tmp_path / "export" / "a.json").write_text(json.dumps({"matches": matches}))
    found = exports.read_host_search(spark, str(tmp_path / "export")).withColumn("input_order", F.monotonically_increasing_id())
    known = tables.materialized(cand.ingest_candidates(found))
    assert set(f.split(" ")[0] for f in schemas.CANDIDATE.split(", ") if f[0] != " ") >= {"candidate_id", "first_seen"} and known.count() == 2
    assert cand.pending_queue(known).count() == 2
    (tmp_path / "captures.jsonl").write_text("\n".join([
        _capture("http://198.41.0.4/", ["kasse.sql", "teig_shell.jsp"]), _capture("http://199.9.14.201/", ["garten.odt"]), "{"]))
    snapshots, rejects, _ = captures.ingest_captures(captures.read_captures(spark, str(tmp_path / "captures.jsonl")), known)
    snapshots = tables.materialized(snapshots)
    assert rejects.count() == 1 and snapshots.where("snapshot_id is null or fetched_at is null").count() == 0
    entries = explode_entries(snapshots)
    narrow = snapshots.drop("entry_count", "listing_entries")
    none = spark.createDataFrame([], "snapshot_id long, ruleset_version string")
    verdicts = tables.materialized(classify_pending(narrow, none, entries))
    after = cand.advance_status(known, snapshots)
    assert {r["status"] for r in after.collect()} == {"captured"} and cand.pending_queue(after).count() == 0
    urls = snapshots.join(known, "candidate_id").select("snapshot_id", "url")
    picked = payloads.select_payloads(entries, urls)
    results = picked.select("snapshot_id", "url", F.sha2("url", 256).alias("sha256"), F.lit("").alias("md5"), F.lit("T1").alias("tlsh"),
                            F.lit(9).cast("long").alias("size"), F.lit("").alias("error"))
    hashes = tables.materialized(payloads.load_hashes(results, picked))
    assert payloads.vt_pending(hashes).count() == 1
    inputs = tuple(map(tables.materialized, report_inputs(after, snapshots, verdicts, entries)))
    report = report_tables(after, snapshots, verdicts, entries, hashes, "salt", inputs=inputs)
    row, = report["host_inventory"].collect()
    assert (row["verdict"], row["total"], row["files"][0]["name"]) == ("malicious", 2, "teig_shell.jsp")
    assert row["files"][0]["sha256"] == hashes.first()["sha256"]
    assert report["corpus_funnel"].first()["captured"] == 2

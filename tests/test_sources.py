"""Exports, capture results, hashes and reports."""
import hashlib
import json

from pyspark.sql import functions as F

from vitrine.functions.urls import resolved_path, resolved_url, split_url
from vitrine.operators import payloads
from vitrine.sources import captures, exports, payload_files, tables
from vitrine.streaming import ingest as streaming


def _ok(url, **changes):
    entries = [{"name": n, "href": n, "is_dir": False, "size": 7, "mtime": "2021-11-09T23:59", "path": f"/teig/{n}"} for n in ("rot.odt", "blau.odt")]
    whole = {"url": url, "error": "", "http_status": 206, "final_url": f"{url}teig/", "headers": [["x-ofen", "heiß"], ["server", "tonofen/3"]],
             "server_banner": "tonofen/3", "server_kind": "apache", "title": "Index of /teig", "is_open_dir": True,
             "listing_entries": entries, "entry_count": 2, "raw_html_sha256": "01f", "header_order_sha256": "02f", "template_sha256": "03f",
             "favicon_sha256": None, "tls": None}
    whole.update(changes)
    return json.dumps(whole)


LINES = [_ok("http://roggen.test/"), "", "   ", "{ kein json", json.dumps({"url": "http://roggen.test/", "http_status": 200}),
         _ok("http://hafer.test/"), json.dumps({"http_status": 200}), json.dumps({"url": "http://hafer.test/"}),
         json.dumps({"url": "http://weizen.test/", "error": "zu langsam", "http_status": None, "final_url": "http://weizen.test/"}),
         _ok("http://weizen.test/", error=None), "[1]", "\t \r", _ok("http://roggen.test/", http_status="abc"),
         _ok("http://roggen.test/", entry_count="viele"), '{"url":"http://weizen.test/","error":"NaN","x":NaN}',
         '{"error":"alt",' + _ok("http://weizen.test/", title="y" * (20 << 20))[1:]]


def _candidates(spark):
    return spark.createDataFrame([(1, "http://roggen.test/"), (2, "http://weizen.test/"), (3, "http://roggen.test/")], "candidate_id int, url string")


def test_every_capture_line_is_accounted_for(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    snaps, rejects, stats = captures.ingest_captures(lines, _candidates(spark))
    assert {r["outcome"]: r["n"] for r in stats.collect()} == {"ok": 3, "error": 2, "unmatched": 3, "mistyped": 2, "malformed": 3}
    rows = {(r["candidate_id"], r["error"], len(r["title"] or "") > 999): r for r in snaps.collect()}
    assert set(rows) == {(1, "", False), (2, "zu langsam", False), (2, "", False), (2, "NaN", False), (2, "", True)}
    assert rows[(1, "", False)]["headers"][0].asDict() == {"k": "x-ofen", "v": "heiß"}
    assert [e["path"] for e in rows[(1, "", False)]["listing_entries"]] == ["/teig/rot.odt", "/teig/blau.odt"]
    assert rows[(2, "zu langsam", False)]["is_open_dir"] is None
    assert rejects.count() == 8


def test_captures_as_a_file_stream(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    (inbox / "one.jsonl").write_text("\n".join(LINES))
    for _ in range(2):
        streaming.ingest_capture_stream(
            spark, str(inbox), _candidates(spark), str(out), str(tmp_path / "checkpoint")).awaitTermination()
    first = spark.read.parquet(str(out))
    assert first.count() == 5 and first.select("snapshot_id").distinct().count() == 5 and first.where("fetched_at is null").count() == 0
    assert spark.read.parquet(f"{out}_rejects").count() == 8
    assert {r["outcome"]: r["n"] for r in spark.read.parquet(f"{out}_counts").collect()}["mistyped"] == 2
    (inbox / "two.jsonl").write_text(LINES[0])
    streaming.ingest_capture_stream(
        spark, str(inbox), _candidates(spark), str(out), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 6


def test_host_search_export(spark, tmp_path):
    matches = [{"ip_str": "192.0.2.61", "port": 80, "location": {"country_code": "AT"}, "org": "Halm", "hostnames": ["mehl", "salz"]},
               {"ip_str": "192.0.2.61", "port": 8844, "ssl": {"x": 1}}, {"ip_str": "192.0.2.61", "port": 443},
               {"ip_str": "192.0.2.61", "port": 17, "ssl": None}, {"ip_str": "2a00:b::61", "port": 8844, "ssl": {}},
               {"port": 80, "org": "Halm"}, {"ip_str": "192.0.2.61", "ssl": {}}, {"ip_str": "", "port": 80}]
    (tmp_path / "1.json").write_text(json.dumps({"matches": matches}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"matches": []}))
    rows = exports.read_host_search(spark, str(tmp_path)).collect()
    assert [r["url"] for r in rows] == ["http://192.0.2.61/", "https://192.0.2.61:8844/", "https://192.0.2.61/",
                                        "https://192.0.2.61:17/", "https://[2a00:b::61]:8844/"]
    assert rows[0]["source_meta"]["country"] == "AT" and rows[0]["source_meta"]["hostnames"] == ["mehl", "salz"]


def test_every_record_of_a_source_is_counted(spark, tmp_path):
    pages = ['{"matches":[{"ip_str":"192.0.2.1","port":80},{"port":1},{"ip_str":"x","port":"y"},3,null]}', '{"matches":null}', "{}", "[", '{"matches":4}', "",
             '{"matches":[{"ip_str":"192.0.2.2","port":443,"hostnames":"none"}],"other":"' + "z" * (20 << 20) + '"}']
    frame = spark.createDataFrame([(x,) for x in pages], "value string")
    assert {r["outcome"]: r["n"] for r in exports.host_search_outcomes(frame).collect()} == {
        "ok": 2, "no_address": 1, "mistyped": 4, "no_matches": 2, "unreadable": 2}
    found = {r["outcome"]: r["n"] for r in exports.host_search_outcomes(frame).collect()}
    assert found["ok"] == exports.parse_host_search(frame).count() == 2
    assert sum(found.values()) == 5 + 1 + exports.host_search_rejects(frame).count()
    hosts = [{"ip": "192.0.2.3", "services": [{"port": 80, "service_name": "HTTP"}, {"service_name": "HTTP"}, {"port": 1, "service_name": "SSH"}]},
             {"ip": "192.0.2.4"}, {"ip": "192.0.2.5", "services": 3}]
    (tmp_path / "h.jsonl").write_text("\n".join([*map(json.dumps, hosts), "{", "", '{"ip":"192.0.2.6","note":"' + "z" * (20 << 20) + '","services":[{"port":80,"service_name":"HTTP"}]}']))
    lines = spark.read.text(str(tmp_path / "h.jsonl"))
    assert {r["outcome"]: r["n"] for r in exports.host_services_outcomes(lines).collect()} == {
        "ok": 2, "no_port": 1, "other_service": 1, "no_services": 1, "mistyped": 1, "unreadable": 1}
    assert exports.read_host_services(spark, str(tmp_path / "h.jsonl")).count() == 2 and exports.host_services_rejects(lines).count() == 3
    answers = ['{"sha256":"a","status":404,"body":""}', '{"sha256":"b","status":"x"}', '{"status":200}', "no", " "]
    (tmp_path / "r.jsonl").write_text("\n".join(answers))
    lines = spark.read.text(str(tmp_path / "r.jsonl"))
    assert {r["outcome"]: r["n"] for r in exports.reputation_outcomes(lines).collect()} == {"ok": 1, "mistyped": 1, "no_key": 1, "unreadable": 1}
    assert exports.read_reputation(spark, str(tmp_path / "r.jsonl")).count() == 1 and exports.reputation_rejects(lines).count() == 3


def test_host_services_export(spark, tmp_path):
    hosts = [{"ip": "192.0.2.62", "autonomous_system": {"asn": 65011}, "services": [
        {"port": 25, "service_name": "SMTP"}, {"port": 8844, "service_name": "http", "extended_service_name": "https"},
        {"port": 80, "service_name": "Http"}, {"service_name": "HTTPS"}]},
        {"ip": "2a00:b::62", "services": [{"port": 443, "service_name": "HTTPS"}]}, {"ip": "192.0.2.63", "services": []}]
    (tmp_path / "h.jsonl").write_text("\n".join(json.dumps(h) for h in hosts))
    rows = exports.read_host_services(spark, str(tmp_path)).collect()
    assert [r["url"] for r in rows] == ["https://192.0.2.62:8844/", "http://192.0.2.62/", "https://[2a00:b::62]/"]
    assert rows[0]["source_meta"]["asn"] == "65011"


def test_reputation_reports_and_enrichment(spark, tmp_path):
    body = {"data": {"attributes": {"last_analysis_stats": {"malicious": 5, "suspicious": 2, "undetected": 11, "timeout": 3},
                                    "type_description": "Text", "meaningful_name": "rezept.odt"}}}
    reports = [("aaa", 200, json.dumps(body)), ("bbb", 404, ""), ("ccc", 500, ""), ("ddd", 200, "kein json"), ("fff", 200, ""), ("aaa", 200, json.dumps(body))]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(dict(zip(("sha256", "status", "body"), r))) for r in reports))
    vts = exports.read_reputation(spark, str(tmp_path))
    by = {r["sha256"]: r["vt"] for r in vts.collect()}
    assert (by["aaa"]["total"], by["aaa"]["malicious"], by["aaa"]["name"]) == (21, 5, "rezept.odt")
    assert by["bbb"]["found"] is False and by["bbb"]["error"] is None
    assert by["ccc"]["error"] == "vt 500" and by["ddd"]["error"] and by["fff"]["error"]
    done = F.when(F.col("sha256") == "zzz", F.from_json(F.lit('{"found":true,"malicious":0}'), exports.schemas.VT))
    hashes = spark.createDataFrame([(1, "aaa", ""), (2, "zzz", ""), (3, "", "http 404"), (4, "eee", "")], "hash_id int, sha256 string, error string").withColumn("vt", done)
    enriched = payloads.vt_enrich(hashes, vts)
    state = {r["hash_id"]: r["s"] for r in enriched.select("hash_id", payloads.vt_state_col(F.col("error"), F.col("vt")).alias("s")).collect()}
    assert state == {1: "flagged", 2: "clean", 3: "error", 4: "pending"}
    assert [r["hash_id"] for r in payloads.vt_pending(enriched).collect()] == [4]
    assert payloads.vt_summary(enriched).first().asDict() == {"looked_up": 2, "found": 2, "malicious": 1}


def test_only_allowlisted_files_are_selected_and_hashed(spark, tmp_path):
    names = ["Waage.SCR", "kneten.hta", "lager.mdb", "ofen.png", "alt.msi/", "start.jsp", "Teig_Shell.JSP", "kern.ELF"]
    rows = [(1, i, n, n.replace(" ", "%20"), n.endswith("/")) for i, n in enumerate(names)]
    entries = spark.createDataFrame(rows, "snapshot_id int, pos int, name string, href string, is_dir boolean")
    urls = spark.createDataFrame([(1, "http://h/d/")], "snapshot_id int, url string")
    picked = payloads.select_payloads(entries, urls).orderBy("pos").collect()
    assert [r["url"] for r in picked] == [f"http://h/d/{n}" for n in ("Waage.SCR", "kneten.hta", "Teig_Shell.JSP", "kern.ELF")]
    assert [r["name"] for r in payloads.select_payloads(entries, urls, 2).orderBy("pos").collect()] == ["Waage.SCR", "kneten.hta"]
    for n in names:
        if not n.endswith("/"):
            (tmp_path / n).write_bytes(n.encode() * (100 if n == "kneten.hta" else 1))
    hashed = {r["name"]: r for r in payload_files.hash_files(spark, str(tmp_path), 50).collect()}
    assert set(hashed) == {"Waage.SCR", "kneten.hta", "Teig_Shell.JSP", "kern.ELF"}
    assert hashed["Waage.SCR"]["sha256"] == hashlib.sha256(b"Waage.SCR").hexdigest()
    assert (hashed["kneten.hta"]["error"], hashed["kneten.hta"]["sha256"], hashed["kneten.hta"]["size"]) == ("too_large", "", 0)
    assert {r["error"] for r in payload_files.hash_files(spark, str(tmp_path)).collect()} == {""}
    results = spark.createDataFrame([(1, "http://h/d/Waage.SCR", "aa"), (1, "http://h/other", None)], "snapshot_id int, url string, sha256 string")
    results = results.withColumns({c: F.lit(None).cast(t) for c, t in (("md5", "string"), ("tlsh", "string"), ("size", "long"), ("error", "string"))})
    loaded = {r["url"]: r for r in payloads.load_hashes(results, payloads.select_payloads(entries, urls)).collect()}
    assert loaded["http://h/d/Waage.SCR"]["name"] == "Waage.SCR"
    assert (loaded["http://h/other"]["name"], loaded["http://h/other"]["sha256"], loaded["http://h/other"]["size"]) == ("", "", 0)


def test_append_never_rewrites(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, day string")
    for _ in range(2):
        tables.append(df, str(tmp_path / "t"), ("day",))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_plain_names_resolve_as_other_references_do(spark):
    bases = ["http://h/a/../b/x", "http://h", "//h/p/", "h/p", "http://H:80//x//y?q#f", "http://h/..", "", None]
    refs = ["a.sh", "a b.sh", "./a.sh", "../a.sh", "/a.sh", "?q", "http://o/a.sh", "a.sh?x", "a%20.sh", "..", "", None]
    entries = spark.createDataFrame(
        [(b, i, "a.sh", r, False) for b in range(len(bases)) for i, r in enumerate(refs)], "snapshot_id int, pos int, name string, href string, is_dir boolean")
    urls = spark.createDataFrame(list(enumerate(bases)), "snapshot_id int, url string")
    got = {(r["snapshot_id"], r["pos"]): r["url"] for r in payloads.select_payloads(entries, urls).collect()}
    rows = entries.join(urls, "snapshot_id").withColumn("base", split_url(F.col("url"))).withColumn(
        "ref", split_url(F.coalesce(F.nullif(F.col("href"), F.lit("")), F.col("name"))))
    whole = resolved_url(F.col("base"), F.col("ref"), resolved_path(F.col("base"), F.col("ref")))
    assert got == {(r["snapshot_id"], r["pos"]): r["u"] for r in rows.select("snapshot_id", "pos", whole.alias("u")).collect()}
    assert got[0, 0] == "http://h/b/a.sh" and got[7, 0] is None


def test_selected_urls_are_not_resolved_again_by_a_filter(spark):
    entries = spark.createDataFrame([(1, 0, "a.sh", "a.sh", False)], "snapshot_id int, pos int, name string, href string, is_dir boolean")
    picked = payloads.select_payloads(entries, spark.createDataFrame([(1, "http://h/")], "snapshot_id int, url string"))
    results = spark.createDataFrame([(1, "http://h/a.sh"), (1, None)], "snapshot_id int, url string")
    results = results.withColumns({c: F.lit(None).cast(t) for c, t in (("sha256", "string"), ("md5", "string"), ("tlsh", "string"), ("size", "long"), ("error", "string"))})
    loaded = payloads.load_hashes(results, picked)
    plan = loaded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 100  # hundreds, where the URL is written out again in a condition
    assert {r["url"]: r["name"] for r in loaded.collect()} == {"http://h/a.sh": "a.sh", None: ""}

"""Host rollups: grouping, ranking, disclosure, and what must never appear."""
import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.operators import host_files as hf
from vitrine.operators import hosts
from vitrine.operators.classify import classification_rows, classify_snapshots
from vitrine.operators.features import snapshot_profiles
from vitrine.operators.records import directory_records, latest_open
from vitrine.plans.report import report_records, report_rows, report_tables

SALT = "a-test-salt"
ENTRY = "snapshot_id int, pos int, name string, is_dir boolean, size long, mtime string"


def _world(spark, listings, hashes=None):
    """``listings``: (url, label, page hash, [(name, size)]) -> records and entries."""
    rows, snaps, cands = [], [], []
    for i, (url, label, page, files) in enumerate(listings):
        cands.append((i, url))
        snaps.append((i, i, label, page))
        rows += [(i, p, n, n.endswith("/"), s, None) for p, (n, s) in enumerate(files)]
    entries = spark.createDataFrame(rows, ENTRY)
    snapshots = spark.createDataFrame(snaps, "snapshot_id int, candidate_id int, label string, raw_html_sha256 string")
    snapshots = snapshots.withColumns({
        "fetched_at": F.timestamp_seconds(F.col("snapshot_id") + 1), "is_open_dir": F.lit(True), "server_kind": F.lit("nginx"),
        "http_status": F.lit(200)})
    judged = classify_snapshots(snapshots.drop("label"), entries).drop("label").join(snapshots.select("snapshot_id", "label"), "snapshot_id")
    verdicts = classification_rows(judged, F.col("fetched_at"))
    candidates = spark.createDataFrame(cands, "candidate_id int, url string")
    latest = latest_open(snapshots, "server_kind", "raw_html_sha256")
    records = directory_records(latest, verdicts, candidates, snapshot_profiles(entries))
    table = None if hashes is None else spark.createDataFrame(
        [(i, u, n, s, m) for i, (u, n, s, m) in enumerate(hashes)], "hash_id int, url string, name string, sha256 string, m long"
    ).select("hash_id", "url", "name", "sha256", F.lit("T1").alias("tlsh"), F.struct(F.col("m").alias("malicious"), (F.col("m") >= 0).alias("found")).alias("vt"))
    return records, entries, table, snapshots, verdicts, candidates


def _inventory(spark, listings, hashes=None, **options):
    records, entries, table, *_ = _world(spark, listings, hashes)
    return hf.host_file_inventory(records, entries, SALT, table, **options).collect()


def test_token_is_a_salted_hmac(spark):
    from vitrine.functions.tokens import host_token

    df = spark.createDataFrame([("203.0.113.44",), ("",), ("höst",)], "host string")
    for salt in (SALT, "x" * 100):
        for row in df.withColumn("t", host_token(F.col("host"), salt)).collect():
            assert row["t"] == "host-" + hmac.new(salt.encode(), row["host"].encode(), hashlib.sha256).hexdigest()[:6]
    with pytest.raises(ValueError):
        host_token(F.col("host"), "")


def test_nothing_identifying_leaves_the_inventory(spark):
    listings = [("https://ofenhaus.backwerk.test:8181/keller/", "sensitive_exposure", "h1",
                 [("payroll_mia_muster.xlsx", 42), ("hefe_secret.env", 7), ("regal/", None)]),
                ("http://192.0.2.77:8282/dachboden/", "malicious_staging", "h2",
                 [("webshell.jsp", 1), ("teig_backup.sql", 2), ("kneten.sh", 3)])]
    rows = _inventory(spark, listings, [("http://192.0.2.77:8282/kneten.sh", "kneten.sh", "aa", 0)])
    leaks = ("ofenhaus", "backwerk", "8181", "keller", "192.0.2", "8282", "dachboden")
    assert not [x for x in leaks + ("mia_muster", "hefe", "teig_backup") if x in repr(rows)]
    assert rows[0]["verdict"] == "malicious" and rows[1]["total"] == 2
    by_name = {f["name"]: f for f in rows[0]["files"]}
    assert by_name["kneten.sh"]["sha256"] == "aa" and by_name["webshell.jsp"]["sha256"] is None
    assert by_name[None]["ext"] == ".sql" and by_name[None]["kind"] == "data"
    told = _inventory(spark, listings, disclose=True)
    assert "teig_backup.sql" in repr(told) and not [x for x in leaks if x in repr(told)]


def _kind_of(name, size, malicious):
    """The rank of a file by the rule as it is written: alarm, telling name, program, large, rest."""
    ext = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    shell = ext in P.WEB_SCRIPT_EXTS and re.search(P.WEBSHELL_NAME, name)
    program = ext in P.PAYLOAD_EXTS or shell
    if program and (shell or malicious):
        return 0, True
    if any(re.search(x, name) for patterns in P.INTEREST.values() for x in patterns):
        return 1, bool(program and malicious)
    return (2 if program else 3 if (size or 0) >= P.BIG_FILE_BYTES else 4), False


def test_rank_and_alarm_follow_the_rule(spark):
    """Two names for every extension and category of the dictionaries, with random sizes and reports."""
    r = random.Random(11)
    stems = ["brief", "zettel"]
    names = [f"{stem}{i}{ext}" for i, ext in enumerate([*P.PAYLOAD_EXTS, *P.WEB_SCRIPT_EXTS, ".odt", ""]) for stem in stems]
    names += [f"{stem}-{word}{ext}" for word in ("shell", "reverse", "ordner") for ext in P.WEB_SCRIPT_EXTS for stem in stems]
    names += [f"{stem}-{word}.txt" for word in ("invoice", "payroll", "password") for stem in stems]
    sizes = {n: r.choice([None, 0, r.randrange(10**6), P.BIG_FILE_BYTES, P.BIG_FILE_BYTES - 1]) for n in names}
    reports = {n: r.randrange(3) for n in names if r.random() < 0.5}
    hashes = [(f"http://a.example/{n}", n, f"{n}-{go}", m if go else 9) for n, m in reports.items() for go in (0, 1)]  # the later row counts
    row, = _inventory(spark, [("http://a.example/", "sensitive_exposure", "h", list(sizes.items()))], hashes, max_files=99, disclose=True)
    ranks = {n: _kind_of(n, sizes[n], reports.get(n, 0)) for n in names}
    assert len({rank for rank, _ in ranks.values()}) == 5
    expected = sorted(names, key=lambda n: (ranks[n][0], -(sizes[n] or 0), names.index(n)))
    assert [f["name"] for f in row["files"]] == expected
    assert {f["name"] for f in row["files"] if f["alarm"]} == {n for n in names if ranks[n][1]}
    assert {f["sha256"] for f in row["files"] if f["sha256"]} <= {f"{n}-1" for n in reports}


def test_cap_ties_and_hidden(spark):
    files = [(f"file{i:02}.dat", 3) for i in range(30)]
    listings = [("http://a.example/", "sensitive_exposure", "h", files)]
    row, = _inventory(spark, listings, max_files=12, disclose=True)
    assert (row["shown"], row["total"], row["hidden"]) == (12, 30, 18)
    assert [f["name"] for f in row["files"]] == [n for n, _ in files[:12]]
    records, entries, *_ = _world(spark, listings)
    with pytest.raises(ValueError):
        hf.host_file_inventory(records, entries, SALT, max_files=None)
    assert hf.host_file_rows(records, entries, SALT).count() == 30
    assert {r["file"]["name"] for r in hf.host_file_rows(records, entries, SALT).collect()} == {None}
    assert [r["place"] for r in hf.host_file_rows(records, entries, SALT).collect()] == list(range(1, 31))


def test_flags_metadata_and_honeypots(spark):
    lure = [(n, None) for n in ("laden_backup.7z", "kasse_dump.sql", "kasse_config.rar", "password_liste.odt", "kasse_id_rsa", "kasse_credential.odt")]
    listings = [("http://benign.example/", "benign_index", "b", [("readme.txt", 10)]),
                ("http://lure.example/", "sensitive_exposure", "l", lure)]
    listings += [(f"http://fan.example:{p}/", "sensitive_exposure", "same", [("db.sql", 1)]) for p in (80, 81, 82)]
    listings += [("http://fan.example:90/", "benign_index", "other", [("x.txt", 1)]),
                 ("http://plain.example/", "sensitive_exposure", "", [(".env", None), ("customers.csv", None)])]
    rows = _inventory(spark, listings)
    by_total = {r["total"]: r for r in rows}
    assert set(by_total) == {6, 4, 2} and len(rows) == 3
    assert by_total[6]["honeypot"]["flag"] and "curated bait — 6" in by_total[6]["honeypot"]["reasons"][0]
    assert by_total[4]["honeypot"]["reasons"] == ["identical listing on 3 ports (scanner fan-out)"]
    assert by_total[2]["honeypot"] is None and not by_total[2]["has_meta"] and by_total[4]["has_meta"]
    assert by_total[2]["signals"] == [".env secrets", "personal-records files"]
    everyone = _inventory(spark, listings, flagged_only=False)
    assert sorted(r["verdict"] for r in everyone) == ["flagged", "sensitive", "sensitive", "sensitive"]


def test_breakdown_order_ports_and_signals(spark):
    listings = [("http://a.example/", "sensitive_exposure", "1", [(".env", 1)]),
                ("http://b.example/", "malicious_staging", "2", [("c99.php", 1)]),
                ("http://c.example:1/", "sensitive_exposure", "3", [(".env", 1), ("x.pem", 1)]),
                ("http://c.example:2/", "benign_index", "4", [(".git/", None)]),
                ("http://d.example/", "benign_index", "5", [("a.txt", 1)])]
    records, *_ = _world(spark, listings)
    rows = hosts.host_breakdown(records).collect()
    assert [(r["verdict"], r["ports"]) for r in rows] == [("malicious", 1), ("sensitive", 2), ("sensitive", 1)]
    assert rows[1]["signals"][:2] == ["private keys", ".env secrets"] and ".git repo" in rows[1]["signals"]
    assert hosts.host_breakdown(records, flagged_only=False).count() == 4
    nameless, *_ = _world(spark, [("mehl/a", "benign_index", "1", [(".env", 1)]), ("mehl/b", "benign_index", "2", [(".git/", 1)])])
    assert hosts.host_breakdown(nameless, flagged_only=False).count() == 2 and hosts.host_signals(nameless).count() == 1


def test_top_files_agree_with_sorting_even_for_one_huge_host(spark):
    """One host with most files; the window must keep exactly the best of each."""
    n = 4000
    files = spark.range(n).select(
        F.when(F.col("id") % 10 < 8, "big").otherwise(F.concat(F.lit("h"), (F.col("id") % 30).cast("string"))).alias("host"),
        (F.col("id") % 7 % 5).cast("int").alias("rank"), (F.col("id") * 37 % 101).alias("size"),
        F.lit(0).alias("first_open_at"), F.lit(0).alias("first_open_id"), F.col("id").alias("pos"))
    got = {}
    for r in hf.top_files(files.repartition(8), 5).collect():
        got.setdefault(r["host"], {})[r["place"]] = r["pos"]
    groups = {}
    for r in files.collect():
        groups.setdefault(r["host"], []).append((r["rank"], -r["size"], r["pos"]))
    for host, rows in groups.items():
        assert [got[host][i + 1] for i in range(min(5, len(rows)))] == [r[2] for r in sorted(rows)[:5]]
    plan = hf.top_files(files, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_report_tables(spark):
    listings = [("http://a.example/", "sensitive_exposure", "1", [(".env", 1), ("b.zip", 200 << 20)]),
                ("http://b.example/", "malicious_staging", "2", [("c99.php", 1)]),
                ("http://c.example/", "benign_index", "3", [("a.txt", None)])]
    hashes = [("http://b.example/c99.php", "c99.php", "aa", 3), ("http://b.example/x.sh", "x.sh", "", 0)]
    records, entries, table, snapshots, verdicts, candidates = _world(spark, listings, hashes)
    candidates = candidates.withColumns({"status": F.lit("captured"), "source_meta": F.struct(
        F.lit(None).cast("string").alias("ip"), F.lit("Google LLC").alias("org"), F.lit("").alias("country"))})
    table = table.withColumn("error", F.lit(""))
    tables = report_tables(candidates, snapshots, verdicts, entries, table, SALT)
    head = tables["kpis"].first().asDict()
    assert head == {"classified": 3, "sensitive": 2, "malicious": 1, "webshell_dirs": 1, "credential_key": 1,
                    "honeypot_hosts": 0, "one_in": 2}
    assert [r["label"] for r in tables["label_shares"].collect()] == ["malicious_staging", "sensitive_exposure", "benign_index"]
    assert tables["exposed_volume"].first().asDict() == {"sized_dirs": 2, "total_bytes": (200 << 20) + 2, "files_over_100mb": 1}
    assert tables["corpus_funnel"].first()["open_dirs"] == 3
    assert [tuple(r) for r in tables["top_countries"].collect()] == [("?", 3)]
    assert tables["host_inventory"].count() == 2 and tables["hash_summary"].first()["skipped"] == 1
    for name, df in tables.items():
        assert "example" not in repr(df.collect()), name


def test_the_report_in_one_pass_has_the_counts_of_its_sections(spark):
    listings = [(f"http://{c}.example/", label, str(i % 2), [(n, s) for n, s in files]) for i, (c, label, files) in enumerate([
        ("a", "sensitive_exposure", [(".env", 1), ("b.zip", 200 << 20)]), ("b", "malicious_staging", [("c99.php", 1)]),
        ("c", "benign_index", [("a.txt", None)]), ("d", "benign_index", [])])]
    records, entries, table, snapshots, verdicts, candidates = _world(spark, listings, [])
    candidates = candidates.unionByName(spark.createDataFrame([(90, "http://e.example/")], "candidate_id int, url string")).withColumns({
        "status": F.when(F.col("candidate_id") < 90, "captured").otherwise("pending"),
        "source_meta": F.struct(F.when(F.col("candidate_id") < 2, "192.0.2.1").alias("ip"), F.lit("Google LLC").alias("org"), F.lit("").alias("country"))})
    found = report_records(candidates, snapshots, verdicts, snapshot_profiles(entries, exts=3))
    rows = {(r["section"], r["key"]): r["value"] for r in report_rows(found).collect()}
    assert rows["corpus", "candidates"] == 5 and rows["corpus", "pending"] == 1 and rows["corpus", "open_dirs"] == 4
    assert rows["label", "benign_index"] == 2 and rows["sensitive", "env"] == 1 and rows["payload", "webshell"] == 1
    assert rows["volume", "total_bytes"] == (200 << 20) + 2 and rows["volume", "files_over_100mb"] == 1
    assert rows["ext", ".zip"] == rows["ext", ".php"] == 1 and rows["country", "?"] == 3 and rows["server", "nginx"] == 4
    plan = report_rows(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "example" not in repr(rows) and plan.count("LogicalRDD") >= 4

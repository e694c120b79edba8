"""Dictionaries, features and the verdict, on hand-made listings."""
import re

import hypothesis.strategies as st
from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.matching import category_tests
from vitrine.operators import classify as cls
from vitrine.operators import features as feat
from vitrine.operators import inventory, network

# Hand-made folders of a made-up company, one rule or border case each.
STAGING, EXPOSED, MIRROR, PLAIN = P.LABELS
CASES = [
    (STAGING, ["kalender.html", "upload_webshell.phtml"]),
    (STAGING, ["lazagne-portable.dat", "hinweise.odt"]),
    (STAGING, ["r57.jsp", "fotos/"]),
    (STAGING, ["njrat_builder.7z", "plan.odt"]),
    (STAGING, ["backdoor-v2.aspx", "gehalt.kdbx"]),
    (STAGING, ["meterpreter.py", "karte.svg", "weg.gpx"]),
    (PLAIN, ["haus.ovpn", "weg.gpx"]),
    (EXPOSED, ["mitglieder.mdb", "satzung.odt"]),
    (EXPOSED, ["tresor.kdbx"]),
    (PLAIN, ["netz_montag.pcap", "netz.md"]),
    (EXPOSED, ["id_ed25519", "id_ed25519.txt"]),
    (EXPOSED, ["laden.sql.bz2", "laden.css"]),
    (EXPOSED, ["zugang.ppk", "anleitung.odt"]),
    (EXPOSED, ["app-config.yaml", "app.css"]),
    (EXPOSED, ["treiber.msi", "hinweise.odt"]),
    (EXPOSED, ["starten.vbs", "hinweise.odt"]),
    (EXPOSED, ["steuerung.bin"]),
    (MIRROR, ["wetter-1.deb", "wetter-2.deb", "wetter-3.deb"]),
    (MIRROR, ["chor.mkv", "chor.mp4", "probe.mkv", "probe.mp4"]),
    (MIRROR, ["karte.iso", "karte.7z", "karte.tar", "karte.rpm", "karte.jar"]),
    (PLAIN, ["kuchen.odt", "torte.odt", "brot.odt"]),
    (PLAIN, ["archiv/", "bilder/", "start.html"]),
    (PLAIN, ["garten.zip", "pflanzen/"]),
    (PLAIN, []),
]


def _listings(spark, listings):
    snaps = [(i, "apache") for i in range(len(listings))]
    rows = [(i, p, n, n.endswith("/"), None, None) for i, names in enumerate(listings) for p, n in enumerate(names)]
    entries = spark.createDataFrame(rows, "snapshot_id int, pos int, name string, is_dir boolean, size long, mtime string")
    return spark.createDataFrame(snaps, "snapshot_id int, server_kind string"), entries


def _judge(spark, *listings):
    rows = cls.classify_snapshots(*_listings(spark, listings)).orderBy("snapshot_id").collect()
    return rows


def test_every_rule_on_own_listings(spark):
    rows = _judge(spark, *[names for _, names in CASES])
    wrong = [(r["label"], case) for r, case in zip(rows, CASES) if r["label"] != case[0]]
    assert wrong == []


def test_dictionary_hits_counted_by_hand(spark):
    """Counts written down by reading the names, not the dictionaries."""
    names = ["urlaub.env", ".env", ".env.alt", "konto.sql", "dump_konto.sql", "alte_backup/", "brief.old", "zugang.key",
             "secret_plan.odt", "lager.sqlite2", "lager.db", "netz.pcap", "firma.ovpn", "c99.php", "hilfe.exe", "hilfe.dll",
             "lauf.sh", "lauf.bat", "beacon.png", "kern.elf", "notiz.odt"]
    _, entries = _listings(spark, [names])
    profile = feat.features_of(spark.createDataFrame([(0, "nginx")], "snapshot_id int, server_kind string"), feat.snapshot_profiles(entries)).first()
    hits = {k: v for k, v in {**profile["sensitive_hits"].asDict(), **profile["payload_hits"].asDict()}.items() if v}
    assert hits == {"env": 2, "sql_dump": 2, "backup": 2, "priv_key": 1, "credential": 1, "database": 2, "capture": 1, "vpn": 1,
                    "webshell": 1, "executable": 2, "script": 2, "malware_tool": 1, "binary": 1}


def test_goldset_tables(spark):
    cases = spark.createDataFrame([("benign_index", "benign_index"), ("benign_index", "intentional_public")], "expected string, label string")
    accuracy, matrix = cls.goldset_eval(cases)
    assert accuracy.first().asDict() == {"cases": 2, "correct": 1, "accuracy": 0.5}
    assert matrix.first().asDict() == {"expected": "benign_index", "malicious_staging": 0, "sensitive_exposure": 0,
                                       "intentional_public": 1, "benign_index": 1}


def test_confidence_and_reasons(spark):
    strong, capped, weak, empty, upper = _judge(
        spark, ["tor_shell.phtml", "rad.scr"], [".env"] * 9, ["rad.scr", "rad.odt"], [], ["TOR_SHELL.PHTML"])
    assert (round(strong["confidence"], 6), strong["reasons"]) == (0.8, ["webshell", "executable"])
    assert (capped["confidence"], capped["reasons"]) == (0.95, ["env"])
    assert (weak["confidence"], weak["reasons"]) == (0.5, [P.REASON_WEAK])
    assert (empty["label"], empty["entry_count"], empty["mirror_ratio"]) == ("benign_index", 0, 0.0)
    assert upper["label"] == "malicious_staging"
    assert strong["ruleset_version"] == "1.1.0"


def test_top_exts_and_hits(spark):
    _, entries = _listings(spark, [["a.zip", "b.zip", "c.iso", "d", "x.AppImage", "sub.zip/"] + [f"f.e{i}" for i in range(12)]])
    top = [(r["ext"], r["n"]) for r in feat.top_exts(entries).orderBy("place").collect()]
    assert top[0] == (".zip", 2) and len(top) == 10 and top[1:3] == [(".e0", 1), (".e1", 1)]
    profile = feat.snapshot_profiles(entries).first()
    assert (profile["mirror_files"], profile["dir_count"]) == (3, 1)
    stored = feat.snapshot_profiles(entries, exts=10).first()
    assert [tuple(e) for e in stored["top_exts"]] == top
    assert {k: v for k, v in stored.asDict().items() if k != "top_exts"} == profile.asDict()


def test_stored_extensions_survive_a_new_verdict(spark):
    snapshots, entries = _listings(spark, [["a.zip", "b.zip", "c.TXT", "ordner.d/"], ["ohne"], []])
    judged = cls.classification_rows(cls.classify_snapshots(snapshots, entries))
    again = cls.reclassify(judged, "9.0.0").orderBy("snapshot_id").collect()
    assert [[tuple(e) for e in r["features"]["top_exts"]] for r in again] == [[(".zip", 2), (".txt", 1)], [], []]
    plan = cls.classify_snapshots(snapshots, entries).select("top_exts", "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(snapshot_id") <= 3


def test_columns_agree_with_plain_regular_expressions(spark):
    """Names made from each pattern: shortcuts and guards must not change a match."""
    names = {".ENV", "env", "x.pem\n", "a.pem.txt", "PASSPORT.pdf", "my users list.csv", "users/", "config.zip",
             "configuration.php", "jwt", "a-jwt.txt", "national id", "éiban", "db_backup.sql", "mysql.gz", "reverse"}
    plain = st.characters(codec="ascii", exclude_characters="\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85")
    tables = {"s": P.SENSITIVE, "p": P.PAYLOAD, "i": P.INTEREST, "b": P.BAIT}
    for table in tables.values():
        for pattern in (p for ps in table.values() for p in ps):
            made = st.from_regex(re.compile(pattern, re.ASCII), alphabet=plain)

            @settings(max_examples=15, deadline=None, database=None, derandomize=True,
                      suppress_health_check=list(HealthCheck))
            @given(made)
            def collect(name):
                names.add(name.lower())

            collect()
    df = spark.createDataFrame([(n,) for n in sorted(names)], "name string")
    columns = [t.alias(f"{k}_{c}") for k, table in tables.items() for c, t in category_tests(F.col("name"), table).items()]
    hits = 0
    for row in df.select("name", *columns).collect():
        low = row["name"].lower()
        for k, table in tables.items():
            for c, patterns in table.items():
                expected = any(re.search(p, low, re.I) for p in patterns)
                hits += expected
                assert row[f"{k}_{c}"] == expected, (row["name"], k, c)
    assert hits > 500


def test_pending_is_idempotent_and_history_is_kept(spark):
    snaps, entries = _listings(spark, [[".env"], ["a.zip"], ["b.txt"]])
    snaps = snaps.withColumns({"is_open_dir": F.col("snapshot_id") != 2, "fetched_at": F.current_timestamp()})
    none = cls.classification_rows(cls.classify_snapshots(snaps, entries)).limit(0)
    first = cls.classify_pending(snaps, none, entries)
    assert {r["snapshot_id"]: r["label"] for r in first.collect()} == {0: "sensitive_exposure", 1: "benign_index"}
    assert cls.classify_pending(snaps, first, entries).count() == 0
    again = cls.reclassify(first, "9.9.9")
    assert {r["ruleset_version"] for r in again.collect()} == {"9.9.9"}
    both = first.unionByName(again)
    assert both.count() == 4 and cls.classify_pending(snaps, both, entries).count() == 0


def test_interest_and_sizes(spark):
    rows = [(1, i, f"customer_{i}.csv", False, i) for i in range(9)] + [(1, 9, "d/", True, None), (2, 0, "x", False, None)]
    entries = spark.createDataFrame(rows, "snapshot_id int, pos int, name string, is_dir boolean, size long").withColumn("mtime", F.lit(None).cast("string"))
    assert [tuple(r) for r in inventory.interest_counts(entries).collect()] == [(1, "personal_records", 9)]
    assert inventory.interest_examples(entries, 3).first()["examples"] == [f"customer_{i}.csv" for i in range(3)]
    one, two = inventory.size_stats(entries).orderBy("snapshot_id").collect()
    assert (one["file_count"], one["total_bytes"], one["largest_name"], one["has_sizes"]) == (9, 36, "customer_8.csv", True)
    assert (two["has_sizes"], two["total_bytes"], two["largest_name"]) == (False, 0, "")
    assert inventory.inventory(entries).filter("snapshot_id = 1").first()["interest_hits"]["personal_records"] == 9


def test_network(spark):
    orgs = {"Amazon Data Services Nordwest": ("cloud", "Amazon AWS"), "ALIYUN-NORD": ("cloud", "Alibaba Cloud"),
            "Nordlicht Hosting": ("hosting", "Nordlicht Hosting"), " Talnetz Broadband ": ("residential", "Talnetz Broadband"),
            "University of Nordtal": ("academic", "University of Nordtal"),
            "Bäckerei Halm": ("business", "Bäckerei Halm"), "  ": ("unknown", "Unknown"), None: ("unknown", "Unknown")}
    df = spark.createDataFrame([(o,) for o in orgs], "org string")
    assert {r["org"]: (r["category"], r["provider"]) for r in network.network_profile(df).collect()} == orgs
    counts = {(r["kind"], r["name"]): r["n"] for r in network.profile_breakdown(df).collect()}
    assert counts[("category", "cloud")] == 2 and counts[("provider", "Unknown")] == 2


def test_verdicts_group_entries_once(spark):
    from checks import queries

    for query in (queries.classify, queries.goldset_accuracy, queries.one_in):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "_ext#" not in plan, query.__name__  # not by extension first


def test_pending_verdicts_count_names_of_pending_listings_only(spark):
    from checks import queries

    pending = queries.classify_pending(spark, "/root/testdata/sf0.001", None)
    plan = pending._jdf.queryExecution().optimizedPlan().toString()
    assert sum("count(" in part.split("\n")[0] for part in plan.split("Aggregate [")[1:]) == 1
    assert "_ext#" not in plan
    assert pending.count() > 0


def test_common_extensions_need_no_labels(spark):
    from checks import queries

    plan = queries.ext_prevalence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "malicious_staging" not in plan and "webshell" not in plan

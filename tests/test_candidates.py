"""URL normal forms, scope, dedup and the candidate queues."""
import ipaddress
import random

from pyspark.sql import functions as F

from vitrine.operators import candidates as cand

URLS = {
    "HtTpS://WWW.Brot.TEST/Mehl?Sorte=A": ("https://www.brot.test/Mehl?Sorte=A", "www.brot.test/Mehl?Sorte=A"),
    "http://brot.test:80/ofen#oben": ("http://brot.test/ofen", "brot.test/ofen"),
    "https://brot.test:443": ("https://brot.test/", "brot.test/"),
    "https://brot.test:80/": ("https://brot.test:80/", "brot.test:80/"),
    "brot.test/ofen///": ("http://brot.test/ofen///", "brot.test/ofen"),
    "http://brot.test:8181/ofen/?x=1&y=": ("http://brot.test:8181/ofen/?x=1&y=", "brot.test:8181/ofen?x=1&y="),
    "http://[2A00::B:1]:81/k": ("http://[2a00::b:1]:81/k", "[2a00::b:1]:81/k"),
    "https://ich:geheim@[2a00::9]:443/": ("https://[2a00::9]/", "[2a00::9]/"),
}
BLOCKED = [
    "http://127.8.9.10/k", "https://10.20.30.40:444/", "http://192.168.77.3/", "http://172.19.0.8/", "http://169.254.7.7/",
    "http://[::1]:82/", "http://[0:0:0:0:0:0:0:1]/", "http://[::]/", "http://[fe80::77]/", "http://[fd12:3456::9]/", "http://[ff02::fb]/",
    "http://[::ffff:9.9.9.9]/", "http://[2001:db8:77::4]/", "http://[brot]/", "http://[64:ff9b::909:909]/", "http://[2a00:::1]/", "http://[1:2:3:4:5:6:7:8:9]/", "http://[2a00::12345]/",
    "http://amt.gov/", "http://gov./", "https://flotte.mil/x", "zwei worte", "http://zwei worte/", "http://localhost/", "http://ofen.localhost:99/",
    "http://drucker.local/", "http://lager.internal.", "http://3232235777/", "http://0xc0a84d03/", "http://030052246403/", "http://0300.0250.77.3/",
    "http://10.1/", "http://10.20.30.40./", "http://300.2.3.4/", "brot.test/ohne-schema", "", "http:///ofen", "http://198.18.77.1/", "http://77.1.2.3/",
]
ALLOWED = [
    "http://9.9.9.9/", "https://151.101.1.69:8444/x", "http://brot.test/ofen/", "http://lokalblatt.test/", "http://_tcp.brot.test/",
    "http://brot.test./", "http://192.0.0.10/", "http://[2a00:1450::77]:82/", "http://[2A00:0:0:0:0:0:0:77]/", "http://regov/", "http://0xbrot.test/",
]


def test_normal_forms(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rows = cand.with_dedup_key(cand.normalize_urls(df)).collect()
    assert {r["url"]: (r["normalized_url"], r["dedup_key"]) for r in rows} == URLS


def test_scope(spark):
    df = spark.createDataFrame([(u,) for u in BLOCKED + ALLOWED], "url string")
    rows = {r["url"]: r["blocked"] for r in cand.with_blocked(df, cidrs=("77.0.0.0/8", "kein netz")).collect()}
    assert [u for u in BLOCKED if not rows[u]] == []
    assert [u for u in ALLOWED if rows[u]] == []


def test_ipv4_scope_agrees_with_the_standard_library(spark):
    rng = random.Random(7)
    firsts = [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 239, 240, 255, 8]
    ips = [f"{rng.choice(firsts)}.{rng.choice([0, 2, 16, 18, 31, 51, 64, 113, 168, 254, rng.randrange(256)])}."
           f"{rng.choice([0, 2, 100, 113, rng.randrange(256)])}.{rng.randrange(256)}" for _ in range(3000)]
    df = spark.createDataFrame([(f"http://{ip}/",) for ip in ips], "url string")
    for row in cand.with_blocked(df).collect():
        ip = ipaddress.ip_address(row["url"][7:-1])
        expected = (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved
                    or ip.is_multicast or ip.is_unspecified)
        assert row["blocked"] == expected, row


def test_ipv6_scope_agrees_with_the_standard_library(spark):
    rng = random.Random(11)
    part = lambda: rng.choice(["0", "1", "2001", "2002", "fe80", "fc00", "ff02", "2a00", "db8", "20", "64", "ffff", "4", "112", f"{rng.randrange(65536):x}"])
    ips = [f"{':'.join(part() for _ in range(rng.randrange(5)))}::{':'.join(part() for _ in range(rng.randrange(4)))}" for _ in range(1500)]
    ips += [":".join(part() for _ in range(rng.choice([7, 8, 8, 9]))) for _ in range(500)] + ["::9.9.9.9", "2a00::9.9.9.9", "2a00::9.9.9", ":::", "1::2::3"]
    df = spark.createDataFrame([(f"http://[{ip}]/",) for ip in ips], "url string")
    for row in cand.with_blocked(df).collect():
        try:
            ip = ipaddress.ip_address(row["url"][8:-2])
            expected = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified
        except ValueError:
            expected = True
        assert row["blocked"] == expected, row


def test_ingest_keeps_the_first_and_is_idempotent(spark):
    rows = [(1, "http://mehl.test/x", "s1"), (2, "https://MEHL.test/x/", "s2"), (3, "http://10.20.30.40/", "s3"), (4, "HTTP://Salz.test", "s4")]
    found = spark.createDataFrame(rows, "input_order int, url string, source string")
    new = cand.ingest_candidates(found)
    got = {r["dedup_key"]: (r["url"], r["source"]) for r in new.collect()}
    assert got == {"mehl.test/x": ("http://mehl.test/x", "s1"), "salz.test/": ("http://salz.test/", "s4")}
    assert cand.ingest_candidates(found, new).count() == 0


def test_queues_status_and_browsing(spark):
    candidates = spark.sql("""SELECT * FROM VALUES
        (1, 'http://a.com/', 'pending', TIMESTAMP'2024-01-02', CAST(NULL AS TIMESTAMP)),
        (2, 'http://b.com/', 'pending', TIMESTAMP'2024-01-01', CAST(NULL AS TIMESTAMP)),
        (3, 'http://c.com/', 'captured', TIMESTAMP'2024-01-03', TIMESTAMP'2024-02-01')
        AS t(candidate_id, url, status, first_seen, last_captured_at)""")
    snapshots = spark.sql("""SELECT * FROM VALUES
        (10, 1, TIMESTAMP'2024-03-01', '', true), (11, 1, TIMESTAMP'2024-03-02', 'timeout', false),
        (12, 2, TIMESTAMP'2024-03-01', '', false) AS t(snapshot_id, candidate_id, fetched_at, error, is_open_dir)""")
    assert [r["candidate_id"] for r in cand.pending_queue(candidates).collect()] == [2, 1]
    assert [r["candidate_id"] for r in cand.pending_queue(candidates, 1).collect()] == [2]
    assert cand.pending_count(candidates).first()["pending"] == 2
    assert [r["candidate_id"] for r in cand.recapture_queue(candidates, snapshots).collect()] == [1]
    moved = {r["candidate_id"]: (r["status"], str(r["last_captured_at"])[:10]) for r in
             cand.advance_status(candidates, snapshots).collect()}
    assert moved == {1: ("error", "2024-03-02"), 2: ("captured", "2024-03-01"), 3: ("captured", "2024-02-01")}
    found = cand.browse(candidates, {"status": "pending"}, "A.CO", ("url",), "first_seen", "2024-01-01", "2024-01-31")
    assert [r["candidate_id"] for r in found.collect()] == [1]
    newest = cand.browse(candidates, date_column="first_seen").select(F.col("candidate_id"))
    assert [r[0] for r in newest.collect()] == [3, 1, 2]

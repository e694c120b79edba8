"""Listing-shaped views of the given TPC-H-like tables.

The given tables hold no directory listings, so entries come from ``lineitem``,
snapshots from ``orders`` and candidates from ``customer``. The same rules are
written in SQL in ``oracle.py``. Every view is a projection of whole tables.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.files import is_payload
from vitrine.operators.classify import classification_rows, classify
from vitrine.operators.features import features_of, snapshot_profiles
from vitrine.operators.records import directory_records, latest_open

SALT = "oracle-salt"

# 80 made-up file names in four blocks of 20: plain, mirror, sensitive, programs.
NAMES = (
    "teig.txt start.html fotos/ plan.md laden.css laden.js ofen.png mitarbeiter/ backup_alt/ preise.json "
    "markt.jpg LIZENZ ofen.ico ofen.webm seiten.xml quellen/ kneten.py papiere/ regeln.txt schrift.woff2 "
    "brot-1.zip brot-2.tar brot.iso brot.tar.gz film-1.mp4 film-2.mkv ofen.deb ofen.rpm ofen.whl ofen.jar "
    "ofen.msi brotwaage.exe kalender.exe ofen.AppImage handbuch.pdf ofen.dmg winter.rar winter.7z winter.xz SUMMEN "
    ".env laden.env .git/ kasse_id_rsa authorized_keys kasse.pem wp-config-neu.php .htpasswd kasse_dump.sql kasse.sql.gz "
    "customers_nord.csv password_liste.zip ssh-key_nord.tar.gz config.rar wallet.dat credential.odt lager.sqlite3 netz.pcap "
    "nord.ovpn laden_backup.zip "
    "r57.php teig_shell.php teig_shell.phtml lazagne.exe lauf.ps1 lauf.sh kern.dll kern.bin kern.elf laden.php "
    "beacon_nord.dll payroll_nord.xlsx api-key.txt nord.tfstate error.log invoice_nord.pdf .hg/ thumbs.db "
    "bericht.txt lauf.bat"
).split()

# A made-up owner name per nation, covering all categories and one blank.
ORGS = [
    "AWS Nordtal", "Google Fiberglas", "Azure Talwerk", "DigitalOcean Nord", "OVH Talnetz", "Hetzner Nordtal", "Linode Talnetz",
    "Oracle Nordtal", "Alicloud Tal", "Tencent Nordtal", "Bisect Tal", "Contabo Tal", "Hostpapa Tal", "Endurance Tal",
    "Leaseweb Tal", "Talkabel Cable", "Nordfunk Broadband", "Bergnetz Telecom", "Seefunk Wireless", "Institut Nordtal",
    "University of Nordtal", "Halm Backwaren", "Kornmühle Tal", "Nordtal Dedicated Servers", "  ",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _case(key: Column, cases: list[Column]) -> Column:
    """The case numbered by ``key``; only that one is computed."""
    result = F.when(key == 0, cases[0])
    for number, case in enumerate(cases[1:], 1):
        result = result.when(key == number, case)
    return result


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshot_id, pos, name, is_dir, size, mtime``.

    ``pos`` is the sort key of the entry within its listing; only its order
    matters, so no window is needed to number the rows.
    """
    key = F.col("l_orderkey") % 8
    spread = F.when(key < 4, F.col("l_partkey") % 20).otherwise(F.col("l_partkey") % 7)
    lines = table(spark, sf_dir, "lineitem").withColumn("name", _pick(NAMES, key % 4 * 20 + spread))
    is_dir = F.col("name").endswith("/")
    size = F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 40).cast("bigint")
    return lines.select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate").alias("pos"),
        "name",
        is_dir.alias("is_dir"),
        F.when(~is_dir & (F.col("l_linenumber") % 5 != 0), size).alias("size"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm").alias("mtime"),
    )


def candidate_url(custkey: Column) -> Column:
    return F.concat(
        F.lit("http://h"), (custkey % 400).cast("string"), F.lit(".example:"),
        (F.floor(custkey / 400) + 8000).cast("string"), F.lit("/"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    shared = cust % 400
    page = F.when(shared % 7 == 0, F.concat(F.lit("h"), shared.cast("string"))).otherwise(
        F.concat(F.lit("s"), key.cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("snapshot_id"),
        cust.alias("candidate_id"),
        F.col("o_orderdate").alias("fetched_at"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_open_dir"),
        F.when(F.col("o_orderstatus") == "P", 404).otherwise(200).alias("http_status"),
        F.sha2(page, 256).alias("raw_html_sha256"),
        _pick(["apache", "nginx", "python", "unknown"], key % 4).alias("server_kind"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    status = F.when(key % 10 == 0, "pending").when(key % 10 == 1, "error").otherwise("captured")
    ip = F.when(key % 3 == 0, F.concat(F.lit("203.0.113."), (key % 200).cast("string")))
    return joined.select(
        key.alias("candidate_id"),
        candidate_url(key).alias("url"),
        F.when(key % 2 == 0, "host_search").otherwise("host_services").alias("source"),
        F.struct(
            ip.alias("ip"),
            _pick(ORGS, F.col("c_nationkey")).alias("org"),
            F.when(key % 11 != 0, F.col("n_name")).alias("country"),
        ).alias("source_meta"),
        (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=key.cast("int"))).alias("first_seen"),
        status.alias("status"),
    )


def _judged(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Verdicts of all open directories."""
    opened = snapshots(spark, sf_dir).filter("is_open_dir").select("snapshot_id", "fetched_at", "server_kind")
    return classify(features_of(opened, found))


def classifications(spark: SparkSession, sf_dir: str, found: DataFrame | None = None) -> DataFrame:
    """One row per open directory at the current ruleset (but for every ninth),
    and a newer row of an older ruleset, labelled unknown, for every seventh."""
    judged = _judged(spark, sf_dir, profiles(spark, sf_dir) if found is None else found)
    judged = judged.withColumn("classified_at", F.col("fetched_at") + F.expr("interval 1 day"))
    versions = F.array_compact(
        F.array(
            F.when(F.col("snapshot_id") % 9 != 4, F.struct(
                F.lit(P.RULESET_VERSION).alias("v"), F.lit(0).alias("d"))),
            F.when(F.col("snapshot_id") % 7 == 3, F.struct(
                F.lit("1.0.0").alias("v"), F.lit(1).alias("d"))),
        )
    )
    # the label stays outside the array, so that readers who ask for none count no names
    rows = judged.withColumn("_r", F.explode(versions)).withColumns(
        {
            "label": F.when(F.col("_r.d") == 1, "unknown").otherwise(F.col("label")),
            "ruleset_version": F.col("_r.v"),
            "classified_at": F.col("classified_at") + F.make_dt_interval(days=F.col("_r.d")),
        }
    )
    return classification_rows(rows, F.col("classified_at"))


def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash row for every payload-named file; its state varies by snapshot."""
    sid = F.col("snapshot_id")
    files = entries(spark, sf_dir).filter(~F.col("is_dir") & is_payload(F.col("name")))
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), "o_custkey")
    skipped = sid % 10 == 2
    vt = F.struct(
        (sid % 4 != 0).alias("found"),
        F.when(sid % 30 == 1, 3).otherwise(0).cast("bigint").alias("malicious"),
    )
    return files.join(owners, "snapshot_id").select(
        F.struct("snapshot_id", "pos").alias("hash_id"),
        "snapshot_id",
        "name",
        F.concat(candidate_url(F.col("o_custkey")), F.col("name")).alias("url"),
        F.when(skipped, "").otherwise(F.sha2(F.concat("name", sid.cast("string")), 256)).alias("sha256"),
        F.concat(F.lit("T1"), sid.cast("string")).alias("tlsh"),
        F.coalesce("size", F.lit(0)).alias("size"),
        F.when(skipped, "too_large").otherwise("").alias("error"),
        F.when(sid % 3 != 0, vt).alias("vt"),
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_open(snapshots(spark, sf_dir), "server_kind", "raw_html_sha256")


def profiles(spark: SparkSession, sf_dir: str, exts: int | None = None) -> DataFrame:
    return snapshot_profiles(entries(spark, sf_dir), exts=exts)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The per-directory table; its two readers share one exchange of the profiles."""
    found = profiles(spark, sf_dir)
    return directory_records(
        latest(spark, sf_dir), classifications(spark, sf_dir, found), candidates(spark, sf_dir), found
    )


# --- texts derived from the given tables, for the readers and parsers ---------

LAYOUTS = ["apache", "nginx", "python", "apache"]


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rendered listing of five entries per order, in four server layouts."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")

    def name(i):
        return _pick(NAMES, (key * 7 + i * 13) % 80)

    def number(i):
        return ((key * 37 + i * 1009) % 5000000).cast("string")

    def human(i):
        return F.concat((key % 900 + 1).cast("string"), F.lit("."), i.cast("string"), F.lit("K"))

    def size(i, text):
        return F.when(name(i).endswith("/"), "-").otherwise(text)

    def when(i, pattern):
        return F.date_format(day + F.make_dt_interval(hours=i), pattern)

    def join(line):
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), line), "\n")

    def anchor(i):
        return F.concat(F.lit('<a href="'), name(i), F.lit('">'), name(i), F.lit("</a>"))

    folder = F.concat(F.lit("/d"), (key % 50).cast("string"), F.lit("/"))
    table_rows = join(lambda i: F.concat(
        F.lit('<tr><td valign="top">'), anchor(i), F.lit("</td><td>"), when(i, "yyyy-MM-dd HH:mm"),
        F.lit("&nbsp;</td><td>"), size(i, human(i)), F.lit("</td></tr>")))
    nginx_lines = join(lambda i: F.concat(
        anchor(i), F.lit("    "), when(i, "dd-MMM-yyyy HH:mm"), F.lit("   "), size(i, number(i))))
    items = join(lambda i: F.concat(F.lit("<li>"), anchor(i), F.lit("</li>")))
    apache_lines = join(lambda i: F.concat(
        F.lit('<img src="/icons/unknown.gif" alt="[   ]"> '), anchor(i), F.lit("  "),
        when(i, "yyyy-MM-dd HH:mm"), F.lit("  "), size(i, human(i))))

    def page(title, body, head=""):
        return F.concat(
            F.lit(head + "<html><head><title>" + title), folder, F.lit("</title></head>\n<body><h1>" + title),
            folder, F.lit("</h1>\n"), *body, F.lit("\n</body></html>"),
        )

    layout = key % 4
    html = (
        F.when(layout == 0, page("Index of ", [
            F.lit('<table><tr><th>Name</th><th>Size</th></tr>\n<tr><td><a href="/">Parent Directory</a></td></tr>\n'),
            table_rows, F.lit("</table>")]))
        .when(layout == 1, page("Index of ", [F.lit('<hr><pre><a href="../">../</a>\n'), nginx_lines, F.lit("</pre>")]))
        .when(layout == 2, page("Directory listing for ", [F.lit("<hr><ul>\n"), items, F.lit("</ul>")],
                                "<!DOCTYPE HTML>"))
        .otherwise(page("Index of ", [
            F.lit('<pre><a href="?C=N;O=D">Name</a> <a href="?C=S;O=A">Size</a><hr>'
                  '<img src="/icons/back.gif"> <a href="/">Parent Directory</a>    -\n'),
            apache_lines, F.lit("</pre>")]))
    )
    url = F.concat(F.lit("http://h"), (F.col("o_custkey") % 400).cast("string"), F.lit(".example"), folder)
    # the narrow keys are spread over the cores before each grows into a page
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    spread = keys.repartition(spark.sparkContext.defaultParallelism * 4)
    return spread.select(key.alias("page_id"), url.alias("url"), html.alias("html"))


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered listings, and the given pages under negative ids (none is a listing)."""
    real = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("page_id"), "url", "html")
    return listing_pages(spark, sf_dir).unionByName(real)


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    decimal = F.concat((part % 1000).cast("string"), F.lit("."), (supp % 10).cast("string"))
    text = (
        F.when(line % 7 == 0, part.cast("string"))
        .when(line % 7 == 1, F.concat(decimal, F.lit("K")))
        .when(line % 7 == 2, F.concat(decimal, F.lit("M")))
        .when(line % 7 == 3, F.concat(F.lit("  "), decimal, F.lit(" GiB ")))
        .when(line % 7 == 4, "-")
        .when(line % 7 == 5, F.concat(decimal, F.lit(".1")))
        .otherwise(F.concat(decimal, F.lit(" items")))
    )
    return table(spark, sf_dir, "lineitem").select(text.alias("text"))


def mtime_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, day = F.col("l_linenumber"), F.col("l_shipdate") + F.make_dt_interval(mins=F.col("l_linenumber"))
    text = (
        F.when(line % 5 == 0, F.date_format(day, "dd-MMM-yyyy HH:mm"))
        .when(line % 5 == 1, F.date_format(day, "yyyy-MM-dd HH:mm"))
        .when(line % 5 == 2, F.concat(F.lit("  "), F.date_format(day, "yyyy-MM-dd   HH:mm"), F.lit(" UTC")))
        .when(line % 5 == 3, "-")
        .otherwise(F.concat(F.lit("day "), line.cast("string")))
    )
    return table(spark, sf_dir, "lineitem").select(text.alias("text"))


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of many kinds, in and out of scope, one per order."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    a, b, c = (key % 256).cast("string"), (F.floor(key / 256) % 256).cast("string"), (key % 7).cast("string")
    urls = [
        F.concat(F.lit("http://"), a, F.lit("."), b, F.lit("."), c, F.lit(".9/")),
        F.concat(F.lit("HTTPS://H"), (key % 900).cast("string"), F.lit(".Example.COM:443/Files/")),
        F.concat(F.lit("http://h"), (key % 900).cast("string"), F.lit(".example.com/Files")),
        F.concat(F.lit("http://"), text, F.lit("/")),
        F.concat(F.lit("http://0x"), F.lower(F.hex(key)), F.lit("/a")),
        F.concat(F.lit("http://agency"), c, F.lit(".gov./x")),
        F.concat(F.lit("h"), c, F.lit(".example.com/none")),
        F.concat(F.lit("http://u@h"), text, F.lit(".internal:8080/")),
        F.concat(F.lit("http://_srv"), (key % 50).cast("string"), F.lit(".example.org:8080/p?q="), c, F.lit("#f")),
        F.concat(F.lit("http://[2001:db8::"), c, F.lit("]:8080/")),
        F.concat(F.lit("http://[2606:4700::"), c, F.lit("]:8080/")),
        F.concat(F.lit("http://172."), (key % 40).cast("string"), F.lit(".0.1./")),
    ]
    picked = _case(key % len(urls), urls)
    return table(spark, sf_dir, "orders").select(
        key.alias("input_order"), picked.alias("url"),
        F.when(key % 2 == 0, "host_search").otherwise("host_services").alias("source"),
        F.struct(text.alias("seed")).alias("source_meta"),
    )


def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response headers per order, in five orders of sending."""
    key = F.col("o_orderkey")
    orders = [["server", "date"], ["Date", "Server"], ["content-type", "server", "Date"], ["date"], ["server", "server"]]
    value = F.concat(F.lit("v"), key.cast("string"))
    cases = [
        F.array(*[F.struct(F.lit(k).alias("k"), F.concat(value, F.lit(f"-{i}")).alias("v")) for i, k in enumerate(o)])
        for o in orders
    ]
    headers = cases[0]
    for i in range(1, len(cases)):
        headers = F.when(key % 5 == i, cases[i]).otherwise(headers)
    return table(spark, sf_dir, "orders").select(key.alias("snapshot_id"), headers.alias("headers"))


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host-search result pages as JSON text, two matches each, one per customer."""
    key = F.col("c_custkey")
    kinds = [
        ('"ip_str":"203.0.113.', '","port":80'),
        ('"ip_str":"203.0.113.', '","port":8443,"ssl":{"cert":{}}'),
        ('"ip_str":"203.0.113.', '","port":443'),
        ('"ip_str":"203.0.113.', '","port":9000,"ssl":null'),
        ('"ip_str":"203.0.113.', '"'),
        ('"ip_str":"2606:4700::', '","port":8443,"ssl":{}'),
    ]
    host = (key % 200).cast("string")
    body = _case(key % 6, [F.concat(F.lit(a), host, F.lit(b)) for a, b in kinds])
    page = F.concat(
        F.lit('{"total":2,"matches":[{'), body, F.lit(',"asn":"AS'), key.cast("string"),
        F.lit('","org":"Org '), (key % 30).cast("string"), F.lit('","hostnames":["a","h'), host,
        F.lit('"],"location":{"country_code":"DE"},"product":"nginx"},{"port":80,"org":"no address"}]}'),
    )
    return table(spark, sf_dir, "customer").select(page.alias("value"))


def service_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host/service records as JSON lines, three services each, one per customer."""
    key = F.col("c_custkey")
    ip = F.when(key % 5 == 0, F.concat(F.lit("2606:4700::"), (key % 90).cast("string"))).otherwise(
        F.concat(F.lit("198.51.100."), (key % 250).cast("string")))
    line = F.concat(
        F.lit('{"ip":"'), ip, F.lit('","autonomous_system":{"asn":'), key.cast("string"),
        F.lit(',"name":"X"},"services":[{"port":80,"service_name":"http"},{"port":'),
        (key % 2 * 8000 + 443).cast("string"),
        F.lit(',"service_name":"UNKNOWN","extended_service_name":"https"},'
              '{"port":22,"service_name":"SSH"},{"service_name":"HTTP"}]}'),
    )
    return table(spark, sf_dir, "customer").select(line.alias("value"))


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture result lines of twelve kinds, one per order."""
    key = F.col("o_orderkey")
    url = F.concat(F.lit('"url":"'), candidate_url(F.col("o_custkey")), F.lit('"'))
    whole = F.lit(
        ',"http_status":200,"final_url":"http://final/","headers":[["server","nginx"],["date","x"]],'
        '"server_banner":"nginx","server_kind":"nginx","title":"Index of /","is_open_dir":true,'
        '"listing_entries":[{"name":"a.zip","href":"a.zip","is_dir":false,"size":5,"mtime":null,"path":"/a.zip"}],'
        '"entry_count":1,"raw_html_sha256":"aa","header_order_sha256":"bb","template_sha256":"cc",'
        '"favicon_sha256":null,"tls":null}'
    )
    more = F.replace(whole, F.lit('"path":"/a.zip"}],"entry_count":1'), F.lit(
        '"path":"/a.zip"},{"name":"unter/","href":"unter/","is_dir":true,"size":null,"mtime":null,"path":"/unter/"},'
        '{"name":"ä b.csv","href":"%C3%A4%20b.csv","is_dir":false,"size":0,"mtime":null,"path":"/ä b.csv"}],"entry_count":3'))
    kinds = [
        F.concat(F.lit('{"error":"",'), url, whole),
        F.lit("   "),
        F.concat(F.lit("{ not json "), key.cast("string")),
        F.concat(F.lit("{"), url, F.lit(',"http_status":200}')),
        F.lit('{"url":"http://unknown/","http_status":200}'),
        F.concat(F.lit('{"error":"timeout","http_status":null,"final_url":"http://f/",'), url, F.lit("}")),
        F.lit('{"http_status":200}'),
        F.concat(F.lit('{"error":null,'), url, whole),
        F.lit(" \t \r"),
        F.concat(F.lit('{"error":"",'), url, F.lit(',"http_status":"abc"}')),
        F.concat(F.lit('{"error":"","title":"alt",'), url, whole),
        F.concat(F.lit('{"error":"",'), url, more),
    ]
    return table(spark, sf_dir, "orders").select(
        key.alias("snapshot_id"), F.col("o_orderdate").alias("fetched_at"),
        _case(key % 12, kinds).alias("value"),
    )


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reputation answers, one per order."""
    key = F.col("o_orderkey")
    text = key.cast("string")
    stats = F.concat(
        F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), (key % 5).cast("string"),
        F.lit(',"suspicious":1,"harmless":'), (key % 60).cast("string"),
        F.lit('},"type_description":"Win32 EXE","meaningful_name":"n'), text, F.lit('"}}}'))
    bodies = [stats, F.lit('{"data":{"attributes":{}}}'), F.lit(""), F.lit("oops"), F.lit("<html>")]
    status = F.get(F.array(*[F.lit(s) for s in (200, 200, 404, 500, 200)]), (key % 5).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.sha2(text, 256).alias("sha256"), status.alias("status"),
        _case(key % 5, bodies).alias("body"),
    )


def landed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as landed files, some allowlisted by name."""
    doc = F.col("doc_id")
    name = _pick(["run.EXE", "a.sh", "notes.txt", "web_shell.php", "index.php", "x.bin"], doc % 6)
    content = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("file:/landed/"), doc.cast("string"), F.lit("/"), name).alias("path"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


# --- hosts and fingerprints, batches, arrival ---------------------------------

FINGERPRINTS = ("favicon_sha256", "header_order_sha256", "raw_html_sha256")


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of one host per customer with fingerprints that link hosts in threes, in chains and in one hub.

    One page is that of a third of all hosts; most snapshots have no value that another host has.
    """
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    third, pair = F.floor(cust / 3), F.floor((cust + 1) / 2)
    block = third % 30
    return table(spark, sf_dir, "orders").select(
        text("h", cust).alias("host"), key.alias("snapshot_id"),
        F.when(key % 5 < 3, F.sha2(text("f", third), 256)).otherwise(F.lit("")).alias("favicon_sha256"),
        F.when((key % 7 < 5) & block.between(12, 25), F.sha2(text("o", pair), 256)).alias("header_order_sha256"),
        F.when((key % 3 == 0) & (block < 10), F.sha2(F.lit("hub"), 256)).otherwise(F.sha2(text("s", key), 256)).alias("raw_html_sha256"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hash results per payload file, the later one of another content or failed, and ``arrived``, their order."""
    files = payload_hashes(spark, sf_dir).select("hash_id", "snapshot_id", "name", "url").groupBy("snapshot_id", "name", "url").agg(F.min("hash_id.pos").alias("_pos"))
    sid = F.col("snapshot_id")
    twice = files.withColumn("go", F.explode(F.array(F.lit(1), F.lit(2))))
    failed = (F.col("go") == 2) & (sid % 4 == 1)
    return twice.select(
        "snapshot_id", "name", "url", F.struct("go", (sid * 7919 % 1000).alias("o"), "snapshot_id", "name").alias("arrived"),
        F.when(~failed, F.sha2(F.concat("name", sid.cast("string"), F.col("go").cast("string")), 256)).alias("sha256"),
        F.when(~failed, F.md5("url")).alias("md5"), F.lit(None).cast("string").alias("tlsh"),
        F.when(~failed, F.length("url").cast("bigint")).alias("size"), F.when(failed, "http 404").alias("error"),
    )


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that no source can read as they stand, one per supplier."""
    key = F.col("s_suppkey")
    text = key.cast("string")
    kinds = [
        F.concat(F.lit("{ "), text), F.concat(F.lit('{"total":'), text, F.lit("}")), F.lit("  "),
        F.concat(F.lit('{"matches":"'), text, F.lit('","services":"x","status":"x","sha256":"'), text, F.lit('"}')),
        F.concat(F.lit('{"matches":[{"ip_str":"203.0.113.1","port":"x'), text, F.lit('"},7],"services":[],"ip":"'), text, F.lit('","sha256":""}')),
        F.concat(F.lit("["), text, F.lit("]")),
    ]
    return table(spark, sf_dir, "supplier").select(_case(key % len(kinds), kinds).alias("value"))

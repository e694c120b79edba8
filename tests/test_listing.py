"""Listing pages of the usual servers, and the parsing columns behind them."""
import html as std_html
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from vitrine.functions import fingerprints, texts
from vitrine.functions import html as markup
from vitrine.functions.urls import resolved_path, resolved_url, split_url
from vitrine.operators import listing

PAGES = {
    "wide_table": """<HTML><HEAD><TITLE>Index of /ofen/k&auml;se</TITLE></HEAD><BODY><H1>Index of /ofen/k&auml;se</H1>
<TABLE class=liste><thead><tr><th>Datei</th><th>Datum</th><th>Menge</th></tr></thead><tbody>
<tr><td class='n'><A HREF="/ofen/">Parent Directory</A><td>&nbsp;<td>&nbsp;-
<tr><td class='n'><A title="x > y" HREF="reife/">reife/</A><td>&nbsp;2019-07-30 06:05&nbsp;<td>-
<tr><td class='n'><span><A HREF='gouda&amp;edamer.tar'>gouda&amp;edamer.tar</A></span><td>2021-11-09 23:59<td>&nbsp;7.5M&nbsp;
</tbody></TABLE></BODY></HTML>""",
    "sorted_lines": """<html><head><title>Index of /mehl</title></head><body><h1>Index of /mehl</h1>
<pre><a href="?C=M;O=A">Last modified</a> <a href="?C=D;O=A">Description</a><hr>
<img src='/icons/back.gif' alt='[PARENTDIR]'> <a href="/">Parent Directory</a>        -
<img src='/icons/folder.gif' alt='[DIR]'> <a href="roggen/">roggen/</a>   2019-07-30 06:05    -
<img src='/icons/compressed.gif' alt='[   ]'> <a href=weizen.tar>weizen.tar</a>  2021-11-09 23:59  7.5M  gemahlen
</pre></body></html>""",
    "plain_lines": """<html><head><title>Index of /salz/</title></head><body><h1>Index of /salz/</h1><hr><pre>
<a href="../">../</a>
<a href="meer/">meer/</a>&nbsp;&nbsp;30-Jul-2019 06:05&nbsp;&nbsp;     -
<a href="stein.tar">stein.tar</a>  09-Nov-2021 23:59    7864320
<a href="sehr-langer-name-der-abgeschnitten-wird.tar">sehr-langer-name-der-absch..&gt;</a> 09-Nov-2021 23:59 12
</pre></body></html>""",
    "own_icons": """<html><head><title>Index of /icons/</title></head><body><h1>Index of /icons/</h1><pre>
<a href="../">../</a>
<a href="/icons/waage.svg">waage.svg</a>   30-Jul-2019 06:05    333
</pre></body></html>""",
    "script_list": """<!DOCTYPE HTML><html><head><title>Directory listing for /hefe/</title></head>
<body><h1>Directory listing for /hefe/</h1><ul><li><a href="frisch/">frisch/</a></li>
<li><a href="caf%C3%A9.csv">caf&eacute;&#46;csv</a><li><a href="a%26b.odt">a&ampb.odt</a></ul></body></html>""",
    "shop": """<html><head><title>B&auml;ckerei Halm</title><script>document.write("<a href='y'>ja</a>")</script></head>
<body><h1>Guten Tag</h1><!-- <a href="alt">alt</a> --><a href="/brote">Brote</a><a href="#unten">unten</a></body></html>""",
    "heading_only": "<title>Ablage</title><h1> <em>Index</em> of /y</h1><a href='b'>b</a>",
    "wrapped": """<title>Index of /</title><table><tr><td><div><u><i><a href="tief.tar">tief.tar</a></i></u></div></td>
<td>2021-11-09 23:59</td><td>8</td></tr></table>""",
}


def _pages(spark):
    rows = [(name, "http://ex.com/pub/", html) for name, html in PAGES.items()]
    return spark.createDataFrame(rows, "page_id string, url string, html string")


def test_entries_of_each_layout(spark):
    rows = listing.extract_entries(_pages(spark)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["pos"]):
        found.setdefault(r["page_id"], []).append((r["name"], r["is_dir"], r["size"], r["mtime"], r["path"]))
    folder = lambda name: (name, True, None, "2019-07-30T06:05", f"/pub/{name}")
    archive = lambda name: (name, False, 7864320, "2021-11-09T23:59", f"/pub/{name}")
    assert found["wide_table"] == [folder("reife/"), archive("gouda&edamer.tar")]
    assert found["sorted_lines"] == [folder("roggen/"), archive("weizen.tar")]
    assert found["plain_lines"][:2] == [folder("meer/"), archive("stein.tar")]
    assert found["plain_lines"][2][:3] == ("sehr-langer-name-der-absch..>", False, 12)
    assert found["own_icons"] == [("waage.svg", False, 333, "2019-07-30T06:05", "/icons/waage.svg")]
    assert [e[:4] for e in found["script_list"]] == [("frisch/", True, None, None), ("café.csv", False, None, None), ("a&b.odt", False, None, None)]
    assert [e[0] for e in found["shop"]] == ["Brote"]
    # the row is more than four ancestors away, and no text follows the anchor
    assert found["wrapped"] == [("tief.tar", False, None, None, "/pub/tief.tar")]


def test_validation_and_server(spark):
    snaps = {r["page_id"]: r for r in listing.snapshots_from_pages(_pages(spark)).collect()}
    kinds = {k: r["server_kind"] for k, r in snaps.items()}
    assert kinds["wide_table"] == kinds["sorted_lines"] == "apache"
    assert kinds["plain_lines"] == kinds["own_icons"] == "nginx"
    assert (kinds["script_list"], kinds["shop"]) == ("python", "unknown")
    assert {k for k, r in snaps.items() if not r["is_open_dir"]} == {"shop"}
    assert (snaps["shop"]["title"], snaps["wide_table"]["title"]) == ("Bäckerei Halm", "Index of /ofen/käse")
    assert snaps["plain_lines"]["entry_count"] == 3
    assert "html" not in snaps["plain_lines"].asDict()


def test_whole_titles_and_banners_are_kept(spark):
    long = "Index of /" + "teig/" * 300
    page = spark.createDataFrame([("p", "http://a.test/", f"<title>{long}</title>")], "page_id string, url string, html string")
    assert listing.validate_listing(page).first()["title"] == long
    headers = spark.createDataFrame([([("server", "x" * 900)],)], "h array<struct<k: string, v: string>>")
    assert headers.select(fingerprints.server_banner(F.col("h"))).first()[0] == "x" * 900


def test_character_references_decode_like_the_standard_library(spark):
    texts_ = ["&eacute;", "&eacute", "&notit;", "&NotEqualTilde;", "&amp;lt;", "&#x41;&#66", "&#0;", "&#128;", "&unbekannt;", "&", "a & b &c", "&lt;&gt;&quot;&apos;&nbsp;|"]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", markup.unescape(F.col("t")).alias("u")).collect()}
    assert got == {t: std_html.unescape(t) for t in texts_}


def test_sizes_and_dates(spark):
    sizes = {"7864320": 7864320, "7.5M": 7864320, "0.5T": 549755813888, "3P": 3377699720527872, "-": None, "": None,
             "viel": None, "7.5.1": None, "\t 9 KiB\xa0": 9216, "0.00048828125K": 0, "2.2k": 2253, ".5K": 512}
    dates = {"09-Nov-2021 23:59": "2021-11-09T23:59", "2021-11-09   23:59 CET": "2021-11-09T23:59", "-": None,
             "": None, "09-Nie-2021 23:59": "09-Nie-2021 23:59", "\u2003gestern ": "gestern"}
    df = spark.createDataFrame([(t,) for t in {**sizes, **dates}], "t string")
    rows = {r["t"]: r for r in df.select(
        "t", texts.size_col(F.col("t")).alias("s"), texts.mtime_col(F.col("t")).alias("m")).collect()}
    assert {t: rows[t]["s"] for t in sizes} == sizes
    assert {t: rows[t]["m"] for t in dates} == dates


def test_references_resolve_like_the_standard_library(spark):
    bases = ["http://ex.com/files/", "http://ex.com/a/b/page.html?q=1", "http://ex.com", "http://ex.com:81/x//y/", "http://ex.com/p/../q/"]
    refs = ["a.zip", "sub/", "/abs/x", "../up", "../../../far", "./here", ".", "..", "a/../b/./c/", ".env", "..name",
            "//other.org/p//q", "http://other.org/x/../y?z#f", "mailto:me@x", "x?q=1#frag", "a//b", "/a//b/../c", "b;p=1"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "base string, ref string").select(
        "base", "ref", split_url(F.col("base")).alias("b"), split_url(F.col("ref")).alias("r"))
    df = df.withColumn("path", resolved_path(F.col("b"), F.col("r")))
    df = df.withColumn("whole", resolved_url(F.col("b"), F.col("r"), F.col("path")))
    for row in df.collect():
        expected = urljoin(row["base"], row["ref"])
        assert row["path"] == urlsplit(expected).path, row
        if not row["ref"].startswith("mailto"):
            assert row["whole"] == expected, row


def test_fingerprints(spark):
    many = "".join(f"<a href='{i}.bin'>{i}.bin</a> {i}\n" for i in range(9))
    frame = "<html><body><h1>Index of /%s</h1><pre>%s</pre></body></html>"
    pages = [frame % ("a", "<a href='x'>x</a> 1\n"), frame % ("other", many),
             "<html><body><table><tr><td><a href='x'>x</a></td></tr></table></body></html>",
             "<table><tbody><tr><td><a href='y'>y</a><td>2</table>"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    a, b, table, implied = [r[0] for r in df.select(fingerprints.template_hash(F.col("html"))).collect()]
    assert a == b and a != table and table == implied
    headers = spark.createDataFrame(
        [(1, [("server", "nginx"), ("date", "x")]), (2, [("Server", "apache"), ("date", "y")]), (3, [("date", "x"), ("server", "n")])],
        "i int, h array<struct<k: string, v: string>>")
    rows = headers.orderBy("i").select(fingerprints.header_hash(F.col("h")), fingerprints.server_banner(F.col("h"))).collect()
    assert rows[0][0] == rows[1][0] != rows[2][0]
    assert [r[1] for r in rows] == ["nginx", "", "n"]
    icons = spark.createDataFrame([(200, "x"), (200, ""), (404, "x"), (None, "x")], "s int, b string")
    assert [r[0] is not None for r in icons.select(fingerprints.favicon_hash(F.col("s"), F.col("b"))).collect()] == [True, False, False, False]


def test_a_template_is_folded_once_per_sequence_of_tags(spark):
    pages = [(i, f"<html><body><h1>Index of /{i}</h1><pre><a href='{i}'>{i}</a> <a\nhref='x{i}'>x</a></pre>") for i in range(300)]
    pages += [(300, None), (301, ""), (302, "<table><TR><td>1<td>2<!-- <b> --><tr></table>"), (303, "<a\"b c\"><p x='>'>"), (303, "<ul><li>x<li>y")]
    rows = spark.createDataFrame(pages, "page_id int, html string")
    plain = listing.with_template_hash(rows).select("page_id", "template_sha256")
    found = listing.template_hashes(rows)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found.where("template_sha256 is not null").select("template_sha256").distinct().count() == 5
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()  # the pages are not read again


def test_fields_of_entries_alone(spark):
    whole = listing.extract_entries(_pages(spark))
    for fields in (("name", "href", "is_dir"), ("path",), ("size", "mtime"), ("mtime",)):
        part = listing.extract_entries(_pages(spark), fields)
        assert part.columns == ["page_id", "pos", *fields]
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(*part.columns).collect()))


def test_common_references_beside_others(spark):
    texts_ = ["&nbsp;&nbsp", "&&nbsp;", "&amp;nbsp;", "&#38nbsp;", "&amp&nbsp;lt;", "&quot;&eacute&nbsp;&gt", "&nbsp;;&am"]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    assert {r["t"]: r["u"] for r in df.select("t", markup.unescape(F.col("t")).alias("u")).collect()} == {t: std_html.unescape(t) for t in texts_}

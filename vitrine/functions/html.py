"""Listing markup as columns: anchors, rows, titles, server markers.

A page is cut into rows, cells and anchors by marking the tags with control
characters and splitting on them, so one page is parsed by a few linear passes
and stays one row until the caller explodes it. Markup nested in ways that need
a real tree (tables inside cells) is not followed.
"""
import html as html_text
import html.entities as html_names
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import patterns as P
from vitrine.functions.binding import let
from vitrine.functions.texts import BLANK, mtime_col, size_col, strip
from vitrine.functions.urls import is_plain_name, resolved_path, split_url

_ANCHOR, _ROW, _CELL = "\x01", "\x02", "\x03"
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
)
_ATTRIBUTES = r"""^((?:[^>"']++|"[^"]*+"|'[^']*+')*+)"""
_ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
_OPENING = (
    r"(?i)<(?!(?:area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)\b)[a-z]"
)
_CLOSING = r"(?i)</(?!a\b)[a-z]"
# `<tr>` may be at most four ancestors up: the cell, and two more around the anchor
_MAX_WRAPPERS = 2
_META = "struct<size: bigint, mtime: string>"


# every named reference of the standard, with those that may lack the semicolon
_NAMED = html_names.html5
_LEGACY = max((n for n in _NAMED if not n.endswith(";")), key=len)
_REFERENCE = r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|[a-zA-Z][a-zA-Z0-9]{0,31};?)"


def _numeric(token: Column) -> Column:
    """The character of a numeric reference, with the replacements of the standard."""
    digits = F.regexp_replace(F.regexp_extract(token, r"([0-9a-fA-F]+);?$", 1), "^0+(?=.)", "")
    short = F.length(digits) <= 8
    code = F.when(short, F.when(token.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits)).cast("bigint")
    replaced = F.create_map(*[F.lit(x) for pair in invalid_charrefs().items() for x in pair])[code.cast("int")]
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    text = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    dropped = code.between(1, 8) | code.between(0xE, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | (code == 0xB) | (code.bitwiseAND(F.lit(0xFFFE).cast("bigint")) == 0xFFFE)
    return F.coalesce(replaced, F.when(~F.coalesce(valid, F.lit(False)), "\ufffd").when(dropped, "").otherwise(text))


def invalid_charrefs() -> dict[int, str]:
    """What the standard puts for the numbers 0 and 128 to 159, and a return."""
    return {n: html_text.unescape(f"&#{n};") for n in (0, 13, *range(0x80, 0xA0))}


def _named(token: Column, table: Column) -> Column:
    """A whole name, or the longest known start of one, its rest kept; else the token itself."""
    name = F.substring(token, 2, 40)
    starts = F.transform(
        F.sequence(F.least(F.length(name), F.lit(len(_LEGACY))), F.lit(1), F.lit(-1)), lambda n: F.struct(n.alias("n"), table[F.substring(name, F.lit(1), n)].alias("c"))
    )
    best = F.get(F.filter(starts, lambda s: s["c"].isNotNull() & (s["n"] > 1)), F.lit(0))
    return F.coalesce(table[name], let(best, lambda b: F.concat(b["c"], F.substring(name, b["n"] + 1, F.lit(40)))), token)


def _replace_references(text: Column) -> Column:
    # both sides of every reference, in order, in one pass
    table = F.from_json(F.lit(json.dumps(_NAMED)), "map<string, string>")
    tokens = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    between = F.split(text, _REFERENCE, -1)
    # the table is searched from its start: the commonest names are told before
    common = lambda t: F.when(t == "&amp;", "&").when(t == "&lt;", "<").when(t == "&gt;", ">").when(t == "&quot;", '"')
    decoded = F.transform(tokens, lambda t: common(t).when(t.startswith("&#"), _numeric(t)).otherwise(_named(t, table)))
    return F.concat(F.get(between, F.lit(0)), F.array_join(
        F.zip_with(decoded, F.slice(between, 2, 1 << 30), lambda d, rest: F.concat(d, rest)), ""))


def unescape(text: Column) -> Column:
    """Replace numeric and named character references."""
    # no reference reaches over an ampersand, and a blank begins none: those of blanks can be replaced first
    blanks = F.replace(text, F.lit("&nbsp;"), F.lit("\xa0"))
    return let(blanks, lambda t: F.when(t.contains("&"), _replace_references(t)).otherwise(t))


def plain_text(markup: Column) -> Column:
    """Text content of a piece of markup."""
    return unescape(F.regexp_replace(markup, r"<[^>]*>?", ""))


def visible(html: Column) -> Column:
    """The page without comments, scripts, styles and the marker characters."""
    return F.regexp_replace(F.translate(html, _ANCHOR + _ROW + _CELL, ""), _HIDDEN, "")


def _marked(clean: Column) -> Column:
    text = F.regexp_replace(clean, r"(?i)<a(?=[\s>/])", _ANCHOR)
    text = F.regexp_replace(text, r"(?i)<tr(?=[\s>/])", _ROW + "R")
    text = F.regexp_replace(text, r"(?i)</t(?:r|able)\b", _ROW + "E")
    text = F.regexp_replace(text, r"(?i)<t([dh])(?=[\s>/])", _CELL + "$1")
    return F.concat(F.lit("E"), text)


def _attribute(attributes: Column, name: str) -> Column:
    """Value of the first attribute of that name; empty if absent."""
    names = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(2))
    place = F.array_position(F.transform(names, F.lower), name)
    raw = F.coalesce(F.get(values, (place - 1).cast("int")), F.lit(""))
    return unescape(F.regexp_replace(raw, r"""^["']|["']$""", ""))


def _href(attributes: Column) -> Column:
    """The link of an anchor; most have this one attribute, in quotes, and are read by one pattern."""
    alone = F.regexp_extract(attributes, r'(?i)^\s+href="([^"]+)"\s*$', 1)
    return let(alone, lambda href: F.when(href != "", unescape(href)).otherwise(_attribute(attributes, "href")))


def _row_meta(row: Column) -> Column:
    """Size and date of a table row: its first date cell and first size cell."""
    cells = F.filter(
        F.slice(F.split(row, _CELL), 2, 1 << 30),
        lambda c: c.rlike("^[dD]") & ~c.contains(_ANCHOR),
    )
    texts = F.transform(cells, lambda c: strip(plain_text(F.regexp_replace(c, r"^[^>]*>?", ""))))
    return let(
        texts,
        lambda t: F.struct(
            F.get(F.filter(F.transform(F.filter(t, lambda x: x.rlike(P.SIZE_HINT)), size_col),
                           lambda s: s.isNotNull()), F.lit(0)).alias("size"),
            mtime_col(F.get(F.filter(t, lambda x: x.rlike(P.DATE_HINT)), F.lit(0))).alias("mtime"),
        ),
    )


def _line_meta(tail: Column) -> Column:
    """Size and date from the text that follows an anchor on its line."""
    def parts(pattern: str) -> Column:
        return F.array(F.regexp_extract(tail, pattern, 1), F.regexp_extract(tail, pattern, 2))

    found = F.when(tail.rlike(P.NGINX_TAIL), parts(P.NGINX_TAIL)).when(
        tail.rlike(P.APACHE_TAIL), parts(P.APACHE_TAIL)
    )
    return let(
        found,
        lambda f: F.struct(
            size_col(F.get(f, F.lit(1))).alias("size"), mtime_col(F.get(f, F.lit(0))).alias("mtime")
        ),
    )


def _cell_anchors(cell: Column, meta: Column) -> Column:
    """The anchors of one cell, each with the row's metadata if it is close enough."""
    def located(pieces: Column) -> Column:
        plain = F.transform(F.slice(pieces, 2, 1 << 30), lambda p: F.struct(p.alias("markup"), F.when(F.lit(False), meta).alias("meta")))
        # wrappers open before each anchor, summed up once along the cell
        start = F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("before"))
        opened = F.aggregate(
            F.transform(pieces, lambda p: F.regexp_count(p, F.lit(_OPENING)) - F.regexp_count(p, F.lit(_CLOSING))),
            start,
            lambda acc, d: F.struct((acc["open"] + d).alias("open"), F.array_append(acc["before"], acc["open"] + d).alias("before")),
        )["before"]
        close = let(opened, lambda before: F.transform(
            F.slice(pieces, 2, 1 << 30),
            lambda p, i: F.struct(p.alias("markup"), F.when(F.get(before, i) <= _MAX_WRAPPERS, meta).alias("meta")),
        ))
        return F.when(meta.isNull(), plain).otherwise(close)

    return let(F.split(cell, _ANCHOR), located)


#: What is known of an entry.
FIELDS = ("name", "href", "is_dir", "size", "mtime", "path")


def listing_entries(clean: Column, base: Column, directory: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Entries of a page in order, as an array of structs of ``fields``; others are not computed.

    ``clean`` is ``visible(html)``, ``base`` the split page URL and ``directory``
    its directory, all already columns. Sort links, fragments and parent links
    are left out.
    """
    dated = "size" in fields or "mtime" in fields
    row_meta = (lambda r: F.when(r.startswith("R"), _row_meta(r))) if dated else (lambda r: F.lit(None).cast(_META))
    rows = F.transform(F.split(_marked(clean), _ROW), lambda r: F.struct(r.alias("text"), row_meta(r).alias("meta")))
    anchors = F.flatten(
        F.transform(
            F.filter(rows, lambda r: r["text"].contains(_ANCHOR)),
            lambda r: F.flatten(
                F.transform(
                    F.filter(F.split(r["text"], _CELL), lambda c: c.contains(_ANCHOR)),
                    lambda c: _cell_anchors(c, r["meta"]),
                )
            ),
        )
    )
    opened = F.transform(
        anchors,
        lambda a: let(
            F.regexp_extract(a["markup"], _ATTRIBUTES, 1),
            lambda attributes: F.struct(
                _href(attributes).alias("href"),
                F.substring(a["markup"], F.length(attributes) + 2, F.length(a["markup"])).alias("body"),
                a["meta"].alias("meta"),
            ),
        ),
    )
    linked = F.filter(opened, lambda a: (a["href"] != "") & ~a["href"].rlike("^[?#]"))
    named = F.transform(
        linked,
        lambda a: F.struct(
            let(
                plain_text(F.regexp_extract(a["body"], r"(?is)^(.*?)(?:</a\b|\z)", 1)),
                lambda text: strip(F.when(text == "", a["href"]).otherwise(text)),
            ).alias("name"),
            a["href"].alias("href"),
            (F.coalesce(
                a["meta"],
                let(
                    F.regexp_replace(unescape(F.regexp_extract(a["body"], r"(?is)</a\s*>([^<\n]*)", 1)), BLANK, " "), _line_meta),
            ) if dated else a["meta"]).alias("meta"),
        ),
    )
    kept = F.filter(
        named, lambda a: ~F.lower(a["name"]).isin(P.PARENT_NAMES) & ~a["href"].isin("../", "..")
    )
    made = {
        "name": lambda a: a["name"],
        "href": lambda a: a["href"],
        "is_dir": lambda a: a["href"].endswith("/"),
        "size": lambda a: a["meta"]["size"],
        "mtime": lambda a: a["meta"]["mtime"],
        "path": lambda a: F.when(is_plain_name(a["href"]), F.concat(directory, a["href"]))
        .otherwise(let(split_url(a["href"]), lambda ref: resolved_path(base, ref))),
    }
    return F.transform(kept, lambda a: F.struct(*[made[f](a).alias(f) for f in fields]))


def page_title(clean: Column) -> Column:
    """Text of the first title element, blanks stripped."""
    return strip(unescape(F.regexp_extract(clean, r"(?is)<title\b[^>]*>(.*?)(?:</title|\z)", 1)))


def is_listing(clean: Column, title: Column) -> Column:
    """The title or a first-level heading carries an index signature."""
    signature = "(?i)" + P.LISTING_SIGNATURE
    headings = F.regexp_extract_all(clean, F.lit(r"(?is)<h1\b[^>]*>(.*?)(?:</h1|\z)"), F.lit(1))
    return title.rlike(signature) | F.exists(headings, lambda h: strip(plain_text(h)).rlike(signature))


def server_kind(html: Column, clean: Column) -> Column:
    """Which server wrote the listing, judged from its markup."""
    low = F.lower(html)
    sort_links = clean.rlike(r"(?i)<a\s(?:[^>]*[\s\"'])?href\s*=\s*[\"']?\?c=")
    icons = clean.rlike(r"(?i)<img\s(?:[^>]*[\s\"'])?src\s*=\s*[\"']?[^\s\"'>]*/icons/")
    return (
        F.when(low.contains("directory listing for"), "python")
        .when(sort_links | icons, "apache")
        .when(low.contains("index of") & low.contains("<pre"), "nginx")
        .when(low.contains("index of"), "apache")
        .otherwise("unknown")
    )

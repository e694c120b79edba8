"""Fingerprint columns: equal values mean equal pages, header orders, templates."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.binding import let

# Elements without a closing tag, and elements whose content is not markup.
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
}
_RAW = {"script", "style", "title", "textarea"}
_HEAD = {"head", "title", "meta", "link", "base", "style", "script"}
# a comment, or a tag with its name (a closing one with the slash) as group 1
_TOKEN = (
    r"""(?s)<!--.*?(?:-->|\z)|<(?=(/?[a-zA-Z][^\s/>]*))/?[a-zA-Z][^\s/>]*(?:[^>"']++|"[^"]*"|'[^']*')*+(?:>|\z)"""
)


def body_hash(html: Column) -> Column:
    return F.sha2(html, 256)


def header_hash(headers: Column) -> Column:
    """Hash of the header names in the order sent; values do not count."""
    return F.sha2(F.array_join(F.transform(headers, lambda h: F.lower(h["k"])), ","), 256)


def server_banner(headers: Column) -> Column:
    """Value of the first ``server`` header; else empty."""
    first = F.get(F.filter(headers, lambda h: h["k"] == "server"), F.lit(0))
    return F.coalesce(first["v"], F.lit(""))


def favicon_hash(status: Column, body: Column) -> Column:
    """Hash of a fetched icon; null unless it answered 200 with a body."""
    return F.when((status == 200) & (F.length(body) > 0), F.sha2(body, 256))


def self_signed(issuer: Column, subject: Column) -> Column:
    return issuer == subject


_STATE = "struct<stack: array<string>, raw: string, paths: array<string>>"


def _cut(stack: Column, tag: Column) -> Column:
    """The stack below the last element of that name."""
    return F.slice(stack, 1, F.size(stack) - F.array_position(F.reverse(stack), tag).cast("int"))


def _opened(stack: Column, tag: Column) -> Column:
    """The stack on which a new element stands, with what a parser supplies or closes first."""
    top = lambda s: F.element_at(s, -1)
    below = lambda s: F.slice(s, 1, F.size(s) - 1)
    pair = lambda name: F.array(F.lit("html"), F.lit(name))
    in_head = tag.isin(*_HEAD)
    rooted = (
        F.when(F.size(stack) == 1, F.when(in_head, pair("head")).otherwise(pair("body")))
        .when((stack == pair("head")) & ~in_head, pair("body"))
        .otherwise(stack)
    )
    item = tag.isin("li", "tr", "td", "th")

    def closed(s: Column) -> Column:
        inner = let(below(s), lambda b: F.when((tag == "tr") & (top(b) == "tr"), below(b)).otherwise(b))
        return (
            F.when((tag == "a") & F.array_contains(s, "a"), _cut(s, F.lit("a")))
            .when(item & top(s).isin("li", "td", "th"), inner)
            .otherwise(s)
        )

    row = lambda s: F.when((tag == "tr") & (top(s) == "table"), F.array_append(s, F.lit("tbody"))).otherwise(s)
    return let(let(rooted, closed), row)


def tag_text(html: Column) -> Column:
    """The tags of a page in order, one a line, without attributes; pages of equal tags have equal paths."""
    return F.lower(F.array_join(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(1)), "\n"))


def tag_paths(tags: Column) -> Column:
    """The distinct root-to-node tag paths of a page, sorted, from its ``tag_text``."""
    tokens = F.filter(
        F.transform(
            F.split(tags, "\n"), lambda t: F.struct(t.startswith("/").alias("closing"), F.ltrim(t, F.lit("/")).alias("tag"))
        ),
        lambda t: ~t["tag"].isin("", "html"),
    )
    start = F.struct(
        F.array(F.lit("html")).alias("stack"), F.lit("").alias("raw"),
        F.array(*[F.lit(p) for p in ("html", "html/head", "html/body")]).alias("paths"),
    ).cast(_STATE)

    def state(stack: Column, raw: Column, paths: Column) -> Column:
        return F.struct(stack.alias("stack"), raw.alias("raw"), paths.alias("paths")).cast(_STATE)

    def step(acc: Column, t: Column) -> Column:
        tag, stack, none = t["tag"], acc["stack"], F.lit("")

        def on(s: Column) -> Column:
            path = F.concat(F.array_join(s, "/"), F.lit("/"), tag)
            # a page has many tags and few paths: most are known, and nothing is copied for those
            known = lambda paths, p: F.when(F.array_contains(paths, p), paths).otherwise(F.array_append(paths, p))
            body = (tag == "tr") & (F.element_at(s, -1) == "tbody")
            above = F.when(body, known(acc["paths"], F.array_join(s, "/"))).otherwise(acc["paths"])
            return state(
                F.when(tag.isin(*_VOID), s).otherwise(F.array_append(s, tag)),
                F.when(tag.isin(*_RAW), tag).otherwise(none),
                let(path, lambda p: let(above, lambda paths: known(paths, p))),
            )

        return (
            F.when((acc["raw"] != "") & ~(t["closing"] & (tag == acc["raw"])), acc)
            .when(t["closing"], state(F.when(F.array_contains(stack, tag), _cut(stack, tag)).otherwise(stack), none, acc["paths"]))
            .when(tag.isin("head", "body"), state(F.array(F.lit("html"), tag), none, acc["paths"]))
            .otherwise(let(_opened(stack, tag), on))
        )

    return F.sort_array(F.aggregate(tokens, start, step)["paths"])


def template_hash(html: Column) -> Column:
    """Hash of the set of tag paths: one value per page template.

    Names, dates and the number of entries do not change it. The stack of open
    elements is folded over the tags of the page by built-in array functions.
    """
    return tags_hash(tag_text(html))


def tags_hash(tags: Column) -> Column:
    """``template_hash`` of a page from its ``tag_text``."""
    return F.sha2(F.array_join(tag_paths(tags), "\n"), 256)

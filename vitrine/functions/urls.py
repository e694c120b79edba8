"""URL columns: splitting, normal form, dedup key, reference resolution.

``parse_url`` is not used: it returns null for host names with an underscore
and fails under ANSI mode on broken URLs, both of which occur in exports.

A URL is split once into a struct (``split_url``); everything else reads that
struct. Callers put it in a column of its own first, so that the regular
expressions run once per URL and not once per use.
"""
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.binding import let

# scheme, authority, path, query, fragment (RFC 3986, appendix B)
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
_BLANKS = "".join(chr(i) for i in range(33))


def _host_and_port(location: Column) -> Column:
    bracketed = F.regexp_extract(location, r"\[([^\]]*)", 1)
    # only an IPv6 address may stand in brackets
    bracketed = F.when(bracketed.contains(":"), bracketed)
    host = F.when(location.contains("["), bracketed).otherwise(F.substring_index(location, ":", 1))
    port = F.regexp_extract(location, r"^(?:[^\[]*\[[^\]]*\][^:]*|[^:\[]*):0*([0-9]{1,5})$", 1)
    # try_cast raises and catches for every text that is no number, which is slow
    port = F.when(port != "", port.cast("int"))
    return F.struct(
        F.nullif(F.lower(host), F.lit("")).alias("host"), F.when(port <= 65535, port).alias("port")
    )


def _cleaned(url: Column) -> Column:
    return F.ltrim(F.translate(url, "\t\r\n", ""), F.lit(_BLANKS))


def host_of(url: Column) -> Column:
    """Only the host of a URL: the ``host`` field of ``split_url``, for less work."""
    location = F.regexp_extract(_cleaned(url), _AUTHORITY + r"([^/?#]*@)?([^@/?#]*)", 2)
    return let(location, _host_and_port)["host"]


def _split(url: Column) -> Column:
    slashed = F.regexp_extract(url, _SPLIT, 2)
    location = F.regexp_extract(slashed, r"([^@/]*)$", 1)
    return let(
        let(location, _host_and_port),
        lambda place: F.struct(
            F.lower(F.regexp_extract(url, _SPLIT, 1)).alias("scheme"),
            F.when(url.rlike(_AUTHORITY), F.substring(slashed, 3, 1 << 30)).alias("authority"),
            place["host"].alias("host"),
            place["port"].alias("port"),
            F.regexp_extract(url, _SPLIT, 3).alias("path"),
            F.regexp_extract(url, _SPLIT, 4).alias("query"),
            F.regexp_extract(url, _SPLIT, 5).alias("fragment"),
        ),
    )


def split_url(url: Column) -> Column:
    """Struct of scheme, authority (null if none), host, port, path, query, fragment.

    Leading blanks and any tab or line break do not count. ``host`` is
    lower-cased, without brackets, null if empty; ``port`` is null unless a
    valid port number is written out.
    """
    return let(_cleaned(url), _split)


def repaired(url: Column) -> Column:
    """A URL without ``://`` is read as an http URL."""
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text == "", "").otherwise(F.concat(F.lit(mark), text))


def netloc(u: Column) -> Column:
    """Host and port of a split URL: IPv6 in brackets, default ports left out."""
    host = F.coalesce(u["host"], F.lit(""))
    literal = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    default = ((u["scheme"] == "http") & (u["port"] == 80)) | ((u["scheme"] == "https") & (u["port"] == 443))
    shown = u["port"].isNotNull() & (u["port"] != 0) & ~default
    return F.concat(literal, F.when(shown, F.concat(F.lit(":"), u["port"].cast("string"))).otherwise(""))


def normal_form(u: Column) -> Column:
    """Lower-case scheme and host, no default port, root path, no fragment."""
    path = F.when(u["path"] == "", "/").otherwise(u["path"])
    return F.concat(u["scheme"], F.lit("://"), netloc(u), path, _prefixed("?", u["query"]))


def dedup_form(u: Column) -> Column:
    """Scheme-free identity of a URL; trailing slashes do not count."""
    path = F.rtrim(u["path"], F.lit("/"))
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(netloc(u), path, _prefixed("?", u["query"]))


def _folded(path: Column) -> Column:
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise(""))


def _fold_dots(path: Column) -> Column:
    """Apply the ``.`` and ``..`` segments of a path."""
    return let(path, lambda p: F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), _folded(p)).otherwise(p))


def is_foreign(base: Column, ref: Column) -> Column:
    """The reference names its own place: another scheme, or an authority."""
    scheme = (ref["scheme"] != "") & (ref["scheme"] != base["scheme"])
    return scheme | (ref["authority"].isNotNull() & (ref["authority"] != ""))


def is_plain_name(ref: Column) -> Column:
    """A reference that is one path segment: it just follows the base directory."""
    return ref.rlike(r"^(?!\.{1,2}/?$)[^:/?#\x00-\x20][^:/?#\t\r\n]*/?$")


def _joined(base: Column, tail: Column | None = None) -> Column:
    directory = F.coalesce(F.nullif(F.regexp_extract(base["path"], r"^((?s:.*)/)", 1), F.lit("")), F.lit("/"))
    whole = directory if tail is None else F.concat(directory, tail)
    return F.regexp_replace(whole, r"/{2,}", "/")


def _rooted(path: Column) -> Column:
    return F.concat(F.lit("/"), F.regexp_replace(_fold_dots(path), r"^/", ""))


def base_directory(base: Column) -> Column:
    """Directory of a split page URL, in the form plain names are appended to."""
    return _rooted(_joined(base))


def directory_url(base: Column) -> Column:
    """What the URLs of plain names beside a split page URL begin with."""
    place = F.when(base["authority"].isNotNull(), F.concat(F.lit("//"), base["authority"])).otherwise("")
    return F.concat(base["scheme"], F.lit(":"), place, base_directory(base))


def resolved_path(base: Column, ref: Column) -> Column:
    """Path of a split reference resolved against a split base URL."""
    return (
        F.when(is_foreign(base, ref), ref["path"])
        .when(ref["path"] == "", base["path"])
        .when(ref["path"].startswith("/"), _rooted(ref["path"]))
        .otherwise(_rooted(_joined(base, ref["path"])))
    )


def resolved_url(base: Column, ref: Column, path: Column) -> Column:
    """The whole resolved URL, given its resolved path."""
    foreign = is_foreign(base, ref)
    scheme = F.when(ref["scheme"] == "", base["scheme"]).otherwise(ref["scheme"])
    authority = F.when(foreign, ref["authority"]).otherwise(base["authority"])
    inherits = ~foreign & (ref["path"] == "") & (ref["query"] == "")
    query = F.when(inherits, base["query"]).otherwise(ref["query"])
    return F.concat(
        scheme, F.lit(":"),
        F.when(authority.isNotNull(), F.concat(F.lit("//"), authority)).otherwise(""),
        path, _prefixed("?", query), _prefixed("#", ref["fragment"]),
    )

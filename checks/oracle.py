"""The registered queries in SQL over the same tables, for DuckDB.

Common parts are named sub-queries; a query lists those it needs. Dictionaries
are tested as whole regular expressions here, without the shortcuts of the
Spark columns, so the shortcuts are checked as well.
"""
import hashlib

from checks.tables import LAYOUTS, NAMES, ORGS, SALT
from vitrine.functions import patterns as P
from vitrine.functions.fingerprints import _HEAD, _RAW, _VOID


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def _match(patterns, text="lower(name)") -> str:
    return f"regexp_matches({text}, {q('|'.join(f'(?:{p})' for p in patterns))})"


FAMILIES = {"s": P.SENSITIVE, "p": P.PAYLOAD, "i": P.INTEREST, "b": P.BAIT}
SIGNALS = {c: f"{f}_{c}" for f in "spi" for c in FAMILIES[f]}
ANY_INTEREST = " OR ".join(f"({_match(p)})" for p in P.INTEREST.values())
EXT = f"regexp_extract(lower(name), {q(P.EXT_PATTERN)}, 1)"
LAST_EXT = "CASE WHEN contains(name, '.') THEN regexp_extract(lower(name), '(\\.[^.]*)$', 1) ELSE '' END"
WEBSHELL = f"({LAST_EXT}) IN {_in(P.WEB_SCRIPT_EXTS)} AND {_match([P.WEBSHELL_NAME])}"
PAYLOAD = f"(({LAST_EXT}) IN {_in(P.PAYLOAD_EXTS)} OR ({WEBSHELL}))"


def _rank(malicious: str) -> str:
    return (
        f"CASE WHEN {PAYLOAD} AND (({WEBSHELL}) OR coalesce({malicious}, 0) > 0) THEN 0 WHEN {ANY_INTEREST} THEN 1 "
        f"WHEN {PAYLOAD} THEN 2 WHEN coalesce(size, 0) >= {P.BIG_FILE_BYTES} THEN 3 ELSE 4 END"
    )


def _sum(family: str, categories) -> str:
    return "(" + " + ".join(f"{family}_{c}" for c in categories) + ")"


def _reasons(family: str, categories) -> str:
    cases = ", ".join(f"CASE WHEN {family}_{c} >= 1 THEN {q(c)} END" for c in categories)
    return f"concat_ws('|', {cases})"


def _flagged_names(prefix: str, names: dict[str, str], sep: str = "|") -> str:
    cases = ", ".join(f"CASE WHEN {prefix}{k} THEN {q(n)} END" for k, n in names.items())
    return f"concat_ws({q(sep)}, {cases})"


RULE1 = "(p_webshell >= 1 OR p_malware_tool >= 1)"
RULE2 = f"({_sum('s', P.TRIGGER_CATEGORIES)} >= 1)"
RULE3 = f"({_sum('p', P.PAYLOAD)} >= 1 AND mirror_ratio < 0.6::DOUBLE)"
RULE4 = "(mirror_ratio >= 0.6::DOUBLE AND file_count >= 3)"


def _rules(one, two, three, four, five) -> str:
    return (
        f"CASE WHEN {RULE1} THEN {one} WHEN {RULE2} THEN {two} WHEN {RULE3} THEN {three} "
        f"WHEN {RULE4} THEN {four} ELSE {five} END"
    )


def _confidence(hits: str) -> str:
    return f"least(0.6::DOUBLE + 0.1::DOUBLE * {hits}, 0.95::DOUBLE)"


URL = "'http://h' || ({c} % 400)::VARCHAR || '.example:' || ({c} // 400 + 8000)::VARCHAR || '/'"
LINE = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
_ALL_HITS = [(f, c, p) for f, table in FAMILIES.items() for c, p in table.items()]
_NUMBERS = ["entry_count", "file_count", "dir_count", "mirror_files", "known_sizes", "total_bytes", "over"]

_key = SALT.encode().ljust(64, b"\0")
_IPAD, _OPAD = (bytes(b ^ x for b in _key).hex() for x in (0x36, 0x5C))


def _token(host: str) -> str:
    inner = f"sha256(from_hex('{_IPAD}') || encode({host}))"
    return f"'host-' || left(sha256(from_hex('{_OPAD}') || from_hex({inner})), 6)"


def _kinds(cases: list[str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + " END"


_DISCOVERED = _kinds([
    "'http://' || (k % 256)::VARCHAR || '.' || (k // 256 % 256)::VARCHAR || '.' || (k % 7)::VARCHAR || '.9/'",
    "'HTTPS://H' || (k % 900)::VARCHAR || '.Example.COM:443/Files/'",
    "'http://h' || (k % 900)::VARCHAR || '.example.com/Files'",
    "'http://' || k::VARCHAR || '/'",
    "'http://0x' || lower(to_hex(k)) || '/a'",
    "'http://agency' || (k % 7)::VARCHAR || '.gov./x'",
    "'h' || (k % 7)::VARCHAR || '.example.com/none'",
    "'http://u@h' || k::VARCHAR || '.internal:8080/'",
    "'http://_srv' || (k % 50)::VARCHAR || '.example.org:8080/p?q=' || (k % 7)::VARCHAR || '#f'",
    "'http://[2001:db8::' || (k % 7)::VARCHAR || ']:8080/'",
    "'http://[2606:4700::' || (k % 7)::VARCHAR || ']:8080/'",
    "'http://172.' || (k % 40)::VARCHAR || '.0.1./'",
], "k % 12")

# the generic splitting of a URL, by one pattern for each part
_PARTS = r"""
    regexp_extract(full_url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1) AS scheme0,
    regexp_extract(full_url, '://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)', 1) AS host0,
    regexp_extract(full_url, '://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^:/?#]*):([0-9]+)(?:[/?#]|$)', 1) AS port0,
    regexp_extract(full_url, '://[^/?#]*([^?#]*)', 1) AS path0,
    regexp_extract(full_url, '://[^?#]*(\?[^#]*)', 1) AS query0"""
_NETLOC = (
    "lower(host0) || CASE WHEN port0 = '' OR (lower(scheme0) = 'http' AND port0 = '80') "
    "OR (lower(scheme0) = 'https' AND port0 = '443') THEN '' ELSE ':' || port0 END"
)
_NORMAL = (
    f"lower(scheme0) || '://' || {_NETLOC} || CASE WHEN path0 = '' THEN '/' ELSE path0 END "
    "|| CASE WHEN query0 = '?' THEN '' ELSE query0 END"
)
_DEDUP = (
    f"{_NETLOC} || CASE WHEN rtrim(path0, '/') = '' THEN '/' ELSE rtrim(path0, '/') END "
    "|| CASE WHEN query0 = '?' THEN '' ELSE query0 END"
)
# which kinds of `discovered` are in scope, told from how each was made
_IN_SCOPE = """(k % 12 IN (1, 2, 8, 10)
    OR (k % 12 = 0 AND NOT (
        k % 256 IN (0, 8, 9, 10, 127) OR k % 256 >= 224
        OR (k % 256 = 172 AND (k // 256) % 256 BETWEEN 16 AND 31)
        OR (k % 256 = 192 AND (k // 256) % 256 = 168)
        OR (k % 256 = 192 AND (k // 256) % 256 = 0 AND k % 7 = 2)
        OR (k % 256 = 169 AND (k // 256) % 256 = 254)
        OR (k % 256 = 198 AND (k // 256) % 256 IN (18, 19))
    ))
    OR (k % 12 = 11 AND NOT k % 40 BETWEEN 16 AND 31))"""

TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    TITLE = f"replace({TITLE}, {q(_entity)}, {q(_char)})"
TITLE = f"trim({TITLE})"

_I = "unnest([0, 1, 2, 3, 4])"
_HUMAN = "(k % 900 + 1)::VARCHAR || '.' || i::VARCHAR"

PARTS = {
    "entries": f"""SELECT *, name LIKE '%/' AS is_dir,
        CASE WHEN name LIKE '%/' OR l_linenumber % 5 = 0 THEN NULL
             ELSE CAST(floor(l_extendedprice * l_quantity * 40) AS BIGINT) END AS size,
        strftime(l_shipdate, '%Y-%m-%dT%H:%M') AS mtime,
        row_number() OVER (PARTITION BY snapshot_id ORDER BY {LINE}) AS pos
        FROM (SELECT l_orderkey AS snapshot_id, {LINE}, {_list(NAMES)}[CAST(l_orderkey % 8 % 4 * 20 +
            CASE WHEN l_orderkey % 8 < 4 THEN l_partkey % 20 ELSE l_partkey % 7 END + 1 AS INT)] AS name
            FROM lineitem)""",
    "snaps": """SELECT o_orderkey AS snapshot_id, o_custkey AS candidate_id, o_orderdate AS fetched_at,
        o_orderpriority <> '5-LOW' AS is_open_dir, CASE WHEN o_orderstatus = 'P' THEN 404 ELSE 200 END AS http_status,
        sha256(CASE WHEN o_custkey % 400 % 7 = 0 THEN 'h' || (o_custkey % 400)::VARCHAR
               ELSE 's' || o_orderkey::VARCHAR END) AS raw_html_sha256,
        ['apache', 'nginx', 'python', 'unknown'][CAST(o_orderkey % 4 + 1 AS INT)] AS server_kind FROM orders""",
    "cands": f"""SELECT c_custkey AS candidate_id, {URL.format(c='c_custkey')} AS url,
        'h' || (c_custkey % 400)::VARCHAR || '.example' AS host, (c_custkey // 400 + 8000)::INT AS port,
        CASE WHEN c_custkey % 3 = 0 THEN '203.0.113.' || (c_custkey % 200)::VARCHAR END AS ip,
        {_list(ORGS)}[c_nationkey + 1] AS org, CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS country,
        TIMESTAMP '2024-01-01' + to_minutes(c_custkey::BIGINT) AS first_seen,
        CASE WHEN c_custkey % 10 = 0 THEN 'pending' WHEN c_custkey % 10 = 1 THEN 'error' ELSE 'captured' END AS status
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "prof": f"""SELECT snapshot_id, count(*) AS entry_count, count(*) FILTER (NOT is_dir) AS file_count,
        count(*) FILTER (is_dir) AS dir_count,
        count(*) FILTER (NOT is_dir AND {EXT} IN {_in(P.MIRROR_EXTS)}) AS mirror_files,
        count(size) FILTER (NOT is_dir) AS known_sizes,
        coalesce(sum(size) FILTER (NOT is_dir), 0)::BIGINT AS total_bytes,
        count(*) FILTER (NOT is_dir AND size >= {P.BIG_FILE_BYTES}) AS over,
        count(*) FILTER (NOT is_dir AND (size IS NOT NULL OR mtime <> '')) > 0 AS has_meta,
        max(struct_pack(size := size, name := name)) FILTER (NOT is_dir AND size IS NOT NULL) AS largest,
        {', '.join(f"count(*) FILTER ({'NOT is_dir AND ' if f == 'b' else ''}{_match(p)}) AS {f}_{c}"
                   for f, c, p in _ALL_HITS)}
        FROM entries GROUP BY snapshot_id""",
    "feats": f"""SELECT s.*, {', '.join(f'coalesce({n}, 0)::BIGINT AS {n}' for n in _NUMBERS)},
        coalesce(has_meta, false) AS has_meta,
        {', '.join(f'coalesce({f}_{c}, 0)::BIGINT AS {f}_{c}' for f, c, _ in _ALL_HITS)},
        coalesce(mirror_files, 0)::DOUBLE / greatest(coalesce(file_count, 0), 1) AS mirror_ratio
        FROM snaps s LEFT JOIN prof USING (snapshot_id)""",
    "judged": f"""SELECT *,
        {_rules(*[q(x) for x in ('malicious_staging', 'sensitive_exposure', 'sensitive_exposure',
                                 'intentional_public', 'benign_index')])} AS label,
        {_rules(_confidence(_sum('p', P.MALICIOUS_CATEGORIES)), _confidence(_sum('s', P.SENSITIVE)),
                '0.5::DOUBLE', '0.7::DOUBLE', '0.5::DOUBLE')} AS confidence,
        {_rules(_reasons('p', P.MALICIOUS_CATEGORIES), _reasons('s', P.TRIGGER_CATEGORIES),
                q(P.REASON_WEAK), q(P.REASON_MIRROR), q(P.REASON_BENIGN))} AS reasons
        FROM feats""",
    "cls": """SELECT * REPLACE (label AS label), label AS judged_label, '1.1.0' AS ruleset_version,
            fetched_at + INTERVAL 1 DAY AS classified_at FROM judged WHERE is_open_dir AND snapshot_id % 9 <> 4
        UNION ALL SELECT * REPLACE ('unknown' AS label), label AS judged_label, '1.0.0' AS ruleset_version,
            fetched_at + INTERVAL 2 DAY AS classified_at FROM judged WHERE is_open_dir AND snapshot_id % 7 = 3""",
    "hashes": f"""SELECT e.*, {URL.format(c='o_custkey')} || name AS url,
        'h' || (o_custkey % 400)::VARCHAR || '.example' AS host,
        CASE WHEN snapshot_id % 10 = 2 THEN '' ELSE sha256(name || snapshot_id::VARCHAR) END AS sha256,
        CASE WHEN snapshot_id % 10 = 2 THEN 'too_large' ELSE '' END AS error,
        snapshot_id % 3 <> 0 AS has_vt,
        CASE WHEN snapshot_id % 3 <> 0 THEN snapshot_id % 4 <> 0 END AS found,
        CASE WHEN snapshot_id % 3 <> 0 THEN CASE WHEN snapshot_id % 30 = 1 THEN 3 ELSE 0 END END AS malicious
        FROM entries e JOIN orders ON o_orderkey = snapshot_id
        WHERE NOT is_dir AND {PAYLOAD}""",
    "latest": """SELECT * EXCLUDE (rn) FROM (SELECT *,
        row_number() OVER (PARTITION BY candidate_id ORDER BY fetched_at DESC, snapshot_id DESC) AS rn,
        first_value(fetched_at) OVER (PARTITION BY candidate_id ORDER BY fetched_at, snapshot_id) AS first_open_at,
        first_value(snapshot_id) OVER (PARTITION BY candidate_id ORDER BY fetched_at, snapshot_id) AS first_open_id
        FROM snaps WHERE is_open_dir) WHERE rn = 1""",
    "newest": """SELECT l.*, c.* EXCLUDE (snapshot_id, candidate_id, fetched_at, is_open_dir, http_status,
            raw_html_sha256, server_kind)
        FROM latest l JOIN (SELECT *, row_number() OVER (PARTITION BY snapshot_id
            ORDER BY classified_at DESC, ruleset_version DESC) AS rn FROM cls) c USING (snapshot_id) WHERE rn = 1""",
    "newest_current": """SELECT l.*, c.label FROM latest l JOIN (SELECT *, row_number() OVER (
        PARTITION BY snapshot_id ORDER BY classified_at DESC) AS rn FROM cls WHERE ruleset_version = '1.1.0') c
        USING (snapshot_id) WHERE rn = 1""",
    "recs": "SELECT n.*, host, port, url FROM newest n JOIN cands USING (candidate_id)",
    "hosted": "SELECT s.*, host, port, url FROM snaps s JOIN cands USING (candidate_id)",
    "hsig": f"""SELECT host, min(list_position({_list(P.LABELS)}, label)) AS sev, count(DISTINCT port) AS ports,
        {', '.join(f'bool_or({col} > 0) AS sig_{c}' for c, col in SIGNALS.items())} FROM recs GROUP BY host""",
    "newhash": """SELECT host, name, sha256, malicious FROM (SELECT *, row_number() OVER (PARTITION BY host, name
        ORDER BY snapshot_id DESC, pos DESC) AS rn FROM hashes WHERE sha256 <> '') WHERE rn = 1""",
    "files": f"""SELECT *, {_rank('malicious')} AS rank, {PAYLOAD} AS program,
        {PAYLOAD} AND (({WEBSHELL}) OR coalesce(malicious, 0) > 0) AS alarm
        FROM (SELECT e.snapshot_id, e.pos, e.name, e.size, e.mtime, r.host, r.first_open_at, r.first_open_id, r.label,
            h.sha256, h.malicious FROM entries e JOIN recs r USING (snapshot_id)
            LEFT JOIN newhash h ON h.host = r.host AND h.name = e.name WHERE NOT is_dir)""",
    "top": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank, coalesce(size, 0) DESC,
        first_open_at, first_open_id, pos)::INT AS place FROM files) WHERE place <= 12""",
    "fan": """SELECT host, coalesce(max(n) FILTER (raw_html_sha256 <> ''), 1) AS fanout FROM (
        SELECT host, raw_html_sha256, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY host""",
    "net": """SELECT * FROM (SELECT coalesce(nullif(ip, ''), host) AS ip, org,
        coalesce(nullif(country, ''), '?') AS country,
        row_number() OVER (PARTITION BY coalesce(nullif(ip, ''), host) ORDER BY first_open_at, first_open_id) AS rn
        FROM latest JOIN cands USING (candidate_id)) WHERE rn = 1""",
    "disc": f"SELECT *, url AS full_url FROM (SELECT o_orderkey AS k, {_DISCOVERED} AS url FROM orders)",
    "urls": f"""SELECT url, CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END AS full_url
        FROM (SELECT url FROM pages UNION ALL SELECT url FROM disc)""",
    "listed": f"""SELECT *, row_number() OVER (PARTITION BY k ORDER BY i)::INT - 1 AS pos, name LIKE '%/' AS is_dir
        FROM (SELECT *, {_list(NAMES)}[CAST((k * 7 + i * 13) % 80 + 1 AS INT)] AS name
        FROM (SELECT o_orderkey AS k, o_orderdate AS day, {_I} AS i FROM orders))""",
    "found": r"""SELECT page_id, u, (row_number() OVER (PARTITION BY page_id ORDER BY n))::INT - 1 AS pos, href, name
        FROM (SELECT -1 - page_id AS page_id, url AS u, generate_subscripts(a, 1) AS n,
            regexp_extract(unnest(a), 'href="([^"]*)"', 1) AS href,
            regexp_extract(unnest(a), '>([^<]*)</a>', 1) AS name
            FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html,
                '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<a [^>]*>[^<]*</a>') AS a FROM pages))
        WHERE href <> '' AND href[1] NOT IN ('?', '#')""",
}
# sub-queries each one reads
NEEDS = {
    "prof": ["entries"], "feats": ["snaps", "prof"], "judged": ["feats"], "cls": ["judged"],
    "hashes": ["entries"], "latest": ["snaps"], "newest": ["latest", "cls"], "newest_current": ["latest", "cls"],
    "recs": ["newest", "cands"], "hosted": ["snaps", "cands"], "hsig": ["recs"], "newhash": ["hashes"],
    "files": ["entries", "recs", "newhash"], "top": ["files"], "net": ["latest", "cands"], "urls": ["disc"],
}


def sql(needs: str, body: str, **extra: str) -> str:
    """A query with the sub-queries it needs, in order of use."""
    order: list[str] = []

    def add(name):
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    parts = [f"{n} AS ({PARTS[n]})" for n in order] + [f"{n} AS ({text})" for n, text in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def _network(org: str) -> tuple[str, str]:
    text = f"lower({org})"
    cat = f"CASE WHEN {org} IS NULL OR {org} = '' THEN 'unknown' "
    prov = f"CASE WHEN {org} IS NULL OR {org} = '' THEN 'Unknown' "
    for pattern, category, provider in P.PROVIDERS:
        cat += f"WHEN {_match([pattern], text)} THEN {q(category)} "
        prov += f"WHEN {_match([pattern], text)} THEN {q(provider)} "
    for category, pattern in P.NETWORK_KEYWORDS:
        cat += f"WHEN {_match([pattern], text)} THEN {q(category)} "
    return cat + "ELSE 'business' END", prov + f"ELSE {org} END"


CATEGORY, PROVIDER = _network("trim(org)")
DAY = "strftime({0}, '%Y-%m-%d') AS {0}"
HOST_BREAKDOWN = f"""SELECT {{verdict}} AS verdict, {_flagged_names('sig_', P.SIGNAL_LABELS)} AS signals,
    greatest(ports, 1) AS ports FROM hsig"""
BAIT_LIST = {c: c for c in sorted(P.BAIT)}
BAIT_AGG = f"""SELECT host, {', '.join(f'bool_or({_match(p)}) AS bait_{c}' for c, p in P.BAIT.items())}
    FROM entries JOIN {{src}} USING (snapshot_id) WHERE NOT is_dir GROUP BY host"""
BAIT_N = "(" + " + ".join(f"coalesce(bait_{c}, false)::INT" for c in P.BAIT) + ")"
HONEYPOT_REASONS = f"""concat_ws('|',
    CASE WHEN {BAIT_N} >= {P.MIN_BAIT} THEN 'curated bait — ' || {BAIT_N}::VARCHAR || ' high-value file types (' ||
        {_flagged_names('bait_', BAIT_LIST, ', ')} || ')' END,
    CASE WHEN fanout >= {P.MIN_FANOUT} THEN 'identical listing on ' || fanout::VARCHAR || ' ports (scanner fan-out)' END)"""
PREVALENCE = " UNION ALL ".join(
    f"SELECT '{fam}' AS family, {q(c)} AS category, count(*) FILTER ({f}_{c} > 0) AS dirs FROM newest"
    for f, fam in (("s", "sensitive"), ("p", "payload")) for c in FAMILIES[f]
)
SIGS = f"""SELECT * FROM ({PREVALENCE}) WHERE dirs > 0"""
SHARES = "SELECT label, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM newest_current GROUP BY label"
INVENTORY_FILES = """SELECT host, array_to_string(list(CASE WHEN program THEN name ELSE dext END ORDER BY place), '|') AS files,
    array_to_string(list(coalesce(size::VARCHAR, '-') ORDER BY place), '|') AS sizes, count(*) AS shown
    FROM (SELECT *, CASE WHEN ext0 = '' THEN '(no ext)' ELSE ext0 END AS dext
          FROM (SELECT *, {ext} AS ext0 FROM top)) GROUP BY host""".format(ext=LAST_EXT)
HOST_FLAGGED = "SELECT host FROM recs WHERE label IN ('malicious_staging', 'sensitive_exposure')"
HOST_TOTALS = f"""SELECT host, min(list_position({_list(P.LABELS)}, label)) AS sev, sum(file_count)::BIGINT AS total,
    bool_or(has_meta) AS has_meta, {', '.join(f'bool_or(b_{c} > 0) AS bait_{c}' for c in P.BAIT)}
    FROM recs GROUP BY host"""
SIZE_STATS = f"""snapshot_id, known_sizes > 0 AS has_sizes, file_count, total_bytes,
    coalesce(largest.size, 0) AS largest_bytes, coalesce(largest.name, '') AS largest_name, over AS files_over_100mb"""
DISCLOSED = f"""SELECT snapshot_id, {_rank('hm')} AS rank, CASE WHEN {PAYLOAD} THEN 'exec' ELSE 'data' END AS kind,
    {{name}} AS name, CASE WHEN NOT {PAYLOAD} AND ({LAST_EXT}) = '' THEN '(no ext)' ELSE {LAST_EXT} END AS ext, size, mtime,
    CASE WHEN {PAYLOAD} THEN ({WEBSHELL}) OR coalesce(hm, 0) > 0 END AS alarm,
    CASE WHEN {PAYLOAD} AND snapshot_id % 2 = 0 THEN sha256(name) END AS sha256, NULL::VARCHAR AS tlsh,
    CASE WHEN {PAYLOAD} THEN hm END AS malicious
    FROM (SELECT *, CASE WHEN snapshot_id % 2 = 0 THEN CASE WHEN snapshot_id % 30 = 1 THEN 1 ELSE 0 END END::BIGINT AS hm
          FROM entries WHERE NOT is_dir)"""
CAPTURES = f"""SELECT o_orderkey AS snapshot_id, o_custkey AS candidate_id, o_orderkey % 12 AS kind,
    o_custkey IN (SELECT c_custkey FROM customer) AS known FROM orders"""
OUTCOME = """CASE WHEN kind = 2 THEN 'malformed' WHEN NOT known OR kind IN (4, 6) THEN 'unmatched'
    WHEN kind = 9 THEN 'mistyped' WHEN kind = 5 THEN 'error' WHEN kind = 3 THEN 'malformed' ELSE 'ok' END"""
NEW_HEADERS = _kinds([
    "['server', 'date']", "['Date', 'Server']", "['content-type', 'server', 'Date']", "['date']", "['server', 'server']",
], "o_orderkey % 5")
SELECTED = f"""SELECT e.snapshot_id, e.name, h.url || e.name AS url, e.pos,
    row_number() OVER (PARTITION BY e.snapshot_id ORDER BY e.pos) AS place
    FROM entries e JOIN hosted h USING (snapshot_id) WHERE NOT is_dir AND {PAYLOAD}"""


def _layout(cases: list[str]) -> str:
    return _kinds(cases, "k % 4")


def rendered_pages() -> str:
    """The rendered listings and the given pages, as in ``all_pages``."""
    name = f"{_list(NAMES)}[CAST((k * 7 + i * 13) % 80 + 1 AS INT)]"
    anchor = "'<a href=\"' || name || '\">' || name || '</a>'"
    size = "CASE WHEN name LIKE '%/' THEN '-' ELSE x END"
    lines = {
        0: "'<tr><td valign=\"top\">' || a || '</td><td>x</td><td>x</td></tr>'", 1: "a || ' x x'", 2: "'<li>' || a || '</li>'",
        3: "'<img src=\"/icons/unknown.gif\" alt=\"[   ]\"> ' || a || ' x'",
    }
    whole = {
        0: "'<table><tr><th>Name</th><th>Size</th></tr>' || chr(10) || '<tr><td><a href=\"/\">Parent Directory</a></td></tr>' || rows || '</table>'",
        1: "'<hr><pre><a href=\"../\">../</a>' || rows || '</pre>'", 2: "'<hr><ul>' || rows || '</ul>'",
        3: "'<pre><a href=\"?C=N;O=D\">Name</a> <a href=\"?C=S;O=A\">Size</a><hr><img src=\"/icons/back.gif\"> <a href=\"/\">Parent Directory</a>' || rows || '</pre>'",
    }
    del size
    case = lambda cases: "CASE k % 4 " + " ".join(f"WHEN {i} THEN {c}" for i, c in cases.items()) + " END"
    return f"""SELECT k AS page_id, '<html><head><title>x</title></head><body><h1>x</h1>' || {case(whole)} || '</body></html>' AS html
      FROM (SELECT k, string_agg({case(lines)}, '' ORDER BY i) AS rows FROM (
        SELECT k, i, {anchor} AS a FROM (SELECT k, i, {name} AS name FROM (SELECT o_orderkey AS k, {_I} AS i FROM orders)))
        GROUP BY k)
      UNION ALL SELECT -1 - page_id, html FROM pages"""


#: Queries that also run without their limit.
UNCAPPED = {
    "classify_pending": "LIMIT 200", "pending_queue": "LIMIT 50", "recapture_queue": "LIMIT 50", "hash_pending": "LIMIT 50",
    "vt_pending": "LIMIT 100", "select_payloads": "WHERE place <= 2",
}


def _uncapped(queries: dict[str, str]) -> dict[str, str]:
    out = {}
    for name, limit in UNCAPPED.items():
        assert queries[name].count(limit) == 1, name
        out[f"{name}_all"] = queries[name].replace(limit, "")
    return out


#: The stack of open elements of each distinct sequence of tags, folded tag by tag.
_TOP = "s[len(s)]"
TEMPLATES = r"""
WITH RECURSIVE pages_all AS (
  {pages}
), tags AS (
  SELECT page_id, list_filter(list_transform(
      regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)|</?[a-zA-Z][^\s/>]*(?:[^>"'']|"[^"]*"|''[^'']*'')*(?:>|\z)'),
      lambda t: regexp_extract(t, '^(</?)', 1) || lower(regexp_extract(t, '^</?([a-zA-Z][^\s/>]*)', 1))),
    lambda t: t NOT IN ('', '<', '</', '<html', '</html')) AS tags
  FROM pages_all
), kinds AS (
  SELECT row_number() OVER () AS kind, tags FROM (SELECT DISTINCT tags FROM tags)
), steps AS (
  SELECT kind, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i, len(tags) AS n FROM kinds
), fold(kind, i, stack, raw, path) AS (
  SELECT kind, 0::BIGINT, ['html'], '', ''::VARCHAR FROM kinds
  UNION ALL
  SELECT kind, i, CASE WHEN skipped OR closing THEN s WHEN tag IN ('head', 'body') THEN ['html', tag]
           WHEN tag IN {void} THEN s ELSE list_append(s, tag) END,
         CASE WHEN skipped THEN raw WHEN NOT closing AND tag IN {raw} THEN tag ELSE '' END,
         CASE WHEN skipped OR closing OR tag IN ('head', 'body') THEN ''
              ELSE CASE WHEN tag = 'tr' AND {top} = 'tbody' THEN array_to_string(s, '/') || chr(10) ELSE '' END
                   || array_to_string(s, '/') || '/' || tag END
  FROM (
    SELECT kind, i, tag, closing, skipped, raw,
           CASE WHEN NOT skipped AND NOT closing AND tag = 'tr' AND {top} = 'table' THEN list_append(s, 'tbody') ELSE s END AS s
    FROM (
      SELECT kind, i, tag, closing, skipped, raw,
             CASE WHEN skipped THEN s
                  WHEN closing THEN CASE WHEN list_contains(s, tag) THEN s[1:len(s) - list_position(list_reverse(s), tag)] ELSE s END
                  WHEN tag IN ('head', 'body') THEN s
                  WHEN tag = 'a' AND list_contains(s, 'a') THEN s[1:len(s) - list_position(list_reverse(s), 'a')]
                  WHEN tag IN ('li', 'tr', 'td', 'th') AND {top} IN ('li', 'td', 'th')
                    THEN CASE WHEN tag = 'tr' AND s[len(s) - 1] = 'tr' THEN s[1:len(s) - 2] ELSE s[1:len(s) - 1] END
                  ELSE s END AS s
      FROM (
        SELECT f.kind, f.i + 1 AS i, ltrim(t.tag, '</') AS tag, t.tag LIKE '</%' AS closing, f.raw,
               f.raw <> '' AND t.tag <> '</' || f.raw AS skipped,
               CASE WHEN f.raw <> '' OR t.tag LIKE '</%' OR t.tag IN ('<head', '<body') THEN f.stack
                    WHEN len(f.stack) = 1 THEN CASE WHEN ltrim(t.tag, '<') IN {head} THEN ['html', 'head'] ELSE ['html', 'body'] END
                    WHEN f.stack = ['html', 'head'] AND ltrim(t.tag, '<') NOT IN {head} THEN ['html', 'body']
                    ELSE f.stack END AS s
        FROM fold f JOIN steps t ON t.kind = f.kind AND t.i = f.i + 1)))
), paths AS (
  SELECT kind, list_sort(list_distinct(list_concat(['html', 'html/head', 'html/body'],
    coalesce(flatten(list(string_split(path, chr(10))) FILTER (path <> '')), []::VARCHAR[])))) AS paths
  FROM fold GROUP BY kind
)
SELECT page_id, min(page_id) OVER (PARTITION BY sha256(array_to_string(paths, chr(10)))) AS first_page
FROM tags JOIN kinds USING (tags) JOIN paths USING (kind)
"""


_BATCH = "CASE WHEN fetched_at < '1994-01-01' THEN 'a' WHEN fetched_at < '1997-01-01' THEN 'b' ELSE 'c' END"
_VALUES = """SELECT DISTINCT host, kind, value FROM (
    SELECT 'h' || o_custkey::VARCHAR AS host, unnest(['favicon_sha256', 'header_order_sha256', 'raw_html_sha256']) AS kind, unnest([
        CASE WHEN o_orderkey % 5 < 3 THEN sha256('f' || (o_custkey // 3)::VARCHAR) ELSE '' END,
        CASE WHEN o_orderkey % 7 < 5 AND o_custkey // 3 % 30 BETWEEN 12 AND 25 THEN sha256('o' || ((o_custkey + 1) // 2)::VARCHAR) END,
        CASE WHEN o_orderkey % 3 = 0 AND o_custkey // 3 % 30 < 10 THEN sha256('hub') ELSE sha256('s' || o_orderkey::VARCHAR) END]) AS value
    FROM orders) WHERE value <> ''"""
_CLUSTERED = f"""WITH RECURSIVE v AS ({_VALUES}), e AS (
    SELECT DISTINCT host AS a, min(host) OVER (PARTITION BY kind, value) AS b FROM v
), sides AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT DISTINCT host, host AS other FROM v UNION SELECT reach.host, sides.b FROM reach JOIN sides ON sides.a = reach.other),
c AS (SELECT host, cluster, count(*) OVER (PARTITION BY cluster) AS n_hosts FROM (SELECT host, min(other) AS cluster FROM reach GROUP BY host))"""
#: Two results per payload file in the order of arrival.
_LOADED = """SELECT row_number() OVER (ORDER BY go, snapshot_id * 7919 % 1000, snapshot_id, name) AS hash_id, *,
    CASE WHEN failed THEN '' ELSE sha256(name || snapshot_id::VARCHAR || go::VARCHAR) END AS sha,
    CASE WHEN failed THEN 0 ELSE length(url) END::BIGINT AS bytes, CASE WHEN failed THEN 'http 404' ELSE '' END AS failure
    FROM (SELECT *, go = 2 AND snapshot_id % 4 = 1 AS failed FROM (
        SELECT snapshot_id, name, url, host, unnest([1, 2]) AS go FROM (SELECT DISTINCT snapshot_id, name, url, host FROM hashes)))"""
_TOP_EXTS = f"""SELECT snapshot_id, ext, n, place FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY n DESC, ext) AS place
    FROM (SELECT snapshot_id, {EXT} AS ext, count(*) AS n FROM entries WHERE NOT is_dir GROUP BY ALL) WHERE ext <> '') WHERE place <= 10"""


def _added(unpivot) -> dict[str, str]:
    """Clusters, batches, arrival, stored extensions, the report as rows, indexed search, rejects."""
    hits = " UNION ALL ".join(
        f"SELECT '{section}' AS section, category AS key, count(*) AS value FROM ({unpivot(f, src)}) WHERE {where} GROUP BY category"
        for section, f, src, where in (
            ("sensitive", "s", "newest", "true"), ("payload", "p", "newest", "true"),
            ("interest", "i", "prof", "snapshot_id IN (SELECT snapshot_id FROM latest)"))
    )
    volume = "SELECT known_sizes, total_bytes, over FROM prof WHERE known_sizes > 0 AND snapshot_id IN (SELECT snapshot_id FROM latest)"
    kinds = "(SELECT s_suppkey % 6 AS k, count(*) AS n FROM supplier GROUP BY 1)"
    outcomes = {  # by kind of line: what each source makes of it
        "host_search": {0: "unreadable", 1: "no_matches", 2: "unreadable", 3: "mistyped", 4: "mistyped", 5: "unreadable"},
        "host_services": {0: "unreadable", 1: "no_services", 3: "mistyped", 4: "no_services", 5: "unreadable"},
        "reputation": {0: "unreadable", 1: "no_key", 3: "mistyped", 4: "no_key", 5: "unreadable"},
    }
    lines = " UNION ALL ".join(
        f"SELECT '{source}' AS source, '{outcome}' AS outcome, n * {2 if (source, k) == ('host_search', 4) else 1} AS n FROM {kinds} WHERE k = {k}"
        for source, table in outcomes.items() for k, outcome in table.items()
    )
    per_customer = " UNION ALL ".join(
        f"SELECT '{source}', '{outcome}', count(*){times} FROM customer WHERE {where}" for source, outcome, times, where in (
            ("host_search", "ok", "", "c_custkey % 6 <> 4"), ("host_search", "no_address", "", "true"), ("host_search", "no_address", "", "c_custkey % 6 = 4"),
            ("host_services", "ok", " * 2", "true"), ("host_services", "other_service", "", "true"), ("host_services", "no_port", "", "true"))
    )
    return {
        "host_clusters": _CLUSTERED + " SELECT * FROM c",
        "cluster_profiles": _CLUSTERED + """, p AS (
            SELECT cluster, kind, value, count(*) AS hosts FROM v JOIN c USING (host) WHERE n_hosts > 1 GROUP BY ALL
        ), w AS (SELECT *, row_number() OVER (PARTITION BY cluster, kind ORDER BY hosts DESC, value) AS place FROM p)
        SELECT cluster, kind, n_hosts, count(*) AS n_values, count(*) FILTER (hosts > 1) AS n_shared,
            min(value) FILTER (place = 1) AS widest, max(hosts) AS widest_hosts
        FROM w JOIN (SELECT cluster, kind, count(DISTINCT host) AS n_hosts FROM v JOIN (SELECT host, cluster FROM c) USING (host) GROUP BY ALL)
            USING (cluster, kind) GROUP BY ALL""",
        "append_twice": sql("snaps", f"SELECT {_BATCH} AS batch, snapshot_id, candidate_id, server_kind, http_status FROM snaps"),
        "append_manifest": sql("snaps", f"""SELECT 'ab' AS batch, 1 AS version, count(*) FILTER ({_BATCH} <> 'c') AS n FROM snaps
            UNION ALL SELECT 'c', 1, count(*) FILTER ({_BATCH} = 'c') FROM snaps UNION ALL SELECT 'a', 2, 0 UNION ALL SELECT 'b', 3, 0"""),
        "latest_open_merged": sql("latest", f"""SELECT candidate_id, snapshot_id, {DAY.format('fetched_at')}, {DAY.format('first_open_at')},
            first_open_id, server_kind FROM latest"""),
        "pending_merged": sql("snaps", f"SELECT snapshot_id, {DAY.format('fetched_at')} FROM snaps WHERE is_open_dir AND snapshot_id % 9 = 4"),
        "load_hashes_in_order": sql("hashes", "SELECT hash_id, snapshot_id, name, sha AS sha256, bytes AS size, failure AS error FROM loaded", loaded=_LOADED),
        "vt_pending_in_order": sql("hashes", "SELECT hash_id, snapshot_id, name, sha AS sha256 FROM loaded WHERE sha <> '' ORDER BY hash_id LIMIT 100", loaded=_LOADED),
        "hash_join_loaded": sql("entries recs hashes", """SELECT e.snapshot_id, r.host, e.name, e.size, h.sha AS sha256 FROM entries e
            JOIN recs r USING (snapshot_id) LEFT JOIN (SELECT host, name, arg_max(sha, hash_id) AS sha FROM loaded WHERE sha <> '' GROUP BY ALL) h
            ON h.host = r.host AND h.name = e.name WHERE NOT is_dir""", loaded=_LOADED),
        "stored_exts": sql("cls entries", """SELECT snapshot_id, judged_label AS label, coalesce(listed, '') AS top_exts, '2.0.0' AS ruleset_version
            FROM cls LEFT JOIN (SELECT snapshot_id, string_agg(ext || '=' || n::VARCHAR, '|' ORDER BY place) AS listed FROM exts GROUP BY 1)
            USING (snapshot_id)""", exts=_TOP_EXTS),
        "report_tables": sql("snaps cands latest newest newest_current prof net entries", f"""SELECT section, key, value::BIGINT AS value FROM (
            SELECT 'corpus' AS section, 'candidates' AS key, count(*) AS value FROM cands
            UNION ALL SELECT 'corpus', status, count(*) FROM cands GROUP BY status
            UNION ALL SELECT 'corpus', 'open_dirs', count(*) FROM latest
            UNION ALL SELECT 'corpus', 'not_listing', count(DISTINCT candidate_id) FROM snaps WHERE http_status = 200 AND NOT is_open_dir
            UNION ALL SELECT 'server', server_kind, count(*) FROM latest GROUP BY server_kind
            UNION ALL SELECT 'label', label, count(*) FROM newest_current GROUP BY label
            UNION ALL {hits}
            UNION ALL SELECT 'volume', 'sized_dirs', count(*) FROM ({volume}) UNION ALL SELECT 'volume', 'total_bytes', sum(total_bytes) FROM ({volume})
            UNION ALL SELECT 'volume', 'files_over_100mb', sum(over) FROM ({volume})
            UNION ALL SELECT 'ext', ext, count(*) FROM exts WHERE snapshot_id IN (SELECT snapshot_id FROM newest) GROUP BY ext
            UNION ALL SELECT 'network', {CATEGORY}, count(*) FROM net GROUP BY ALL
            UNION ALL SELECT 'provider', CASE WHEN coalesce(trim(org), '') = '' THEN 'Unknown' ELSE {PROVIDER} END, count(*) FROM net GROUP BY ALL
            UNION ALL SELECT 'country', country, count(*) FROM net GROUP BY ALL) WHERE value > 0""", exts=_TOP_EXTS),
        "browse_indexed": sql("hosted", """SELECT snapshot_id, url, server_kind FROM hosted WHERE http_status = 200
            AND (contains(lower(url), 'h10') OR contains(lower(server_kind), 'h10'))"""),
        "search_documents": """SELECT doc_id, term FROM documents, (SELECT unnest(['license', 'Ung der', 'zz']) AS term)
            WHERE contains(lower(text), lower(term))""",
        "source_outcomes": f"""SELECT source, outcome, sum(n)::BIGINT AS n FROM ({lines} UNION ALL {per_customer}
            UNION ALL SELECT 'reputation', 'ok', count(*) FROM orders) GROUP BY ALL""",
    }


def oracle() -> dict[str, str]:
    hits = lambda f: ", ".join(f"{f}_{c} AS {c}" for c in FAMILIES[f])
    unpivot = lambda f, src: " UNION ALL ".join(
        f"SELECT snapshot_id, {q(c)} AS category, {f}_{c} AS n FROM {src} WHERE {f}_{c} > 0" for c in FAMILIES[f])
    top = lambda key, n: f"ORDER BY n DESC, {key} LIMIT {n}"
    out = {
        # sources
        "src_host_search": """SELECT CASE WHEN kind = 5 THEN 'https://[2606:4700::' || h || ']:8443/'
            WHEN kind = 0 THEN 'http://203.0.113.' || h || '/' WHEN kind = 1 THEN 'https://203.0.113.' || h || ':8443/'
            WHEN kind = 2 THEN 'https://203.0.113.' || h || '/' ELSE 'https://203.0.113.' || h || ':9000/' END AS url,
            'host_search' AS source, CASE WHEN kind = 5 THEN '2606:4700::' ELSE '203.0.113.' END || h AS ip,
            (CASE kind WHEN 0 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 9000 ELSE 8443 END)::INT AS port,
            'AS' || k::VARCHAR AS asn, 'Org ' || (k % 30)::VARCHAR AS org, 'a|h' || h AS hostnames, 'DE' AS country,
            'nginx' AS product FROM (SELECT c_custkey AS k, c_custkey % 6 AS kind, (c_custkey % 200)::VARCHAR AS h
            FROM customer) WHERE kind <> 4""",
        "src_host_services": """SELECT CASE WHEN n = 0 THEN 'http://' || h || '/'
            WHEN k % 2 = 0 THEN 'https://' || h || '/' ELSE 'https://' || h || ':8443/' END AS url,
            'host_services' AS source, ip, k::VARCHAR AS asn FROM (SELECT *, CASE WHEN contains(ip, ':')
            THEN '[' || ip || ']' ELSE ip END AS h FROM (SELECT c_custkey AS k, unnest([0, 1]) AS n,
            CASE WHEN c_custkey % 5 = 0 THEN '2606:4700::' || (c_custkey % 90)::VARCHAR
            ELSE '198.51.100.' || (c_custkey % 250)::VARCHAR END AS ip FROM customer))""",
        "ingest_captures": f"""SELECT snapshot_id, candidate_id, CASE WHEN ok THEN 200 END AS http_status,
            CASE WHEN ok THEN 'http://final/' ELSE 'http://f/' END AS final_url, CASE WHEN ok THEN 'nginx' END AS server_kind,
            CASE WHEN ok THEN 'Index of /' END AS title, CASE WHEN ok THEN true END AS is_open_dir,
            CASE WHEN ok THEN CASE WHEN kind = 11 THEN 3 ELSE 1 END::BIGINT END AS entry_count, CASE WHEN ok THEN '' ELSE 'timeout' END AS error,
            CASE WHEN ok THEN 'cc' END AS template_sha256, NULL::VARCHAR AS favicon_sha256,
            CASE WHEN ok THEN 'server=nginx|date=x' END AS headers, CASE WHEN ok THEN 'a.zip:a.zip:false:5:/a.zip'
                || CASE WHEN kind = 11 THEN '|unter/:unter/:true:-:/unter/|ä b.csv:%C3%A4%20b.csv:false:0:/ä b.csv' ELSE '' END END AS entries
            FROM (SELECT *, outcome = 'ok' AS ok FROM (SELECT *, {OUTCOME} AS outcome FROM ({CAPTURES}) WHERE kind NOT IN (1, 8)))
            WHERE outcome IN ('ok', 'error')""",
        "ingest_stats": f"SELECT {OUTCOME} AS outcome, count(*) AS n FROM ({CAPTURES}) WHERE kind NOT IN (1, 8) GROUP BY 1",
        "pages_to_snapshots": sql("found", rf"""SELECT page_id, url AS final_url,
            {TITLE} AS title,
            coalesce(n, 0) AS entry_count, sha256(html) AS raw_html_sha256,
            regexp_matches({TITLE}, '(?i)^(index of |directory listing for )')
            OR regexp_matches(html, '(?i)<h1[^>]*>\s*(index of |directory listing for )') AS is_open_dir,
            CASE WHEN contains(lower(html), 'directory listing for') THEN 'python'
                 WHEN contains(lower(html), 'index of') THEN CASE WHEN contains(lower(html), '<pre') THEN 'nginx' ELSE 'apache' END
                 ELSE 'unknown' END AS server_kind
            FROM pages LEFT JOIN (SELECT -1 - page_id AS page_id, count(*) AS n FROM found GROUP BY page_id) USING (page_id)"""),
        "src_reputation": """SELECT sha256(k::VARCHAR) AS sha256, k % 5 IN (0, 1) AS found,
            (CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 END)::BIGINT AS malicious,
            (CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 END)::BIGINT AS suspicious,
            (CASE k % 5 WHEN 0 THEN 1 + k % 60 WHEN 1 THEN 0 END)::BIGINT AS total,
            CASE k % 5 WHEN 0 THEN 'Win32 EXE' WHEN 1 THEN '' END AS type,
            CASE k % 5 WHEN 0 THEN 'n' || k::VARCHAR WHEN 1 THEN '' END AS name,
            CASE k % 5 WHEN 3 THEN 'vt 500' WHEN 4 THEN 'unreadable report' END AS error
            FROM (SELECT o_orderkey AS k FROM orders)""",
        "hash_payload_files": """SELECT 'file:/landed/' || doc_id::VARCHAR || '/' || name AS url, name,
            sha256(text) AS sha256, md5(text) AS md5, strlen(text)::BIGINT AS size, '' AS error
            FROM (SELECT *, ['run.EXE', 'a.sh', 'notes.txt', 'web_shell.php', 'index.php', 'x.bin'][CAST(doc_id % 6 + 1 AS INT)] AS name
                  FROM documents) WHERE doc_id % 6 IN (0, 1, 3, 5)""",
        # candidates
        "normalize_urls": sql("urls", f"SELECT url, {_NORMAL} AS normalized_url FROM (SELECT url, full_url, {_PARTS} FROM urls)"),
        "dedup_keys": sql("urls", f"SELECT url, {_DEDUP} AS dedup_key FROM (SELECT url, full_url, {_PARTS} FROM urls)"),
        "host_port": sql("urls", f"""SELECT url, CASE WHEN contains(url, '://') THEN nullif(lower(trim(host0, '[]')), '') END AS host,
            CASE WHEN contains(url, '://') THEN TRY_CAST(nullif(port0, '') AS INT) END AS port
            FROM (SELECT url, full_url, {_PARTS} FROM urls)"""),
        "scope_filter": sql("disc", f"SELECT k AS input_order, url FROM disc WHERE {_IN_SCOPE}"),
        "ingest_candidates": sql("disc", f"""SELECT dedup_key, norm AS url,
            CASE WHEN k % 2 = 0 THEN 'host_search' ELSE 'host_services' END AS source, k::VARCHAR AS seed, 'pending' AS status
            FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY k) AS rn
                  FROM (SELECT k, {_DEDUP} AS dedup_key, {_NORMAL} AS norm FROM (SELECT *, {_PARTS} FROM disc)
                        WHERE {_IN_SCOPE.replace('(8, 9,', '(').replace('0, 8, 9, 10', '0, 10')}))
            WHERE rn = 1 AND dedup_key NOT IN (SELECT {_DEDUP} FROM (SELECT *, {_PARTS} FROM disc) WHERE k % 36 = 1)"""),
        # listings
        "extract_entries": sql("listed found", """SELECT k AS page_id, pos, name, name AS href, is_dir FROM listed
            UNION ALL SELECT page_id, pos, trim(name), href, href LIKE '%/' FROM found"""),
        "entry_paths": sql("listed found", r"""SELECT k AS page_id, pos, '/d' || (k % 50)::VARCHAR || '/' || name AS path FROM listed
            UNION ALL SELECT page_id, pos, CASE WHEN href LIKE '/%' THEN regexp_extract(href, '^[^?#]*')
            ELSE regexp_extract(u, '://[^/]*([^?#]*/)', 1) || regexp_extract(href, '^[^?#]*') END FROM found"""),
        "entry_meta": sql("listed found", f"""SELECT k AS page_id, pos,
            CASE WHEN is_dir OR k % 4 = 2 THEN NULL WHEN k % 4 = 1 THEN (k * 37 + i * 1009) % 5000000
            ELSE CAST(round_even(({_HUMAN})::DOUBLE * 1024, 0) AS BIGINT) END AS size,
            CASE WHEN k % 4 <> 2 THEN strftime(day + to_hours(i), '%Y-%m-%dT%H:%M') END AS mtime FROM listed
            UNION ALL SELECT page_id, pos, NULL, NULL FROM found"""),
        "entry_size": r"""SELECT text, CAST(CASE line WHEN 0 THEN l_partkey WHEN 1 THEN round_even(number * 1024, 0)
            WHEN 2 THEN round_even(number * 1048576, 0) WHEN 3 THEN round_even(number * 1073741824, 0) END AS BIGINT) AS size
            FROM (SELECT *, d::DOUBLE AS number, CASE line WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN d || 'K' WHEN 2 THEN d || 'M'
                WHEN 3 THEN '  ' || d || ' GiB ' WHEN 4 THEN '-' WHEN 5 THEN d || '.1' ELSE d || ' items' END AS text
                FROM (SELECT l_partkey, l_linenumber % 7 AS line,
                    (l_partkey % 1000)::VARCHAR || '.' || (l_suppkey % 10)::VARCHAR AS d FROM lineitem))""",
        "entry_mtime": """SELECT CASE line WHEN 0 THEN strftime(day, '%d-%b-%Y %H:%M') WHEN 1 THEN strftime(day, '%Y-%m-%d %H:%M')
            WHEN 2 THEN strftime(day, '  %Y-%m-%d   %H:%M UTC') WHEN 3 THEN '-' ELSE 'day ' || l_linenumber::VARCHAR END AS text,
            CASE WHEN line < 3 THEN strftime(day, '%Y-%m-%dT%H:%M') WHEN line = 4 THEN 'day ' || l_linenumber::VARCHAR END AS mtime,
            line < 3 AS known FROM (SELECT l_linenumber, l_linenumber % 5 AS line,
            l_shipdate + to_minutes(l_linenumber::BIGINT) AS day FROM lineitem)""",
        "validate_listing": f"""SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 4 = 2 THEN 'Directory listing for '
            ELSE 'Index of ' END || '/d' || (o_orderkey % 50)::VARCHAR || '/' AS title, true AS is_open_dir FROM orders
            UNION ALL SELECT -1 - page_id, {TITLE},
            regexp_matches(html, '(?i)<(title|h1)[^>]*>(index of |directory listing for )') FROM pages""",
        "server_kind": f"""SELECT o_orderkey AS page_id, {_list(LAYOUTS)}[CAST(o_orderkey % 4 + 1 AS INT)] AS server_kind FROM orders
            UNION ALL SELECT -1 - page_id, CASE WHEN contains(lower(html), 'directory listing for') THEN 'python'
            WHEN contains(lower(html), 'index of') THEN 'apache' ELSE 'unknown' END FROM pages""",
        "server_banner": """SELECT o_orderkey AS snapshot_id, CASE o_orderkey % 5 WHEN 0 THEN 'v' || o_orderkey::VARCHAR || '-0'
            WHEN 2 THEN 'v' || o_orderkey::VARCHAR || '-1' WHEN 4 THEN 'v' || o_orderkey::VARCHAR || '-0' ELSE '' END
            AS server_banner FROM orders""",
        "fp_body": "SELECT page_id, sha256(html) AS raw_html_sha256 FROM pages",
        "fp_headers": f"""SELECT o_orderkey AS snapshot_id, sha256(lower(array_to_string({NEW_HEADERS}, ','))) AS header_order_sha256
            FROM orders""",
        "fp_favicon": """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 6 NOT IN (0, 1)
            THEN sha256(o_orderpriority) END AS favicon_sha256 FROM orders""",
        "tls_flags": """SELECT o_orderkey AS snapshot_id, 'CN=' || (o_custkey % 7)::VARCHAR AS issuer,
            'CN=' || (o_orderkey % 7)::VARCHAR AS subject, o_custkey % 7 = o_orderkey % 7 AS self_signed FROM orders""",
        # features and verdict
        "feature_counts": sql("feats", "SELECT snapshot_id, entry_count, file_count, dir_count FROM feats"),
        "sensitive_hits": sql("feats", f"SELECT snapshot_id, {hits('s')} FROM feats"),
        "payload_hits": sql("feats", f"SELECT snapshot_id, {hits('p')} FROM feats"),
        "top_exts": sql("entries", f"""SELECT snapshot_id, ext, n, place::INT AS place FROM (SELECT *, row_number() OVER (
            PARTITION BY snapshot_id ORDER BY n DESC, ext) AS place FROM (SELECT snapshot_id, {EXT} AS ext, count(*) AS n
            FROM entries WHERE NOT is_dir GROUP BY ALL) WHERE ext <> '') WHERE place <= 10"""),
        "mirror_ratio": sql("feats", "SELECT snapshot_id, mirror_files, mirror_ratio FROM feats"),
        "cert_flag": """SELECT o_orderkey AS snapshot_id, o_orderkey % 3 <> 0 AND o_custkey % 7 = o_orderkey % 7
            AS cert_self_signed FROM orders""",
        "classify": sql("judged", "SELECT snapshot_id, label, '1.1.0' AS extractor_version, '1.1.0' AS ruleset_version FROM judged"),
        "confidence": sql("judged", "SELECT snapshot_id, confidence FROM judged"),
        "reasons": sql("judged", "SELECT snapshot_id, reasons FROM judged"),
        "classify_pending": sql("judged", """SELECT snapshot_id, label, confidence, reasons, '1.1.0' AS ruleset_version
            FROM judged WHERE is_open_dir AND snapshot_id % 9 = 4 ORDER BY fetched_at, snapshot_id LIMIT 200"""),
        "label_distribution": sql("cls", "SELECT label, count(*) AS n FROM cls GROUP BY label"),
        "reclassify": sql("cls", "SELECT snapshot_id, judged_label AS label, confidence, '2.0.0' AS ruleset_version FROM cls"),
        # inventory, network
        "interest_counts": sql("prof", unpivot("i", "prof")),
        "interest_examples": sql("entries", f"""SELECT snapshot_id, category, array_to_string(list(name ORDER BY pos), '|') AS examples
            FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, category ORDER BY pos) AS place FROM (
            {' UNION ALL '.join(f"SELECT snapshot_id, pos, name, {q(c)} AS category FROM entries WHERE {_match(p)}"
                                for c, p in P.INTEREST.items())})) WHERE place <= 2 GROUP BY snapshot_id, category"""),
        "size_stats": sql("prof", f"SELECT {SIZE_STATS} FROM prof"),
        "inventory": sql("prof", f"SELECT {SIZE_STATS}, {hits('i')} FROM prof"),
        "network_profile": sql("cands", f"SELECT candidate_id, org, {CATEGORY} AS category, {PROVIDER} AS provider FROM cands"),
        "profile_breakdown": sql("cands", f"""SELECT 'category' AS kind, {CATEGORY} AS name, count(*) AS n FROM cands GROUP BY 2
            UNION ALL SELECT 'provider', {PROVIDER}, count(*) FROM cands GROUP BY 2"""),
        # hosts
        "host_signals": sql("hsig", f"SELECT host, {_flagged_names('sig_', P.SIGNAL_LABELS)} AS signals FROM hsig"),
        "host_breakdown": sql("hsig", HOST_BREAKDOWN.format(verdict="CASE WHEN sev = 1 THEN 'malicious' ELSE 'sensitive' END")
                              + f" WHERE sev <= 2 AND ({' OR '.join(f'sig_{c}' for c in SIGNALS)})"),
        "host_breakdown_all": sql("hsig", HOST_BREAKDOWN.format(
            verdict="['malicious', 'sensitive', 'intentional_public', 'benign_index'][coalesce(sev, 4)]")),
        "bait_categories": sql("entries hosted", f"SELECT host, {_flagged_names('bait_', BAIT_LIST)} AS bait FROM baits",
                               baits=BAIT_AGG.format(src="hosted")),
        "identical_fanout": sql("hosted", "SELECT * FROM fan", fan=PARTS["fan"].format(src="hosted")),
        "honeypot": sql("entries hosted", f"""SELECT host, {BAIT_N} >= 4 OR fanout >= 3 AS flag,
            ({BAIT_N} + CASE WHEN fanout >= 3 THEN 3 ELSE 0 END)::INT AS score, {HONEYPOT_REASONS} AS reasons
            FROM fan LEFT JOIN baits USING (host)""", fan=PARTS["fan"].format(src="hosted"), baits=BAIT_AGG.format(src="hosted")),
        # payloads, reputation
        "payload_names": sql("entries", f"SELECT name, {PAYLOAD} AS is_payload FROM entries"),
        "select_payloads": sql("entries hosted", f"SELECT snapshot_id, name, url FROM ({SELECTED}) WHERE place <= 2"),
        "load_hashes": sql("entries hosted", f"""SELECT snapshot_id,
            CASE WHEN snapshot_id % 13 = 5 THEN '' ELSE name END AS name,
            url || CASE WHEN snapshot_id % 13 = 5 THEN '?x' ELSE '' END AS url,
            CASE WHEN snapshot_id % 4 = 3 THEN '' ELSE sha256(url) END AS sha256,
            CASE WHEN snapshot_id % 4 = 3 THEN '' ELSE md5(url) END AS md5, '' AS tlsh,
            CASE WHEN snapshot_id % 4 = 3 THEN 0 ELSE length(url) END::INT AS size,
            CASE WHEN snapshot_id % 4 = 3 THEN 'http 404' ELSE '' END AS error
            FROM (SELECT DISTINCT snapshot_id, name, url FROM ({SELECTED}))"""),
        "hash_pending": sql("cls hashes", """SELECT snapshot_id FROM snaps WHERE is_open_dir AND snapshot_id IN (SELECT snapshot_id
            FROM cls WHERE ruleset_version = '1.1.0' AND label IN ('sensitive_exposure', 'malicious_staging'))
            AND snapshot_id NOT IN (SELECT snapshot_id FROM hashes WHERE snapshot_id % 10 < 3) ORDER BY snapshot_id LIMIT 50"""),
        "hash_summary": sql("hashes", """SELECT count(*) FILTER (sha256 <> '') AS hashed, count(*) FILTER (sha256 = '') AS skipped,
            count(*) FILTER (error <> '') AS errored FROM hashes"""),
        "hashed_types": sql("hashes", """SELECT regexp_extract(lower(name), '([^.]*)$', 1) AS ext, count(*) AS n FROM hashes
            WHERE sha256 <> '' AND contains(name, '.') GROUP BY 1"""),
        "vt_pending": sql("hashes", """SELECT snapshot_id, name, sha256 FROM hashes WHERE NOT has_vt AND sha256 <> ''
            ORDER BY snapshot_id, pos LIMIT 100"""),
        "vt_enrich": sql("hashes", """SELECT snapshot_id, name, sha256,
            CASE WHEN fresh THEN true ELSE found END AS found, CASE WHEN fresh THEN snapshot_id ELSE malicious END AS malicious
            FROM (SELECT *, NOT has_vt AND sha256 <> '' AND snapshot_id % 4 <> 0 AS fresh FROM hashes)"""),
        "vt_summary": sql("hashes", """SELECT count(*) FILTER (has_vt) AS looked_up, count(*) FILTER (found) AS found,
            count(*) FILTER (malicious > 0) AS malicious FROM hashes"""),
        "vt_state": sql("hashes", """SELECT snapshot_id, name, CASE WHEN error <> '' THEN 'error'
            WHEN NOT coalesce(found, false) THEN 'pending' WHEN malicious > 0 THEN 'flagged' ELSE 'clean' END AS state FROM hashes"""),
        # host files
        "host_tokens": sql("cands", f"SELECT host, {_token('host')} AS token FROM (SELECT DISTINCT host FROM cands)"),
        "file_alarms": sql("entries", f"SELECT snapshot_id, name, ({WEBSHELL}) OR snapshot_id % 30 = 1 AS alarm FROM entries"),
        "file_rank": sql("entries", f"""SELECT snapshot_id, name, size, {_rank('CASE WHEN snapshot_id % 30 = 1 THEN 3 END')}
            AS rank FROM entries"""),
        "file_disclosure": sql("entries", DISCLOSED.format(name=f"CASE WHEN {PAYLOAD} THEN name END")),
        "file_disclosure_full": sql("entries", DISCLOSED.format(name="name")),
        "hash_join": sql("files", "SELECT snapshot_id, host, name, size, sha256, malicious::BIGINT AS malicious FROM files"),
        "top_files_per_host": sql("top", "SELECT host, place, rank, name, size, mtime, alarm FROM top"),
        "host_inventory": sql("top hsig", f"""SELECT {_token('host')} AS token,
            CASE WHEN t.sev = 1 THEN 'malicious' ELSE 'sensitive' END AS verdict,
            {_flagged_names('sig_', P.SIGNAL_LABELS)} AS signals, coalesce(files, '') AS files, coalesce(sizes, '') AS sizes,
            coalesce(shown, 0) AS shown, total, total - coalesce(shown, 0) AS hidden, has_meta,
            CASE WHEN {BAIT_N} >= 4 OR fanout >= 3 THEN {HONEYPOT_REASONS} END AS honeypot
            FROM totals t JOIN hsig USING (host) JOIN fan USING (host) LEFT JOIN shown USING (host)
            WHERE host IN ({HOST_FLAGGED})""", totals=HOST_TOTALS, fan=PARTS["fan"].format(src="recs"), shown=INVENTORY_FILES),
        "host_file_rows": sql("files", f"""SELECT {_token('host')} AS token, row_number() OVER (PARTITION BY host ORDER BY rank,
            coalesce(size, 0) DESC, first_open_at, first_open_id, pos) AS place, rank, CASE WHEN program THEN 'exec' ELSE 'data' END AS kind,
            name, size, CASE WHEN program THEN alarm END AS alarm FROM files WHERE host IN ({HOST_FLAGGED})"""),
        # report
        "corpus_funnel": sql("snaps cands", """SELECT count(*) AS candidates, count(*) FILTER (status = 'captured') AS captured,
            count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'pending') AS pending,
            (SELECT count(DISTINCT candidate_id) FROM snaps WHERE is_open_dir) AS open_dirs,
            (SELECT count(DISTINCT candidate_id) FROM snaps WHERE http_status = 200 AND NOT is_open_dir) AS not_listing FROM cands"""),
        "latest_open": sql("latest", f"""SELECT candidate_id, snapshot_id, {DAY.format('fetched_at')}, {DAY.format('first_open_at')},
            first_open_id, server_kind FROM latest"""),
        "false_positive_rate": sql("snaps", """SELECT open_dirs, not_listing, not_listing::DOUBLE / nullif(open_dirs + not_listing, 0)
            AS rate FROM (SELECT count(DISTINCT candidate_id) FILTER (is_open_dir) AS open_dirs,
            count(DISTINCT candidate_id) FILTER (http_status = 200 AND NOT is_open_dir) AS not_listing FROM snaps)"""),
        "network_report": sql("net", f"""SELECT category, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share
            FROM (SELECT {CATEGORY} AS category FROM net) GROUP BY category"""),
        "top_providers": sql("net", f"SELECT {PROVIDER} AS provider, count(*) AS n FROM net GROUP BY 1 {top('provider', 8)}"),
        "top_countries": sql("net", f"SELECT country, count(*) AS n FROM net GROUP BY 1 {top('country', 10)}"),
        "label_shares": sql("newest_current", SHARES),
        "signal_prevalence": sql("newest", SIGS),
        "ext_prevalence": sql("entries newest", f"""SELECT ext, count(*) AS n FROM (SELECT snapshot_id, ext FROM (SELECT *,
            row_number() OVER (PARTITION BY snapshot_id ORDER BY n DESC, ext) AS place FROM (SELECT snapshot_id, {EXT} AS ext,
            count(*) AS n FROM entries WHERE NOT is_dir GROUP BY ALL) WHERE ext <> '') WHERE place <= 10)
            WHERE snapshot_id IN (SELECT snapshot_id FROM newest) GROUP BY ext {top('ext', 12)}"""),
        "server_software": sql("latest", "SELECT server_kind, count(*) AS n FROM latest GROUP BY server_kind"),
        "interest_prevalence": sql("latest prof", f"""SELECT category, count(*) AS dirs FROM ({unpivot('i', 'prof')})
            WHERE snapshot_id IN (SELECT snapshot_id FROM latest) GROUP BY category"""),
        "exposed_volume": sql("latest prof", """SELECT count(*) AS sized_dirs, sum(total_bytes)::BIGINT AS total_bytes,
            sum(over)::BIGINT AS files_over_100mb FROM prof JOIN latest USING (snapshot_id) WHERE known_sizes > 0"""),
        "kpis": sql("newest newest_current recs", f"""SELECT *, greatest(2, CAST(round_even(classified / sensitive, 0) AS BIGINT)) AS one_in
            FROM (SELECT (SELECT count(*) FROM newest_current) AS classified,
            (SELECT count(*) FROM newest_current WHERE label IN ('malicious_staging', 'sensitive_exposure')) AS sensitive,
            (SELECT count(*) FROM newest_current WHERE label = 'malicious_staging') AS malicious,
            (SELECT count(*) FROM newest WHERE p_webshell > 0) AS webshell_dirs,
            (SELECT sum((s_env > 0)::INT + (s_credential > 0)::INT + (s_priv_key > 0)::INT + (s_ssh_key > 0)::INT)::BIGINT
                FROM newest) AS credential_key,
            (SELECT count(*) FROM totals JOIN fan USING (host) WHERE host IN ({HOST_FLAGGED})
                AND ({BAIT_N} >= 4 OR fanout >= 3)) AS honeypot_hosts)""",
                    totals=HOST_TOTALS, fan=PARTS["fan"].format(src="recs")),
        "one_in": sql("judged", """SELECT *, greatest(2, CAST(round_even(n::DOUBLE / nullif(k, 0), 0) AS BIGINT)) AS one_in
            FROM (SELECT server_kind, count(*) AS n, count(*) FILTER (label IN ('malicious_staging', 'sensitive_exposure')) AS k
            FROM judged GROUP BY server_kind)"""),
        # queues, browsing
        "pending_queue": sql("cands", """SELECT candidate_id, url FROM cands WHERE status = 'pending'
            ORDER BY first_seen, candidate_id LIMIT 50"""),
        "pending_count": sql("cands", "SELECT count(*) AS pending FROM cands WHERE status = 'pending'"),
        "recapture_queue": sql("cands snaps", """SELECT candidate_id, url FROM cands WHERE candidate_id IN
            (SELECT candidate_id FROM snaps WHERE is_open_dir) ORDER BY first_seen, candidate_id LIMIT 50"""),
        "advance_status": sql("cands snaps", """SELECT candidate_id, coalesce(outcome, status) AS status,
            strftime(seen, '%Y-%m-%d') AS last_captured_at FROM cands LEFT JOIN (SELECT candidate_id, fetched_at AS seen,
            CASE WHEN http_status = 404 THEN 'error' ELSE 'captured' END AS outcome FROM (SELECT *, row_number() OVER (
            PARTITION BY candidate_id ORDER BY fetched_at DESC, snapshot_id DESC) AS rn FROM snaps) WHERE rn = 1) USING (candidate_id)"""),
        "browse": sql("hosted", """SELECT snapshot_id, url, server_kind FROM hosted WHERE server_kind IN ('apache', 'nginx')
            AND is_open_dir AND http_status = 200 AND contains(lower(url), 'h1')
            AND fetched_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'"""),
    }
    out |= _added(unpivot)
    meant = "['benign_index', 'intentional_public', 'sensitive_exposure', 'malicious_staging'][CAST(snapshot_id % 8 % 4 + 1 AS INT)]"
    gold = f"(SELECT label, {meant} AS expected FROM judged)"
    out["goldset_eval"] = sql("judged", "SELECT expected, " + ", ".join(
        f"count(*) FILTER (label = {q(x)}) AS {x}" for x in P.LABELS) + f" FROM {gold} GROUP BY expected")
    out["goldset_accuracy"] = sql("judged", f"""SELECT count(*) AS cases, count(*) FILTER (expected = label) AS correct,
        avg((expected = label)::INT::DOUBLE) AS accuracy FROM {gold}""")
    out["ingest_rejects"] = f"""SELECT value, {OUTCOME} AS outcome FROM (SELECT *, CASE kind
        WHEN 0 THEN '{{"error":"",' || u || w WHEN 2 THEN '{{ not json ' || snapshot_id::VARCHAR
        WHEN 3 THEN '{{' || u || ',"http_status":200}}' WHEN 4 THEN '{{"url":"http://unknown/","http_status":200}}'
        WHEN 5 THEN '{{"error":"timeout","http_status":null,"final_url":"http://f/",' || u || '}}'
        WHEN 6 THEN '{{"http_status":200}}' WHEN 9 THEN '{{"error":"",' || u || ',"http_status":"abc"}}'
        WHEN 10 THEN '{{"error":"","title":"alt",' || u || w WHEN 11 THEN '{{"error":"",' || u || w ELSE '{{"error":null,' || u || w END AS value FROM (
        SELECT *, '' AS w, '"url":"' || {URL.format(c='candidate_id')} || '"' AS u FROM ({CAPTURES}) WHERE kind NOT IN (1, 8)))
        WHERE outcome IN ('unmatched', 'mistyped', 'malformed')"""
    out["fp_template"] = (
        TEMPLATES.replace("{pages}", rendered_pages()).replace("{top}", _TOP).replace("{void}", _in(sorted(_VOID)))
        .replace("{raw}", _in(sorted(_RAW))).replace("{head}", _in(sorted(_HEAD)))
    )
    out["listing_snapshots"] = f"""SELECT page_id, final_url, title, is_open_dir, server_kind, coalesce(n, 0) AS entry_count,
        coalesce(entries, '') AS entries, first_page
        FROM ({out["validate_listing"]}) JOIN ({out["server_kind"]}) USING (page_id) JOIN ({out["fp_template"]}) USING (page_id)
        JOIN (SELECT o_orderkey AS page_id, 'http://h' || (o_custkey % 400)::VARCHAR || '.example/d' || (o_orderkey % 50)::VARCHAR || '/' AS final_url
            FROM orders UNION ALL SELECT -1 - page_id, url FROM pages) USING (page_id)
        LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(name || '|' || href || '|' || is_dir::VARCHAR || '|' || coalesce(size::VARCHAR, '-') || '|'
                || coalesce(mtime, '-') || '|' || path, ';' ORDER BY pos) AS entries
            FROM ({out["extract_entries"]}) JOIN ({out["entry_paths"]}) USING (page_id, pos) JOIN ({out["entry_meta"]}) USING (page_id, pos)
            GROUP BY page_id) USING (page_id)"""
    out["src_large_host_search"] = out["src_host_search"]
    out |= _uncapped(out)
    return out

"""Table schemas as DDL. JSON-like columns are typed structs, arrays and maps."""

SOURCE_META = (
    "ip string, port int, asn string, org string, hostnames array<string>, "
    "country string, product string"
)
ENTRY = "name string, href string, is_dir boolean, size bigint, mtime string, path string"
TLS = (
    "sha256 string, issuer string, subject string, not_before string, "
    "not_after string, self_signed boolean"
)
HEADERS = "array<struct<k: string, v: string>>"
VT = (
    "found boolean, malicious bigint, suspicious bigint, total bigint, "
    "type string, name string, error string"
)
CANDIDATE = (
    "candidate_id bigint, dedup_key string, url string, source string, "
    f"source_meta struct<{SOURCE_META}>, first_seen timestamp, status string, "
    "last_captured_at timestamp"
)
SNAPSHOT = (
    "candidate_id bigint, http_status int, final_url string, headers " + HEADERS + ", "
    "server_banner string, server_kind string, title string, is_open_dir boolean, "
    f"listing_entries array<struct<{ENTRY}>>, entry_count bigint, raw_html_sha256 string, "
    "header_order_sha256 string, template_sha256 string, favicon_sha256 string, "
    f"tls struct<{TLS}>, error string"
)
#: Reader options: values of any length, where the default ends records beyond 20,000,000 characters.
ANY_LENGTH = {"maxStringLen": "2147483647"}

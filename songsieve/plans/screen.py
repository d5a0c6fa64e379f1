"""Screening queries over page URLs and derived request rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from songsieve.operators import screening as s
from songsieve.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ALLOWED = ["example.com", "example.org"]
H = r"nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)', 1)), '\.$', ''), '')"
OK = f"(regexp_replace({H}, '^www\\.', '') IN ('example.com', 'example.org') OR suffix({H}, '.example.com') OR suffix({H}, '.example.org'))"
QUERIES["host_allowlist"] = lambda spark, d: read(spark, d, "pages").select("page_id", s.host(F.col("url")).alias("host"), s.host_allowed(s.host(F.col("url")), ALLOWED).alias("allowed"))
ORACLES["host_allowlist"] = f"SELECT page_id, {H} AS host, {OK} AS allowed FROM pages"


def numbered_hosts(spark, d):
    """An IPv4 address from each event's id."""
    e = read(spark, d, "events")
    return e.select("event_id", F.concat_ws(".", *[((F.col("event_id") * m) % 256).cast("string") for m in (37, 91, 13, 1)]).alias("ip"))


IP = "concat_ws('.', event_id * 37 % 256, event_id * 91 % 256, event_id * 13 % 256, event_id % 256)"
PRIVATE = """(a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19)) OR a >= 224)"""
QUERIES["private_hosts"] = lambda spark, d: numbered_hosts(spark, d).select("event_id", "ip", s.private_ipv4(F.col("ip")).alias("private"))
ORACLES["private_hosts"] = f"SELECT event_id, {IP} AS ip, {PRIVATE} AS private FROM (SELECT event_id, event_id * 37 % 256 AS a, event_id * 91 % 256 AS b FROM events)"


def screen_urls(spark, d):
    p = read(spark, d, "pages").withColumn("k", F.col("page_id") % 5)
    url = (
        F.when(F.col("k") == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("k") == 1, F.regexp_replace("url", "://", "://me:pw@"))
        .when(F.col("k") == 2, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 256, F.lit("/x"))).when(F.col("k") == 3, F.lit("http://[::1]/x")).otherwise(F.col("url"))
    )
    return p.select("page_id", F.coalesce(s.reason(url, ALLOWED), F.lit("OK")).alias("reason"))


QUERIES["screen_urls"] = screen_urls
ORACLES["screen_urls"] = f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'SCHEME' WHEN 1 THEN 'CREDENTIALS' WHEN 2 THEN 'PRIVATE' WHEN 3 THEN 'PRIVATE' ELSE CASE WHEN {OK} THEN 'OK' ELSE 'NOT_ALLOWED' END END AS reason FROM pages"
QUERIES["canonical_url"] = lambda spark, d: read(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("canonical"))
ORACLES["canonical_url"] = "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical FROM pages"
QUERIES["safe_media_url"] = lambda spark, d: read(spark, d, "pages").select("page_id", s.media_url(F.concat(F.lit("/img/"), F.col("page_id"), F.lit(".jpg 1x, /b.jpg 2x")), F.col("url")).alias("image"))
ORACLES["safe_media_url"] = "SELECT page_id, regexp_replace(regexp_extract(url, '^(https?://[^/?#]+)', 1), '^http://', 'https://') || '/img/' || page_id || '.jpg' AS image FROM pages"


def header_filter(spark, d):
    """The header map of an event keeps allowed names, values cut."""
    e = read(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("h"))
    h = F.map_concat("h", F.create_map(F.lit("Accept"), F.lit("*/*"), F.lit("Cookie"), F.lit("x")))
    kept = F.transform_values(F.map_filter(h, lambda k, v: F.lower(k).isin("accept", "accept-language", "content-type", "user-agent", "x-api-key", "x-requested-with")), lambda k, v: F.left(v, F.lit(4000)))
    return e.select("event_id", F.to_json(kept).alias("headers"))


QUERIES["header_filter"] = header_filter
ORACLES["header_filter"] = """SELECT event_id, '{"Accept":"*/*"}' AS headers FROM events"""
QUERIES["page_guards"] = lambda spark, d: read(spark, d, "pages").select("page_id", (F.octet_length("html") <= 8000).alias("small_enough"), F.left(F.ltrim("html"), F.lit(9)).rlike("(?i)^<!doctype").alias("is_html"))
ORACLES["page_guards"] = "SELECT page_id, strlen(html) <= 8000 AS small_enough, regexp_matches(left(ltrim(html), 9), '(?i)^<!doctype') AS is_html FROM pages"


def validate_search(spark, d):
    """Request rows derived from the documents, with the messages of what is wrong with them."""
    r = read(spark, d, "documents").select("doc_id", F.trim("text").alias("query"), F.col("lang").alias("provider"), (F.col("doc_id") % 40).cast("int").alias("limit"), "source")
    found = s.issues(
        ("query: too long", F.length("query") > 160), ("provider: unknown", ~F.col("provider").isin("en", "fr", "es")), ("limit: below 1", F.col("limit") < 1), ("limit: above 25", F.col("limit") > 25),
    )
    return r.select("doc_id", found.alias("issues"), (found == "").alias("valid"))


QUERIES["validate_search"] = validate_search
ORACLES["validate_search"] = """SELECT doc_id, issues, issues = '' AS valid FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN length(trim(text)) > 160 THEN 'query: too long' END, CASE WHEN lang NOT IN ('en', 'fr', 'es') THEN 'provider: unknown' END,
 CASE WHEN doc_id % 40 < 1 THEN 'limit: below 1' END, CASE WHEN doc_id % 40 > 25 THEN 'limit: above 25' END], lambda x: x IS NOT NULL), '; ') AS issues FROM documents)"""
QUERIES["validate_lyrics_req"] = lambda spark, d: read(spark, d, "part").select("p_partkey", s.issues(("title: too long", F.length("p_name") > 25), ("request: empty", (F.col("p_size") % 5 == 0) & (F.length("p_brand") > 0))).alias("issues"))
ORACLES["validate_lyrics_req"] = "SELECT p_partkey, concat_ws('; ', CASE WHEN length(p_name) > 25 THEN 'title: too long' END, CASE WHEN p_size % 5 = 0 AND length(p_brand) > 0 THEN 'request: empty' END) AS issues FROM part"
QUERIES["validate_targets"] = lambda spark, d: read(spark, d, "pages").select("page_id", s.issues(("targetUrl: not a URL", ~F.col("url").rlike("^https?://")), ("timeoutMs: below 1000", F.length("html") < 1000), ("timeoutMs: above 15000", F.length("html") > 15000)).alias("issues"))
ORACLES["validate_targets"] = "SELECT page_id, concat_ws('; ', CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'targetUrl: not a URL' END, CASE WHEN length(html) < 1000 THEN 'timeoutMs: below 1000' END, CASE WHEN length(html) > 15000 THEN 'timeoutMs: above 15000' END) AS issues FROM pages"


def normalize_params(spark, d):
    r = read(spark, d, "documents")
    limit = F.least(F.lit(25), F.greatest(F.lit(1), F.coalesce(F.nullif((F.col("doc_id") % 60).cast("int"), F.lit(0)), F.lit(12))))
    return r.select("doc_id", F.trim(F.left(F.trim("text"), F.lit(160))).alias("query"), F.left("source", F.lit(120)).alias("artist"), limit.alias("limit"))


QUERIES["normalize_params"] = normalize_params
ORACLES["normalize_params"] = "SELECT doc_id, trim(left(trim(text), 160)) AS query, left(source, 120) AS artist, CAST(least(25, greatest(1, coalesce(nullif(doc_id % 60, 0), 12))) AS INTEGER) AS limit FROM documents"
QUERIES["default_search"] = lambda spark, d: read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "built-in").otherwise(F.col("source")).alias("provider"), F.when(F.col("doc_id") % 9 == 0, F.least(F.lit(12), F.col("doc_id") % 25)).otherwise(F.col("doc_id") % 25).alias("limit"))
ORACLES["default_search"] = "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'built-in' ELSE source END AS provider, CASE WHEN doc_id % 9 = 0 THEN least(12, doc_id % 25) ELSE doc_id % 25 END AS limit FROM documents"

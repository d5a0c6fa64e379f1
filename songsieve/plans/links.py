"""Queries over the links of pages, and over what fetched songs lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from songsieve.functions import text as t
from songsieve.operators import links, recovery
from songsieve.plans import duck
from songsieve.sources.tables import read, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def pages(spark, d):
    """Pages, their own titles as what is searched for."""
    rows = read(spark, d, "pages")
    return rows.withColumn("terms", t.search_terms(F.regexp_extract("html", "<title>([^<]*)", 1)))


def with_links(spark, d):
    """Pages with a link to a song of their site, one to a part of it and one to another site."""
    base = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    made = F.concat(F.lit('<a class="x" href="/some-band/song-'), "page_id", F.lit('.html?x=1#y">07. One Song por Some Band</a><a href="/top/song">Top of all</a><a href="https://other.example/a/b">Other site</a>'))
    return pages(spark, d).where(base != "").select("page_id", base.alias("url"), F.concat(made, made).alias("html"), F.array(F.lit("song"), F.lit("band")).alias("terms"))


QUERIES["src_site_links"] = lambda spark, d: links.site_links(with_links(spark, d))
ORACLES["src_site_links"] = """SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/some-band/song-' || page_id || '.html' AS url, 0 AS pos, '07. One Song' AS title, 'Some Band' AS artist, 92 AS score
 FROM pages WHERE regexp_matches(url, '^https?://[^/]+')"""
QUERIES["page_site_links"] = lambda spark, d: links.site_links(pages(spark, d).withColumn("terms", F.array().cast("array<string>")))


def with_results(spark, d):
    """Pages whose state lists a song twice, its artist an object, and an object without an address."""
    song = F.struct(F.concat(F.lit("/some-band/"), "page_id").alias("href"), F.concat(F.lit("Song "), "page_id").alias("name"), F.struct(F.lit("Some Band").alias("name")).alias("artist"))
    state = F.to_json(F.struct(F.struct(F.array(song, song).alias("hits"), F.struct(F.lit("x").alias("title")).alias("other")).alias("props")))
    base = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return read(spark, d, "pages").where(base != "").select("page_id", base.alias("url"), F.concat(F.lit('<script id="__NEXT_DATA__">'), state, F.lit("</script>"), "html").alias("html"), F.array().cast("array<string>").alias("terms"))


QUERIES["src_script_results"] = lambda spark, d: links.listed_songs(with_results(spark, d)).select("page_id", "url", "title", "artist", "score")
ORACLES["src_script_results"] = """SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/some-band/' || page_id AS url, 'Song ' || page_id AS title, 'Some Band' AS artist, 64 AS score
 FROM pages WHERE regexp_matches(url, '^https?://[^/]+')"""


def label_parts(spark, d):
    """Labels of parts: a number, the title and the maker, apart by a dash or a word."""
    made = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, ". ").otherwise(") "), "p_name", F.when(F.col("p_size") % 3 == 0, " – ").otherwise(" POR "), "p_brand")
    named = read(spark, d, "part").select("p_partkey", links.label_parts(links.numberless(made)).alias("x"))
    return named.select("p_partkey", F.get("x", F.lit(0)).alias("title"), F.get("x", F.lit(1)).alias("artist"))


QUERIES["label_parts"] = label_parts
ORACLES["label_parts"] = "SELECT p_partkey, trim(p_name) AS title, trim(p_brand) AS artist FROM part"


def json_path(spark, d):
    """Values of an event's properties, nested in a document, by paths that the rows hold."""
    rows = read(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.struct(F.array("c_name", "c_mktsegment").alias("list"), F.col("c_nationkey").alias("n")).alias("data"))).alias("j"))
    path = F.when(F.col("c_custkey") % 3 == 0, "data.list.1").when(F.col("c_custkey") % 3 == 1, ".data..n").otherwise("data.none")
    return rows.select("c_custkey", recovery.value_at(F.col("j"), path).alias("value"))


QUERIES["json_path"] = json_path
ORACLES["json_path"] = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN CAST(c_nationkey AS VARCHAR) END AS value FROM customer"
QUERIES["identity_override"] = lambda spark, d: records(spark, d).select("id", recovery.overridden(F.when(F.col("score") % 3 == 0, " ").when(F.col("score") % 3 == 1, F.upper("title")), F.col("title")).alias("title"))
ORACLES["identity_override"] = "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 1 THEN upper(p_name) ELSE p_name END AS title FROM part"


def detail_recovery(spark, d):
    """Records, some without album or image; media know the heavy ones, the second source the rest of them."""
    r = records(spark, d).withColumn("image_url", F.when(F.col("score") % 5 == 0, F.concat(F.lit("own/"), "id"))).withColumn("image_kind", F.when(F.col("score") % 5 == 0, "own"))
    songs = r.withColumn("album", F.when(F.col("score") % 2 == 0, F.col("album")))
    made = lambda rows, kind: rows.select(F.upper("title").alias("title"), "artist", "album", F.concat(F.lit(f"{kind}/"), "album").alias("image_url"), F.lit(kind).alias("image_kind"))
    return recovery.recovered(songs, made(r.where("score > 40"), "media"), made(r.where("score < 20"), "second")).select("id", "album", "image_url", "image_kind")


QUERIES["detail_recovery"] = detail_recovery
KEY = f"p_brand, {duck.comparable('p_name')} AS k"
ORACLES["detail_recovery"] = f"""WITH m AS (SELECT {KEY}, min(p_type) AS a FROM part WHERE p_size > 40 GROUP BY ALL), s AS (SELECT {KEY}, min(p_type) AS a FROM part WHERE p_size < 20 GROUP BY ALL)
 SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, m.a, CASE WHEN p_size % 5 <> 0 THEN s.a END) AS album,
 CASE WHEN p_size % 5 = 0 THEN 'own/' || p_partkey WHEN m.a IS NOT NULL THEN 'media/' || m.a ELSE 'second/' || s.a END AS image_url,
 CASE WHEN p_size % 5 = 0 THEN 'own' WHEN m.a IS NOT NULL THEN 'media' WHEN s.a IS NOT NULL THEN 'second' END AS image_kind
 FROM (SELECT *, {duck.comparable('p_name')} AS k FROM part) p LEFT JOIN m USING (p_brand, k) LEFT JOIN s USING (p_brand, k)"""

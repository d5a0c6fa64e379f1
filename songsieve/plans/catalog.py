"""Sources, manifests and enrichment; responses and manifests are made from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from songsieve.functions import text as t
from songsieve.operators import enrich as en
from songsieve.plans import duck
from songsieve.sources import json_records as j
from songsieve.sources.tables import read, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def responses(spark, d, fields):
    """One JSON response for each brand, its parts in order of their keys."""
    p = read(spark, d, "part")
    made = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", "p_size"))).alias("ps"))
    return made.select(F.col("p_brand").alias("brand"), F.to_json(F.transform("ps", fields)).alias("json"))


def catalog_fields(p):
    return F.struct(
        p["p_partkey"].alias("id"), F.when(p["p_size"] % 4 != 0, p["p_name"]).alias("trackName"), F.when(p["p_size"] % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Band of "), p["p_type"])).alias("artistName"),
        p["p_type"].alias("albumName"), (p["p_size"] % 7 == 0).alias("instrumental"), p["p_name"].alias("plainLyrics"),
    )


QUERIES["src_catalog_json"] = lambda spark, d: j.catalog_hits(responses(spark, d, catalog_fields), "brand", "json", 6)
RANKED = "(SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part)"
ORACLES["src_catalog_json"] = f"""SELECT p_brand AS brand, CAST(pos AS INTEGER) AS pos, p_partkey AS id, p_name AS title, 'Band of ' || p_type AS artist, p_type AS album, CAST(82 - least(pos, 20) AS INTEGER) AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS n FROM {RANKED} WHERE pos < 12 AND p_size % 7 <> 0 AND p_size % 4 <> 0 AND p_size % 3 <> 0) WHERE n <= 6"""


def excerpt_fields(p):
    return F.struct(F.when(p["p_size"] % 2 == 0, p["p_name"]).alias("title"), F.when(p["p_size"] % 2 == 1, p["p_name"]).alias("mus"), p["p_type"].alias("band"), F.struct(p["p_type"].alias("name")).alias("album"), F.when(p["p_size"] % 5 == 0, p["p_name"]).alias("snippet"))


QUERIES["src_excerpt_json"] = lambda spark, d: j.excerpt_hits(responses(spark, d, excerpt_fields).withColumn("json", F.concat(F.lit('{"response":{"docs":'), F.col("json"), F.lit("}}"))), "brand", "json").drop("preview")
ORACLES["src_excerpt_json"] = f"SELECT p_brand AS brand, CAST(pos AS INTEGER) AS pos, p_name AS title, p_type AS artist, p_type AS album, CAST(80 - pos + CASE WHEN p_size % 5 = 0 THEN 8 ELSE 0 END AS INTEGER) AS score FROM {RANKED}"
HIT = lambda p: F.struct(F.struct(p["p_partkey"].alias("id"), p["p_name"].alias("title")).alias("result"))
QUERIES["src_hits_json"] = lambda spark, d: j.section_hits(responses(spark, d, HIT).withColumn("json", F.concat(F.lit('{"response":{"sections":[{"hits":'), F.col("json"), F.lit("}]}}"))), "brand", "json")
ORACLES["src_hits_json"] = f"SELECT p_brand AS brand, CAST(pos AS INTEGER) AS pos, p_partkey AS id, p_name AS title, CAST(78 - pos AS INTEGER) AS score FROM {RANKED}"
CUSTOM = lambda p: F.struct(p["p_partkey"].cast("string").alias("id"), p["p_name"].alias("title"), F.when(p["p_size"] % 2 == 0, p["p_size"]).alias("score"))
QUERIES["src_custom_json"] = lambda spark, d: j.custom_hits(responses(spark, d, CUSTOM).withColumn("json", F.concat(F.lit('{"data":{"results":'), F.col("json"), F.lit("}}"))), "brand", "json")
ORACLES["src_custom_json"] = f"SELECT p_brand AS brand, CAST(pos AS INTEGER) AS pos, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 55 - pos END AS INTEGER) AS score FROM {RANKED}"


def src_song_json(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("x").alias("trackName"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("plainLyrics"), F.regexp_replace("text", "(?m)^", "[00:01.00]").alias("syncedLyrics"))).alias("json"))
    return docs.select(*[c.alias(n) for n, c in j.song(F.col("json")).items()]).drop("title")


QUERIES["src_song_json"] = src_song_json
ORACLES["src_song_json"] = "SELECT doc_id AS id, trim(text) AS lyrics, CAST(len(string_split(trim(text), chr(10))) AS INTEGER) AS line_count FROM documents"
QUERIES["src_artist_profile"] = lambda spark, d: read(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct(F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.col("s_name").alias("name"))).alias("artist"), F.when(F.col("s_suppkey") % 2 == 1, F.struct(F.col("s_name").alias("name"))).alias("band"))).alias("js")).select("s_suppkey", j.text_at(F.col("js"), "$.artist.name", "$.art.name", "$.band.name", "$.self.name").alias("name"))
ORACLES["src_artist_profile"] = "SELECT s_suppkey, s_name AS name FROM supplier"
QUERIES["src_catalog"] = lambda spark, d: records(spark, d).select("id", "title", "artist", "album", F.count("*").over(Window.partitionBy("artist")).alias("of_artist"))
ORACLES["src_catalog"] = "SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS album, count(*) OVER (PARTITION BY p_brand) AS of_artist FROM part"
QUERIES["catalog_samples"] = lambda spark, d: records(spark, d).groupBy("artist").agg(F.count("*").alias("total"), F.min("title").alias("first_title"))
ORACLES["catalog_samples"] = "SELECT p_brand AS artist, count(*) AS total, min(p_name) AS first_title FROM part GROUP BY p_brand"


# ---- verse tables: an order is a chapter, its lines are verses, the return flag is the translation
def verses(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("translation"), (F.col("l_orderkey") % 66 + 1).alias("book"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("verse"), F.col("l_linestatus").alias("text"))


def manifest(spark, d):
    """Entries of the translations that are not excluded, with their verse counts and sizes."""
    out = verses(spark, d).where(~F.col("translation").isin("N")).groupBy("translation").agg(F.count("*").alias("verse_count"), F.sum(F.octet_length("text")).cast("long").alias("size_bytes"))
    return out.select(F.lower("translation").alias("id"), F.concat(F.col("translation"), F.lit(".db")).alias("file_name"), "verse_count", "size_bytes")


QUERIES["manifest_build"] = manifest
MANIFEST = "SELECT lower(l_returnflag) AS id, l_returnflag || '.db' AS file_name, count(*) AS verse_count, CAST(sum(strlen(l_linestatus)) AS BIGINT) AS size_bytes FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_returnflag"
ORACLES["manifest_build"] = MANIFEST


def manifest_read(spark, d):
    """The manifest as one JSON text and back to rows."""
    whole = manifest(spark, d).agg(F.to_json(F.struct(F.lit(2).alias("schemaVersion"), F.array_sort(F.collect_list(F.struct("id", "file_name", "verse_count"))).alias("translations"))).alias("json"))
    back = F.from_json("json", "struct<schemaVersion:int,translations:array<struct<id:string,file_name:string,verse_count:long>>>")
    return whole.select(back.alias("m")).select("m.schemaVersion", F.explode("m.translations").alias("t")).select("schemaVersion", "t.*")


QUERIES["manifest_read"] = manifest_read
ORACLES["manifest_read"] = f"SELECT 2 AS schemaVersion, id, file_name, verse_count FROM ({MANIFEST})"


def verse_audit(spark, d):
    """Per translation: books, chapters, empty texts, repeated references and gaps in the numbering."""
    v = verses(spark, d)
    repeated = v.groupBy("translation", "book", "chapter", "verse").count().groupBy("translation").agg(F.count_if(F.col("count") > 1).alias("repeated"))
    w = Window.partitionBy("translation", "book", "chapter").orderBy("verse")
    gaps = v.withColumn("step", F.col("verse") - F.lag("verse", 1, 0).over(w)).groupBy("translation").agg(F.count_if(F.col("step") > 1).alias("gaps"), F.count_distinct("book").alias("books"), F.count_distinct("chapter").alias("chapters"), F.count_if(F.trim("text") == "").alias("empty"))
    return gaps.join(repeated, "translation")


QUERIES["verse_audit"] = verse_audit
ORACLES["verse_audit"] = """WITH v AS (SELECT l_returnflag AS translation, l_orderkey % 66 + 1 AS book, l_orderkey AS chapter, l_linenumber AS verse, l_linestatus AS text FROM lineitem),
 g AS (SELECT *, verse - lag(verse, 1, 0) OVER (PARTITION BY translation, book, chapter ORDER BY verse) AS step FROM v), r AS (SELECT translation, count(*) AS n FROM v GROUP BY translation, book, chapter, verse)
 SELECT translation, CAST(count_if(step > 1) AS BIGINT) AS gaps, count(DISTINCT book) AS books, count(DISTINCT chapter) AS chapters, CAST(count_if(trim(text) = '') AS BIGINT) AS empty, CAST((SELECT count_if(n > 1) FROM r WHERE r.translation = g.translation) AS BIGINT) AS repeated FROM g GROUP BY translation"""

# ---- enrichment
WORDS = {"one": ("idiot", "clown"), "two": ("heart", "thea"), "three": ("der", "die"), "four": ("que",)}
normal = lambda spark, d: read(spark, d, "documents").select("doc_id", t.normalized(F.col("text")).alias("norm"))
QUERIES["theme_tags"] = lambda spark, d: normal(spark, d).select("doc_id", F.array_join(en.themes(F.col("norm"), WORDS, "none"), ",").alias("themes"))
TN = duck.norm("text")
ORACLES["theme_tags"] = "SELECT doc_id, coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(n, '{w}')''' for w in ws)} THEN '{k}' END" for k, ws in WORDS.items()) + f"), ''), 'none') AS themes FROM (SELECT doc_id, {TN} AS n FROM documents)"
SUGGEST = ((("der", "die"), ("A 1:1", "B 2:2")), (("que",), ("C 3:3", "A 1:1")), (("thea",), ("D 4:4",)))
QUERIES["verse_suggestions"] = lambda spark, d: normal(spark, d).select("doc_id", F.array_join(en.verses(F.col("norm"), SUGGEST, ("Z 9:9",)), "|").alias("refs"))
ORACLES["verse_suggestions"] = f"""SELECT doc_id, CASE WHEN len(r) = 0 THEN 'Z 9:9' ELSE array_to_string(list_slice(list_filter(r, lambda x, i: list_position(r, x) = i), 1, 4), '|') END AS refs FROM (SELECT doc_id,
 CASE WHEN contains(n, 'der') OR contains(n, 'die') THEN ['A 1:1', 'B 2:2'] ELSE [] END || CASE WHEN contains(n, 'que') THEN ['C 3:3', 'A 1:1'] ELSE [] END || CASE WHEN contains(n, 'thea') THEN ['D 4:4'] ELSE [] END AS r FROM (SELECT doc_id, {TN} AS n FROM documents))"""


def section_rows(spark, d):
    """Turns as paragraphs: each third one with a section word, each fifth one repeated from the one before."""
    c = read(spark, d, "conversations")
    body = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("[Refrão]\n"), F.left("text", F.lit(30)))).when(F.col("turn") % 5 == 4, F.lit("same")).when(F.col("turn") % 5 == 0, F.lit("same")).otherwise(F.left("text", F.lit(30)))
    return c.select("conv_id", "turn", F.trim(body).alias("paragraph"))


QUERIES["sections"] = lambda spark, d: en.sections(section_rows(spark, d), "conv_id", "turn", "paragraph").select("conv_id", "turn", "type", "label")
ORACLES["sections"] = """WITH p AS (SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 2 THEN '[Refrão]' || chr(10) || left(text, 30) WHEN turn % 5 IN (4, 0) THEN 'same' ELSE left(text, 30) END) AS p FROM conversations),
 m AS (SELECT *, strip_accents(lower(regexp_extract(p, '(?i)^\\s*\\[?\\s*(refr[aã]o|coro|chorus|ponte|bridge|intro|final|outro|verso\\s*\\d*)\\s*\\]?\\s*[:\\-]?\\s*', 1))) AS k, lag(p) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM p),
 s AS (SELECT *, regexp_matches(k, 'refrao|coro|chorus') AS ch, regexp_matches(k, 'ponte|bridge') AS br, regexp_matches(k, 'intro') AS io, regexp_matches(k, 'final|outro') AS ou FROM m),
 n AS (SELECT *, sum(CASE WHEN ch OR br OR io OR ou THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS no, coalesce(NOT (ch OR br OR io OR ou) AND k = '' AND p = b, false) AS again FROM s)
 SELECT conv_id, turn, CASE WHEN again OR ch THEN 'chorus' WHEN br THEN 'bridge' WHEN io THEN 'intro' WHEN ou THEN 'outro' ELSE 'verse' END AS type,
 CASE WHEN again OR ch THEN 'Refrão' WHEN br THEN 'Ponte' WHEN io THEN 'Introdução' WHEN ou THEN 'Final' ELSE 'Verso ' || CAST(no AS VARCHAR) END AS label FROM n""".replace("\\\\", "\\")
QUERIES["enrich_song"] = lambda spark, d: records(spark, d).select("id", F.when(F.col("score") % 2 == 0, F.array("album")).otherwise(F.array().cast("array<string>")).alias("theme"), "title").select("id", F.array_join(F.when(F.size("theme") > 0, F.col("theme")).otherwise(en.themes(t.normalized(F.col("title")), {"warm": ("red", "gold")}, "none")), ",").alias("theme"))
ORACLES["enrich_song"] = f"SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type WHEN contains({duck.norm('p_name')}, 'red') OR contains({duck.norm('p_name')}, 'gold') THEN 'warm' ELSE 'none' END AS theme FROM part"


def artwork(spark, d):
    r = records(spark, d)
    albums = r.where("score > 40").groupBy("artist", "title").agg(F.min("album").alias("cover"))
    artists = r.where("score > 45").groupBy("artist").agg(F.concat(F.lit("img/"), F.min("id").cast("string")).alias("artist_image"))
    return en.with_artwork(r.select("id", "artist", "title"), albums, artists).select("id", "image_url", "image_kind")


QUERIES["artwork_fallback"] = artwork
ORACLES["artwork_fallback"] = """SELECT p_partkey AS id, coalesce(cover, img) AS image_url, CASE WHEN cover IS NOT NULL THEN 'album' WHEN img IS NOT NULL THEN 'artist' END AS image_kind FROM part p
 LEFT JOIN (SELECT p_brand, p_name, min(p_type) AS cover FROM part WHERE p_size > 40 GROUP BY ALL) a USING (p_brand, p_name) LEFT JOIN (SELECT p_brand, 'img/' || min(p_partkey) AS img FROM part WHERE p_size > 45 GROUP BY p_brand) i USING (p_brand)"""


def enrich_art(spark, d):
    """Cover of each record by its normal artist and title, from another source's spelling."""
    r = records(spark, d).select("id", t.normalized(F.col("artist")).alias("na"), t.normalized(F.col("title")).alias("nt"))
    other = records(spark, d).where("score > 30").groupBy(t.normalized(F.upper("artist")).alias("na"), t.normalized(F.upper("title")).alias("nt")).agg(F.max("album").alias("cover"))
    return r.join(other, ["na", "nt"], "left").select("id", "cover")


QUERIES["enrich_art"] = enrich_art
ORACLES["enrich_art"] = "SELECT p_partkey AS id, cover FROM part LEFT JOIN (SELECT p_brand, p_name, max(p_type) AS cover FROM part WHERE p_size > 30 GROUP BY ALL) USING (p_brand, p_name)"


def art_groups(spark, d):
    """Of each nation's first ten customers the first three segments seen, with how many they hold."""
    c = read(spark, d, "customer").withColumn("r", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("r <= 10")
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("r").alias("seen"), F.count("*").alias("n"))
    return g.withColumn("k", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("seen"))).where("k <= 3").select("c_nationkey", "c_mktsegment", "n")


QUERIES["art_groups"] = art_groups
ORACLES["art_groups"] = """SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY seen) AS k FROM (SELECT c_nationkey, c_mktsegment, min(r) AS seen, count(*) AS n FROM
 (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 10 GROUP BY ALL)) WHERE k <= 3"""
QUERIES["dim_lookup"] = lambda spark, d: read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("?")).alias("nation"), F.coalesce("r_name", F.lit("?")).alias("region"))
ORACLES["dim_lookup"] = "SELECT s_suppkey, coalesce(n_name, '?') AS nation, coalesce(r_name, '?') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"

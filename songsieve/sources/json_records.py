"""Catalog responses in JSON as rows of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "struct<id:long,trackName:string,name:string,artistName:string,albumName:string,instrumental:boolean,plainLyrics:string,syncedLyrics:string>"


def text_at(json: Column, *paths: str) -> Column:
    """First of the paths that holds a text that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths])


def catalog_hits(responses: DataFrame, key: str, json: str, limit: int) -> DataFrame:
    """(key, pos, id, title, artist, album, score) of array responses: the first usable records."""
    raw = responses.select(key, F.posexplode(F.slice(F.from_json(json, f"array<{RECORD}>"), 1, max(1, min(limit * 2, 20)))).alias("pos", "r"))
    title, artist = F.coalesce(F.nullif(F.trim("r.trackName"), F.lit("")), F.nullif(F.trim("r.name"), F.lit(""))), F.nullif(F.trim("r.artistName"), F.lit(""))
    rows = raw.select(key, "pos", F.col("r.id").alias("id"), title.alias("title"), artist.alias("artist"), F.col("r.albumName").alias("album"), F.coalesce("r.instrumental", F.lit(False)).alias("i"))
    usable = rows.where("not i and id is not null and title is not null and artist is not null").drop("i")
    from pyspark.sql import Window

    kept = usable.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("n") <= limit).drop("n")
    return kept.withColumn("score", F.lit(82) - F.least(F.col("pos"), F.lit(20)))


def excerpt_hits(responses: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, title, artist, album, score) of index responses whose fields go by several names."""
    docs = F.from_json(F.get_json_object(json, "$.response.docs"), "array<string>")
    rows = responses.select(key, F.posexplode(docs).alias("pos", "d"))
    d = F.col("d")
    album = F.when(F.get_json_object(d, "$.album.name").isNotNull(), F.get_json_object(d, "$.album.name")).otherwise(F.get_json_object(d, "$.album"))
    out = rows.select(key, "pos", text_at(d, "$.title", "$.mus", "$.name").alias("title"), text_at(d, "$.band", "$.artist", "$.art").alias("artist"), album.alias("album"), text_at(d, "$.excerpt", "$.snippet", "$.text", "$.content").alias("preview"))
    return out.where("title is not null and artist is not null").withColumn("score", F.lit(80) - F.col("pos") + F.when(F.col("preview").isNotNull(), 8).otherwise(0))


def section_hits(responses: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, id, title, score) of responses with hits in sections, or hits alone."""
    hit = "array<struct<result:struct<id:long,title:string,artist_names:string,url:string>>>"
    nested = F.flatten(F.transform(F.from_json(F.get_json_object(json, "$.response.sections"), f"array<struct<hits:{hit}>>"), lambda s: s["hits"]))
    flat = F.from_json(F.get_json_object(json, "$.response.hits"), hit)
    rows = responses.select(key, F.posexplode(F.coalesce(nested, flat)).alias("pos", "h"))
    return rows.select(key, "pos", F.col("h.result.id").alias("id"), F.col("h.result.title").alias("title"), (F.lit(78) - F.col("pos")).alias("score")).where("title is not null")


def custom_hits(responses: DataFrame, key: str, json: str) -> DataFrame:
    """(key, pos, id, title, score) of responses whose array lies at one of several places."""
    arrays = F.coalesce(*[F.from_json(F.get_json_object(json, p), "array<struct<id:string,title:string,score:int>>") for p in ("$.data.results", "$.results", "$.data")])
    rows = responses.select(key, F.posexplode(arrays).alias("pos", "r"))
    return rows.select(key, "pos", F.col("r.id").alias("id"), F.col("r.title").alias("title"), F.coalesce("r.score", F.lit(55) - F.col("pos")).alias("score"))


def song(record: Column) -> dict[str, Column]:
    """Lyrics of a song record: plain ones, else synchronised ones without their stamps."""
    from songsieve.functions.text import timestamps_stripped

    r = F.from_json(record, RECORD)
    lyrics = F.coalesce(F.nullif(F.trim(r["plainLyrics"]), F.lit("")), timestamps_stripped(r["syncedLyrics"]))
    return {"id": r["id"], "title": r["trackName"], "lyrics": lyrics, "line_count": F.size(F.split(lyrics, "\n"))}

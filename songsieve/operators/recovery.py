"""What a fetched song lacks, from other sources and from the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.functions import similarity as sim
from songsieve.functions import text as t


def overridden(asked: Column, fetched: Column) -> Column:
    """The requested title or artist, and where none was given the fetched one."""
    return F.coalesce(F.nullif(F.trim(asked), F.lit("")), fetched)


def value_at(json: Column, path: Column) -> Column:
    """The value of a JSON document at a dotted path; parts of digits only are places in arrays.

    Null for an empty path and where the path leads nowhere.
    """
    parts = F.filter(F.split(path, r"\."), lambda x: x != "")
    steps = F.transform(parts, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("["), x, F.lit("]"))).otherwise(F.concat(F.lit("['"), x, F.lit("']"))))
    return F.when(F.size(parts) > 0, F.call_function("get_json_object", json, F.concat(F.lit("$"), F.array_join(steps, ""))))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__artist", t.normalized(F.col("artist"))).withColumn("__title", t.comparable(F.col("title")))


def _one(rows: DataFrame, name: str) -> DataFrame:
    """One record of each artist and title, as a struct; the smallest, so that reruns agree."""
    return _keyed(rows).groupBy("__artist", "__title").agg(F.min(F.struct("title", "artist", "album", "image_url", "image_kind")).alias(name))


def recovered(songs: DataFrame, media: DataFrame, second: DataFrame) -> DataFrame:
    """Songs with the album and image they lack, from media records, then from a second source.

    All three hold artist, title, album, image_url and image_kind. What a song has stays. The second
    source is asked only where there is still no image, and counts only if its song is the one meant.
    Songs without an artist or a title stay as they are.
    """
    out = _keyed(songs).join(_one(media, "__m"), ["__artist", "__title"], "left").join(_one(second, "__s"), ["__artist", "__title"], "left")
    asked = (F.col("__artist") != "") & (F.col("__title") != "")
    m = lambda c: F.when(asked, F.col(f"__m.{c}"))
    meant = sim.matches_request(F.col("title"), F.col("artist"), F.col("__s.title"), F.col("__s.artist"))
    image = F.coalesce("image_url", m("image_url"))
    use = asked & image.isNull() & F.col("__s").isNotNull() & meant
    s = lambda c: F.when(use, F.col(f"__s.{c}"))
    filled = {
        "album": F.coalesce(F.col("album"), m("album"), s("album")),
        "image_url": F.coalesce(image, s("image_url")),
        "image_kind": F.when(F.col("image_url").isNotNull(), F.col("image_kind")).when(m("image_url").isNotNull(), m("image_kind")).otherwise(s("image_kind")),
    }
    return out.select(*[filled.get(c, F.col(c)).alias(c) for c in songs.columns])

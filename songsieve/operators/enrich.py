"""Enrichment: themes, references, sections and artwork."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.functions.text import normalized

#: Fixed keyword table of themes (on normal forms) and the theme given where none fits.
THEMES = {
    "Adoração": ("santo", "gloria", "adorar", "trono", "majestade", "louvor", "digno"),
    "Avivamento": ("fogo", "vento", "avivamento", "espirito santo", "derrama"),
    "Gratidão": ("obrigado", "grato", "gratidao", "bondade", "fidelidade", "graca"),
    "Oração & Intimidade": ("lugar secreto", "presenca", "ouvir tua voz", "falar contigo"),
    "Cruz & Redenção": ("cruz", "sangue", "calvario", "ressuscitou", "salvacao", "perdao"),
    "Esperança & Fé": ("amanha", "nao temerei", "confio", "milagre", "impossivel", "vitoria"),
    "Soberania": ("criacao", "universo", "todo poderoso", "rei dos reis", "soberano"),
}
DEFAULT_THEME = "Louvor & Adoração"
#: Fixed keyword table of verse suggestions and the pair given where none fits.
VERSES = (
    (("presenca", "lugar secreto"), ("Salmos 91:1", "Mateus 6:6")),
    (("bondade", "fiel"), ("Salmos 23:6", "Lamentações 3:22-23")),
    (("ressusc", "vive"), ("João 14:19", "1 Coríntios 15:57")),
    (("universo", "criacao"), ("Salmos 19:1", "Romanos 11:33-36")),
    (("amor", "graca"), ("Romanos 5:8", "1 João 4:19")),
)
DEFAULT_VERSES = ("Salmos 150:6", "Colossenses 3:16")
#: Fixed section words, tried in this order.
SECTIONS = (("refrao|coro|chorus", "chorus", "Refrão"), ("ponte|bridge", "bridge", "Ponte"), ("intro", "intro", "Introdução"), ("final|outro", "outro", "Final"))
MARKER = r"(?i)^\s*\[?\s*(refr[aã]o|coro|chorus|ponte|bridge|intro|final|outro|verso\s*\d*)\s*\]?\s*[:\-]?\s*"


def themes(norm: Column, table: dict = THEMES, default: str = DEFAULT_THEME) -> Column:
    """Names of the themes one of whose keywords the normal text holds."""
    found = F.array_compact(F.array(*[F.when(sum((F.contains(norm, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.lit(name)) for name, words in table.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def verses(norm: Column, table: tuple = VERSES, default: tuple = DEFAULT_VERSES) -> Column:
    """Up to four suggested references, in the table's order."""
    lists = [F.when(sum((F.contains(norm, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0, F.array(*map(F.lit, refs))).otherwise(F.array().cast("array<string>")) for words, refs in table]
    found = F.slice(F.array_distinct(F.flatten(F.array(*lists))), 1, 4)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, default)))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sections(rows: DataFrame, key: str, pos: str, paragraph: str) -> DataFrame:
    """Type, label and text of each paragraph of a song, in order.

    Paragraphs without a section word count up as verses; one that repeats the paragraph
    before it is a chorus.
    """
    w = Window.partitionBy(key).orderBy(pos)
    marker = F.regexp_extract(paragraph, MARKER, 1)
    out = rows.withColumn("__marker", normalized(marker)).withColumn("__before", F.lag(paragraph).over(w))
    kind, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for words, k, name in reversed(SECTIONS):
        kind, label = F.when(F.col("__marker").rlike(words), k).otherwise(kind), F.when(F.col("__marker").rlike(words), name).otherwise(label)
    out = out.withColumn("type", kind).withColumn("label", label)
    number = F.sum(F.col("type").isNull().cast("int")).over(w)
    again = F.col("type").isNull() & (F.col("__marker") == "") & (F.col(paragraph) == F.col("__before"))
    out = out.withColumn("__n", number).withColumn("__again", F.coalesce(again, F.lit(False)))
    return out.select(
        key, pos, F.when(F.col("__again"), "chorus").otherwise(F.coalesce("type", F.lit("verse"))).alias("type"),
        F.when(F.col("__again"), "Refrão").otherwise(F.coalesce("label", F.concat(F.lit("Verso "), F.col("__n").cast("string")))).alias("label"),
        F.trim(F.regexp_replace(paragraph, r"^\s*\[.*?\]\s*\n?", "")).alias("text"),
    )


def with_artwork(songs: DataFrame, albums: DataFrame, artists: DataFrame) -> DataFrame:
    """Cover of the album, else the artist's image, with its kind."""
    out = songs.join(albums, ["artist", "title"], "left").join(artists, "artist", "left")
    kind = F.when(F.col("cover").isNotNull(), "album").when(F.col("artist_image").isNotNull(), "artist")
    return out.withColumn("image_url", F.coalesce("cover", "artist_image")).withColumn("image_kind", kind)

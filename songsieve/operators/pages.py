"""Pages to texts: pages become rows of elements and text pieces, the rest is relational."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import text as t
from songsieve.operators import linkage
from songsieve.operators.tree import keyed, measured, nodes, pieces_of, run_lists, runs, text_of, with_texts
from songsieve.sources.tables import spread, staged

#: Fixed set of elements that may hold a whole text.
CONTAINERS = "article main section div pre blockquote".split()


def joined(key: Column | str = "pos", text: str = "text") -> Column:
    """Texts of a group joined by lines, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, F.col(text).alias("t")))), lambda x: x["t"]), "\n")


def read_once(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of pages and their runs of text, written: what reads them does not read the pages again."""
    flat = staged(flat)
    return flat, staged(runs(flat))


def density_blocks(flat: DataFrame, text_runs: DataFrame | None = None, most: int = 180) -> DataFrame:
    """Containers with enough text, lines and few links, with their structural bonus.

    The first ``most`` of a page in its order, as the rule has it; what fits is told by figures, so
    only those are put together.
    """
    flat, text_runs = read_once(flat) if text_runs is None else (flat, text_runs)
    fits = F.col("tag").isin(CONTAINERS) & F.col("chars").between(100, 120_000) & (F.col("lines") >= 3) & (F.col("density") <= 0.42)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("node"))
    wanted = measured(flat, text_runs).where(fits).withColumn("rank", rank).where(F.col("rank") <= most)
    inner = flat.where(F.col("tag").isin("div", "section", "article", "p", "pre", "blockquote") & (F.col("kind") == "e") & ~F.col("in_noise"))
    children = inner.groupBy("page_id", F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    out = with_texts(wanted, text_runs).join(children, ["page_id", "node"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    bonus = F.when(F.col("children") <= 12, 4.0).otherwise(-F.least(F.lit(16.0), F.col("children") / 3))
    return out.select("page_id", "text", "link_chars", F.lit("dom-density").alias("method"), F.lit("tree").alias("parser"), F.concat(F.lit("density:"), "tag").alias("source"), bonus.alias("bonus"))


def semantic_blocks(flat: DataFrame, most: int = 20) -> DataFrame:
    """Elements that the selectors of lyrics name, the first ``most`` of a page for each selector."""
    named = flat.where("kind = 'e' and not in_noise").select("page_id", "node", "pos", "stop", F.explode("selected").alias("selector"))
    wanted = named.withColumn("rank", F.row_number().over(Window.partitionBy("page_id", "selector").orderBy("node"))).where(F.col("rank") <= most)
    out = wanted.select("page_id", "node", "selector").join(pieces_of(flat, wanted.select("page_id", "node", "pos", "stop").distinct()), ["page_id", "node"]).where("text <> ''")
    method = F.when(F.contains("selector", F.lit("itemprop")), "microdata").otherwise("dom-semantic")
    return out.select("page_id", "text", "link_chars", method.alias("method"), F.lit("tree").alias("parser"), F.concat(F.lit("selector:"), "selector").alias("source"), F.lit(12.0).alias("bonus"))


def block_rows(text_runs: DataFrame) -> DataFrame:
    """(page_id, pos, text, density, link_chars) of the blocks that hold text themselves, in page order."""
    rows = text_runs.groupBy("page_id", "block").agg(F.min("at").alias("pos"), joined("run").alias("text"), F.sum("link_chars").alias("link_chars"))
    return rows.select("page_id", "pos", "text", (F.col("link_chars") / F.greatest(F.lit(1), F.length("text"))).alias("density"), "link_chars")


def block_clusters(flat: DataFrame, text_runs: DataFrame | None = None, strong: float = 8.0, weak: float = 2.0) -> DataFrame:
    """Runs of qualifying blocks with two strong ones at least, joined."""
    rows = block_rows(runs(flat) if text_runs is None else text_runs).withColumn("weight", q.block_score(F.col("text"), F.col("density")))
    w = Window.partitionBy("page_id").orderBy("pos")
    run = F.sum((F.col("weight") < weak).cast("int")).over(w)
    kept = rows.withColumn("run", run).where(F.col("weight") >= weak)
    out = kept.groupBy("page_id", "run").agg(joined().alias("text"), F.sum("link_chars").alias("link_chars"), F.count_if(F.col("weight") >= strong).alias("strong"))
    return out.where("strong >= 2").select("page_id", "text", "link_chars", F.lit("dom-cluster").alias("method"), F.lit("tree").alias("parser"), F.lit("cluster").alias("source"), F.lit(0.0).alias("bonus"))


def regex_containers(pages: DataFrame) -> DataFrame:
    """Content of container elements found by pattern, tolerant of a broken tree."""
    found = F.regexp_extract_all(t.paired(F.col("html"), ("article", "main", "pre")), F.lit(r"(?is)<(article|main|pre)\b[^<>]*+>(.*?)</\1>"), F.lit(2))
    rows = pages.select("page_id", F.explode(found).alias("raw"))
    return rows.select("page_id", t.html_stripped(t.unpaired(F.col("raw"))).alias("text"), F.lit(0).cast("long").alias("link_chars"), F.lit("heuristic-regex").alias("method"), F.lit("regex").alias("parser"), F.lit("container").alias("source"), F.lit(4.0).alias("bonus"))


def candidates(rows: DataFrame, method: Column | str, parser: Column | str, source: Column | str, bonus: Column | float) -> DataFrame:
    """Candidate rows from (page_id, text) ones that hold no links."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("page_id", "text", F.lit(0).cast("long").alias("link_chars"), c(method).alias("method"), c(parser).alias("parser"), c(source).alias("source"), c(bonus).cast("double").alias("bonus"))


#: Fixed names of properties that hold lyrics.
LYRIC_KEYS = "lyrics?|lyricText|songText|letra|letras"
#: A string literal's inside, by quote. Possessive: no step back, so no stack, however long it is.
LITERAL = {'"': r'[^"\\]*+(?:\\.[^"\\]*+)*+', "'": r"[^'\\]*+(?:\\.[^'\\]*+)*+"}


def quoted(rows: DataFrame, raw: str, least: int = 40) -> DataFrame:
    """(page_id, text): quoted lyric properties found in a text column, of at least so many characters."""
    found = F.concat(*[F.regexp_extract_all(raw, F.lit(rf"""(?i)["'](?:{LYRIC_KEYS})["']\s*:\s*{mark}({inside}){mark}"""), F.lit(1)) for mark, inside in LITERAL.items()])
    out = rows.select("page_id", F.explode(found).alias("__raw")).where(F.length(F.regexp_replace("__raw", r"\\.", "x")) >= least)
    return out.select("page_id", t.lyrics_normalized(t.js_string_decoded(F.col("__raw"))).alias("text"))


def quoted_props(pages: DataFrame, least: int = 40) -> DataFrame:
    """Quoted lyric properties of a page's scripts and attributes."""
    return candidates(quoted(pages, "html", least), "json-embedded", "script-scan", "embedded-property", 12)


def lyric_like(text: Column) -> Column:
    """Whether a value is long enough, and has lines and words enough, to be lyrics."""
    m = q.metrics(text)
    return (F.length(text) >= 45) & (m["line_count"] >= 2) & (m["word_count"] >= 10)


def flight_chunks(pages: DataFrame) -> DataFrame:
    """Lyrics in the string literals of streamed page state, and quoted properties inside those."""
    scripts = pages.select("page_id", F.explode(F.regexp_extract_all(t.paired(F.col("html"), ("script",)), F.lit(r"(?is)<script\b[^<>]*+>(.*?)</script>"), F.lit(1))).alias("raw")).where(F.col("raw").rlike(r"(?i)__next_f|react\.server|flight"))
    chunks = scripts.select("page_id", F.explode(F.regexp_extract_all("raw", F.lit(f'"({LITERAL[chr(34)]})"'), F.lit(1))).alias("chunk")).where(F.length("chunk") >= 40)
    decoded = chunks.select("page_id", t.js_string_decoded(F.col("chunk")).alias("raw")).where(F.col("raw").rlike(r"(?i)lyrics?|lyricText|songText|letra|vers[eo]"))
    whole = decoded.where(F.col("raw").rlike(r"(?i)lyrics?|letra|song.?text")).select("page_id", t.lyrics_normalized(F.col("raw")).alias("text")).where(lyric_like(F.col("text")))
    return candidates(quoted(decoded, "raw"), "json-embedded", "react-flight", "embedded-property", 12).unionByName(candidates(whole, "json-embedded", "react-flight", "react-flight-chunk", 5))


def alternate_markup(pages: DataFrame) -> DataFrame:
    """Content kept for browsers without scripts, and templates."""
    found = F.concat(*[F.transform(F.regexp_extract_all(t.paired(F.col("html"), (tag,)), F.lit(rf"(?is)<{tag}\b[^<>]*+>(.*?)</{tag}>"), F.lit(1)), lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("raw"))) for tag in ("noscript", "template")])
    rows = pages.select("page_id", F.explode(found).alias("f")).select("page_id", "f.tag", t.html_stripped(t.unpaired(F.col("f.raw"))).alias("text")).where(lyric_like(F.col("text")))
    return candidates(rows, "json-embedded", F.col("tag"), "alternate-markup", 3)


#: Fixed keys of a page's head that are read.
META = ("og:title", "twitter:title", "og:image", "twitter:image", "music:album")


def meta(pages: DataFrame, keys: tuple[str, ...] = META, also: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, also, one column a key): the content of the first tag of each key, by property or name; null where there is none."""
    attr = lambda tag, names: F.regexp_extract(tag, rf"""(?i)\b(?:{names})\s*=\s*(["'])(.*?)\1""", 2)
    tags = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*+>"), F.lit(0)), lambda m: F.struct(attr(m, "property|name").alias("key"), F.trim(attr(m, "content")).alias("content")))
    rows = pages.select("page_id", *also, tags.alias("tags"))
    first = lambda k: F.nullif(F.get(F.filter("tags", lambda m: m["key"] == k), F.lit(0))["content"], F.lit(""))
    return rows.select("page_id", *also, *[first(k).alias(k) for k in keys])


def page_media(flat: DataFrame) -> DataFrame:
    """(page_id, image, album) of a page's linked data, the first of each in its order."""
    values = json_values(scripts(flat).where("ld"), "page_id", "raw", 10)
    image = F.when(F.col("path").rlike(r"\.(?:image|image\.url|thumbnailUrl|thumbnail|contentUrl)$") & ~F.col("path").rlike(r"\]$"), F.struct("place", "value"))
    album = F.when(F.col("path").rlike(r"\.(?:inAlbum\.name|album\.name|album)$"), F.struct("place", F.trim("value").alias("value")))
    return values.where("not joined").groupBy("page_id").agg(F.min(image)["value"].alias("image"), F.min(album)["value"].alias("album"))


def media_url(c: Column) -> Column:
    """An image's address: the first of a set, over https; none for inline data."""
    first = F.trim(F.regexp_extract(F.trim(c), r"^([^\s,]+)", 1))
    return F.when((first != "") & ~F.lower(first).startswith("data:"), F.regexp_replace(first, r"^(?i:http:)?//", "https://"))


def songs(pages: DataFrame) -> DataFrame:
    """A song of each page (page_id, url, html) that yields lyrics: id, title, artist, album, image, lyrics and how they were found.

    Head and linked data are read from the pages and nodes that the extraction wrote. Rows that repeat an id are
    pages of their own.
    """
    given = keyed(pages)
    found, once, flat = extracted(given)
    title = F.trim(F.regexp_extract(t.paired(F.col("html"), ("title",)), r"(?is)<title\b[^<>]*+>(.*?)</title>", 1))
    head = meta(once.withColumn("title", title), also=("title",)).join(page_media(flat), "page_id", "left").withColumnRenamed("page_id", "key")
    head = given.select("key", "page_id", "url").join(head, "key")
    names = t.title_and_artist(F.coalesce("og:title", "twitter:title", "title"), F.col("url"))
    head = head.select("key", "page_id", "url", names.alias("names"), F.coalesce("music:album", "album").alias("album"), media_url(F.coalesce("og:image", "twitter:image", "image")).alias("image_url"))
    out = found.where("rejected is null").join(head, "key")
    return out.select("page_id", F.concat(F.lit("page-"), t.fnv1a(F.col("url"))).alias("id"), "names.title", "names.artist", "album", "image_url", F.col("text").alias("lyrics"), F.col("url").alias("source_url"), "method", "confidence")


#: Fixed characters that the bytes 0x80 to 0x9F stand for in windows-1252; five are unused.
CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def charset(content: Column, header: Column | None = None, head: int = 8192) -> Column:
    """Name of a page's encoding: from the header, the first bytes' meta tags, or utf-8."""
    name = r"""(?i)charset\s*=\s*["']?([^\s"'/>;]+)"""
    told = F.lit(None).cast("string") if header is None else F.nullif(F.regexp_extract(header, name, 1), F.lit(""))
    found = F.nullif(F.regexp_extract(F.decode(F.substring(content, 1, head), "ISO-8859-1"), r"(?i)<meta[^>]+" + name[4:], 1), F.lit(""))
    return F.lower(F.coalesce(told, found, F.lit("utf-8")))


def decoded(content: Column, name: Column) -> Column:
    """A page's bytes as text; Latin-1 names mean windows-1252, unknown ones UTF-8, whose faults become U+FFFD."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), CP1252)
    return F.when(name.isin("latin1", "latin-1", "iso-8859-1", "windows-1252", "cp1252", "us-ascii", "ascii"), latin).when(name.isin("utf-16", "utf-16le"), F.decode(content, "UTF-16LE")).when(name == "utf-16be", F.decode(content, "UTF-16BE")).otherwise(F.make_valid_utf8(content.cast("string")))


def weighted_nodes(flat: DataFrame, text_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Block elements with their figures, and the weights that text blocks give themselves and the two blocks around them.

    Only blocks of up to 6,000 characters, whose own score counts, are put together; blocks around the same text share it.
    """
    elements = staged(measured(flat, text_runs))
    small = with_texts(elements.where(F.col("chars").between(12, 6000) & (F.col("density") <= 0.58)), text_runs)
    own = small.select("page_id", "node", q.block_score(F.col("text"), F.col("density")).alias("own"))
    elements = staged(elements.join(own, ["page_id", "node"], "left"))
    source = elements.where(F.col("tag").isin("p", "pre", "blockquote", "li", "div") & (F.col("chars") >= 20) & (F.col("own") > 0)).select("page_id", "node", "block", "own")
    blocks = flat.where("kind = 'e' and not in_noise").select("page_id", F.col("node").alias("block"), F.col("block").alias("above"))
    up = source.join(blocks, ["page_id", "block"])
    give = lambda rows, node, share: rows.select("page_id", F.col(node).alias("node"), (F.col("own") * share).alias("w"))
    weights = give(source, "node", 0.2).union(give(up, "block", 1.0)).union(give(up, "above", 0.48)).where("node > 0")
    return elements, weights.groupBy("page_id", "node").agg(F.sum("w").alias("weight"))


def readability(flat: DataFrame, text_runs: DataFrame | None = None, most: int = 28) -> DataFrame:
    """Texts of the heaviest elements of each page, and of those with the siblings that belong to them.

    As the rule has it: ``most`` winners of a page, siblings of up to 12,000 characters, and no assembly
    where a block holds fewer than 2 or more than 120 of them.
    """
    flat, text_runs = read_once(flat) if text_runs is None else (flat, text_runs)
    elements, weights = weighted_nodes(flat, text_runs)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("weight"), "node"))
    weighed = elements.join(weights, ["page_id", "node"], "left")
    tops = weighed.where("weight is not null").withColumn("rank", rank).where(F.col("rank") <= most)
    made = lambda rows, source, bonus: rows.select("page_id", "text", "link_chars", F.lit("dom-readability").alias("method"), F.lit("tree").alias("parser"), source.alias("source"), bonus.alias("bonus"))
    winners = made(with_texts(tops.where(F.col("chars") >= 60), text_runs), F.concat(F.lit("winner:"), "tag"), F.least(F.lit(14.0), F.col("weight") / 5))
    top = tops.where("block > 0").select("page_id", "block", F.col("node").alias("top"), F.greatest(F.lit(8.0), F.col("weight") * 0.2).alias("least"))
    few = elements.groupBy("page_id", "block").agg(F.count("*").alias("n")).where(F.col("n").between(2, 120)).drop("n")
    near = weighed.join(top.join(few, ["page_id", "block"]), ["page_id", "block"])
    short = F.col("chars").between(12, 900) & (F.col("density") <= 0.12) & (F.coalesce("own", F.lit(-20.0)) >= 5)
    chosen = near.where(F.col("chars") <= 12_000).where((F.col("node") == F.col("top")) | (F.coalesce("weight", F.lit(0.0)) >= F.col("least")) | short)
    # siblings are put together from their page's runs when their figures fit: no text goes with them before
    ranges = F.array_sort(F.collect_list(F.struct("first", "final")))
    groups = chosen.groupBy("page_id", "top").agg(ranges.alias("ranges"), F.sum("link_chars").alias("link_chars"), F.count("*").alias("n"), F.sum("chars").alias("chars")).where("n >= 2 and chars >= 70")
    text = F.array_join(F.transform("ranges", lambda x: text_of(x["first"], x["final"])), "\n")
    groups = q.once(groups.join(run_lists(text_runs), "page_id"), {"text": text}).drop("runs")
    return winners.unionByName(made(groups, F.lit("siblings"), F.lit(13.0)))


def baseline_rescue(flat: DataFrame, text_runs: DataFrame | None = None) -> DataFrame:
    """All usable blocks of a page joined; for pages where nothing better was found."""
    rows = block_rows(runs(flat) if text_runs is None else text_runs)
    rows = rows.where(F.length("text").between(8, 2500) & (F.col("density") <= 0.24) & (t.noise_hits(F.col("text")) == 0))
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    before = F.lag("plain").over(Window.partitionBy("page_id").orderBy("pos"))
    rows = rows.withColumn("plain", plain).withColumn("before", before).where(~F.col("plain").eqNullSafe(F.col("before")))
    out = rows.groupBy("page_id").agg(joined().alias("text"), F.sum("link_chars").alias("link_chars")).where(F.length("text") >= 70)
    return out.select("page_id", "text", "link_chars", F.lit("baseline-rescue").alias("method"), F.lit("tree").alias("parser"), F.lit("baseline").alias("source"), F.lit(-10.0).alias("bonus"))


def json_values(scripts: DataFrame, key: str, raw: str, depth: int = 18, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, path, name, value, place, joined, steps, begins): all texts of JSON documents in order, and arrays of texts joined by lines.

    ``steps`` are the lengths of the paths of the objects and arrays around a value, outermost first, ``begins``
    the places of the first texts in those. Texts that are no JSON give no rows, and nothing is read below
    ``depth``, as the rule has it. Columns to ``keep`` go with each text.
    """
    schema = "path string, name string, value string, place int, joined boolean, steps array<int>, begins array<int>"
    kept = [key, *keep]

    def walk(node, path, name, steps, begins, rows):
        if isinstance(node, str):
            rows.append((path, name, node, False, steps, begins))
        elif len(steps) > depth:
            return
        elif isinstance(node, list | dict):
            inner, begun = [*steps, len(path)], [*begins, len(rows)]
            if isinstance(node, dict):
                for k, x in node.items():
                    walk(x, f"{path}.{k}", k, inner, begun, rows)
                return
            if node and all(isinstance(x, str) for x in node):
                rows.append((path, name, "\n".join(node), True, steps, begins))
            for i, x in enumerate(node):
                walk(x, f"{path}[{i}]", name, inner, begun, rows)

    def run(batches):
        import json

        for b in batches:
            for at, text in enumerate(b.column(0).to_pylist()):
                rows = []
                try:
                    walk(json.loads(text or "null"), "$", "", [], [], rows)
                except (ValueError, RecursionError):
                    continue
                path, name, value, joined, steps, begins = list(zip(*rows, strict=True)) or [()] * 6
                columns = [pa.array(path, pa.string()), pa.array(name, pa.string()), pa.array(value, pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(joined, pa.bool_()), pa.array(steps, pa.list_(pa.int32())), pa.array(begins, pa.list_(pa.int32()))]
                same = [pa.array([b.column(i)[at].as_py()] * len(rows), b.schema.field(i).type) for i in range(1, b.num_columns)]
                yield pa.RecordBatch.from_arrays([*same, *columns], names=[*kept, "path", "name", "value", "place", "joined", "steps", "begins"])

    rows = scripts.select(raw, *kept)
    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + f", {schema}")


def scripts(flat: DataFrame) -> DataFrame:
    """(page_id, raw, ld, id): scripts that hold structured data, by their type, their id or their first character."""
    named = flat.where("kind = 'e' and tag = 'script'").select("page_id", "node", "name")
    out = flat.where("kind = 't' and tag = 'script'").select("page_id", "node", F.trim("text").alias("raw")).join(named, ["page_id", "node"])
    ld = F.col("name").rlike(r"(?i)ld\+json")
    state = F.col("name").rlike(r"(?i)__NEXT_DATA__|__NUXT_DATA__|__APOLLO_STATE__|__INITIAL_STATE__|hydration|application/(?:ld\+)?json")
    return out.where(ld | state | F.col("raw").rlike(r"^[\[{]")).select("page_id", "raw", ld.alias("ld"), F.coalesce(F.nullif("name", F.lit("")), F.lit("json")).alias("id"))


def json_candidates(flat: DataFrame) -> DataFrame:
    """Lyric-like texts in the structured data of scripts: under a key, along a path, or as an array of lines."""
    rows = scripts(flat).withColumn("script", F.to_json(F.struct("page_id", "ld", "id")))
    values = json_values(rows, "script", "raw").withColumn("text", t.lyrics_normalized(F.col("value"))).where(lyric_like(F.col("text")))
    of = F.from_json("script", f"page_id {flat.schema['page_id'].dataType.simpleString()}, ld boolean, id string")
    values = values.withColumns({"page_id": of["page_id"], "ld": of["ld"], "id": of["id"]})
    path = lambda rx: F.col("path").rlike(f"(?i){rx}")
    key = F.when(F.col("name").rlike(r"(?i)^(?:lyrics?|lyric_text|song_text|songtext|letra|letras|verses?)$"), 18.0).when(F.col("name").rlike(r"(?i)(?:^|_)(?:lyrics?|lyric_text|song_text|songtext|letra|letras|verses?|content)(?:$|_)"), 8.0)
    ways = F.array(
        F.when(F.col("joined") & path("lyrics?|lyric|verse|letra|text"), F.struct(F.lit("structured-array:").alias("way"), F.lit(8.0).alias("bonus"))),
        F.when(~F.col("joined") & ~F.col("path").endswith("]") & key.isNotNull(), F.struct(F.lit("structured-key:").alias("way"), key.alias("bonus"))),
        F.when(~F.col("joined") & path("lyrics?|lyric|song.?text|letra|verse|content|text|description"), F.struct(F.lit("structured:").alias("way"), F.when(path("lyrics?|letra"), 12.0).otherwise(0.0).alias("bonus"))),
    )
    out = values.select("page_id", "text", "ld", "id", "path", F.explode(F.array_compact(ways)).alias("w"))
    return candidates(out, F.when(F.col("ld"), "json-ld").otherwise("hydration-state"), F.when(F.col("ld"), "json-ld").otherwise(F.concat(F.lit("script:"), "id")), F.concat("w.way", "path"), F.col("w.bonus"))


def scored(candidates: DataFrame, *more: str) -> DataFrame:
    """The candidates that have a score, with it, their fingerprint ``print`` and any other figures asked for.

    A page's text is mostly found in several ways: its figures and its fingerprint are made once for all of them.
    The rows are dealt by page, so that what goes through pages next needs no shuffle of the texts again.
    """
    ways = [c for c in candidates.columns if c not in ("page_id", "text")]
    texts = spread(candidates, "page_id").groupBy("page_id", "text").agg(F.collect_list(F.struct(*ways)).alias("ways"))
    texts = q.once(q.with_figures(texts).where(q.big_enough()), {"print": t.fingerprint(F.col("text"))})
    found = texts.withColumn("way", F.explode("ways")).drop("ways").withColumns({c: F.col("way")[c] for c in ways}).drop("way")
    return q.candidates_judged(found).select(*candidates.columns, "score", "print", *more)


def agreed(candidates: DataFrame) -> DataFrame:
    """The candidates with what others of their fingerprint and page tell: ``parsers``, ``extractors``, the score ``raised`` by them, and their ``turn``, 1 for the best."""
    w = Window.partitionBy("page_id", "print")
    many = lambda c: F.size(F.collect_set(c).over(w)) > 1
    out = candidates.withColumn("parsers", many("parser")).withColumn("extractors", many("method") | many("source"))
    raised = F.least(F.lit(140.0), F.col("score") + F.when(F.col("parsers"), 7).otherwise(0) + F.when(F.col("extractors"), 6).otherwise(0))
    return out.withColumn("turn", F.row_number().over(w.orderBy(F.desc("score"), "method", "source", "text"))).withColumn("raised", raised)


def deduped(candidates: DataFrame, dealt: bool = False) -> DataFrame:
    """One candidate of each fingerprint of a page, raised where parsers or methods agree; ``dealt`` tells that the rows come by page, as from :func:`scored`."""
    keyed = candidates if "print" in candidates.columns else candidates.withColumn("print", t.fingerprint(F.col("text")))
    keyed = keyed if dealt else spread(keyed, "page_id")  # serves the windows here and those over pages that follow
    return agreed(keyed).where("turn = 1").withColumn("score", F.col("raised")).drop("turn", "raised")


def with_lines(rows: DataFrame) -> DataFrame:
    """The rows with their texts' lines as hashes ``ls``, and ``chars``."""
    return rows.withColumns({"ls": F.transform(q.canonical_lines(F.col("text")), lambda x: F.xxhash64(x)), "chars": F.length("text")})


def near_merged(candidates: DataFrame, least: float = 0.86, written: DataFrame | None = None) -> DataFrame:
    """The candidates of each page without those alike to a better one that stays, which gains by the agreement.

    Candidates are taken in order of score, then fingerprint: one stays unless it is alike to one that
    stays before it, and the first such one takes it. Alike means line containment and ratio of lengths
    together; only candidates that share a line are compared. Lines are cut and hashed once, and written.
    Candidates of other pages that already have their place and lines and are ``written`` go with the others.
    """
    rows = staged(with_lines(candidates.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "print")))))
    rows = rows if written is None else rows.unionByName(written)
    ls = rows.select("page_id", "place", "parser", "method", "source", "chars", "ls").where(F.size("ls") >= 2)
    rows = rows.drop("ls", "chars")
    lines = ls.select("page_id", "place", "chars", F.size("ls").alias("n"), F.explode("ls").alias("line"))
    side = lambda df, x: df.select("page_id", *([] if "line" not in df.columns else ["line"]), *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("page_id", "line")])
    ratio = F.least("chars_a", "chars_b") / F.greatest("chars_a", "chars_b")
    met = side(lines, "a").join(side(lines, "b"), ["page_id", "line"]).where((F.col("place_a") < F.col("place_b")) & (ratio >= 0.55))
    shared = met.groupBy("page_id", "place_a", "place_b", "chars_a", "chars_b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    alike = shared.where(F.col("shared") / F.least("n_a", "n_b") * 0.82 + ratio * 0.18 >= least)
    of = ls.select("page_id", "place", "parser", "method", "source")
    agree = lambda c: F.col(f"{c}_a") != F.col(f"{c}_b")
    both = alike.select("page_id", "place_a", "place_b").join(side(of, "a"), ["page_id", "place_a"]).join(side(of, "b"), ["page_id", "place_b"])
    links = staged(both.select("page_id", F.col("place_a").alias("a"), F.col("place_b").alias("b"), agree("parser").alias("parsers"), (agree("method") | agree("source")).alias("extractors")))
    taken = linkage.absorbed(links, ["page_id"])
    gain = taken.join(links, ["page_id", "a", "b"]).groupBy("page_id", F.col("a").alias("place")).agg(F.max("parsers").alias("p"), F.max("extractors").alias("e"))
    kept = rows.join(taken.select("page_id", F.col("b").alias("place")), ["page_id", "place"], "left_anti").join(gain, ["page_id", "place"], "left")
    more = lambda flag, has, by: F.when(F.coalesce(F.col(flag), F.lit(False)) & ~F.col(has), by).otherwise(0)
    raised = F.least(F.lit(140.0), F.col("score") + more("p", "parsers", 7) + more("e", "extractors", 6))
    flags = {"parsers": F.col("parsers") | F.coalesce("p", F.lit(False)), "extractors": F.col("extractors") | F.coalesce("e", F.lit(False))}
    return kept.withColumn("score", raised).withColumns(flags).drop("place", "p", "e")


def extract(pages: DataFrame) -> DataFrame:
    """Best text of each page with its method, score and confidence, or the reason for none.

    Pages whose best text is weak get one more candidate, all their usable blocks. Rows that repeat an id are
    pages of their own; a null or empty page has no candidate.
    """
    given = keyed(pages)
    out, _, _ = extracted(given)
    return given.select("key", "page_id").join(out, "key").drop("key")


def extracted(given: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outcome by ``key`` of pages (key, html), and the distinct pages and their nodes as they were written, with the key as ``page_id``."""
    pages = staged(spread(given.select(F.col("key").alias("page_id"), "html"), "page_id").dropDuplicates(["page_id"]))
    flat, of = read_once(nodes(pages))
    parts = [density_blocks(flat, of), semantic_blocks(flat), block_clusters(flat, of), readability(flat, of), json_candidates(flat), regex_containers(pages), quoted_props(pages), flight_chunks(pages), alternate_markup(pages)]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    ok = F.max_by((F.col("quality") >= 56) & (F.col("confidence") >= 0.58), F.struct("score", F.length("text"))).over(Window.partitionBy("page_id"))
    first = agreed(scored(all_, "quality", "confidence").withColumn("good", ok))
    # texts of pages whose best is good are through with the dedupe and written with it; the others wait for the rescue
    first = first.withColumn("kept", F.col("good") & (F.col("turn") == 1)).where("kept or not good")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("raised"), "print"))
    first = with_lines(first.withColumn("place", F.when(F.col("kept"), place)))
    first = staged(first.withColumn("ls", F.when(F.col("kept"), F.col("ls"))).drop("quality", "confidence", "turn", "kept"))
    good = first.where("good").select("page_id").distinct()
    weak = first.where("not good").select(*all_.columns, "score", "print")
    weak = weak.unionByName(scored(baseline_rescue(flat, of).join(good, "page_id", "left_anti")))
    done = first.where("good").withColumn("score", F.col("raised")).drop("good", "raised")
    best = near_merged(deduped(weak), written=done).withColumn("lines", F.size(q.lines(F.col("text"))))
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc("lines"), "print")
    best = best.withColumn("r", F.row_number().over(w)).withColumn("merged", F.count("*").over(Window.partitionBy("page_id"))).where("r = 1")
    best = q.with_quality(best, "text", F.col("link_chars"))
    flags = pages.select("page_id", t.asks_for_human(F.col("html")).alias("anti_bot"))
    out = flags.join(best, "page_id", "left")
    reason = F.when(F.col("text").isNull(), "no-candidate").when(F.col("anti_bot") & (F.col("quality") < 72), "anti-bot").when((F.col("quality") < 30) | (F.col("lines") < 2), "low-quality")
    signals = F.array_compact(F.array(F.when(F.col("parsers"), F.lit("multi-parser-consensus")), F.when(F.col("extractors"), F.lit("cross-extractor-consensus"))))
    warnings = F.array_compact(F.array(F.when(F.col("anti_bot"), F.lit("anti-bot-page-detected")), F.when(F.col("quality") < 42, F.lit("low-content-quality"))))
    final = q.final_confidence(F.col("confidence"), signals, warnings, F.col("method"))
    return out.select(F.col("page_id").alias("key"), reason.alias("rejected"), F.when(reason.isNull(), F.col("text")).alias("text"), "method", F.round("score", 2).alias("score"), F.when(reason.isNull(), final).alias("confidence"), F.col("merged").alias("candidates")), pages, flat

"""Search over whole tables of queries: blocking joins, scores, ranking and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import similarity as sim
from songsieve.functions import text as t
from songsieve.sources.tables import spread, staged


def words_holding(parts: DataFrame, words: DataFrame, *kept: str) -> DataFrame:
    """(part, word): the distinct words that hold a part, by an equi-join on the part's first three characters; with the named columns of the words."""
    piece = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (k - 1))), lambda i: F.substring(c, i, F.lit(k)))
    keyed = words.select("word", *kept).distinct().select("word", *kept, F.explode(F.array_distinct(F.concat(*[piece(F.col("word"), k) for k in (1, 2, 3)]))).alias("key"))
    asked = parts.select("part").distinct().where("part <> ''").withColumn("key", F.left("part", F.lit(3)))
    return asked.join(keyed, "key").where(F.contains("word", F.col("part"))).select("part", "word", *kept)


def phrase_matches(queries: DataFrame, docs: DataFrame, least: int = 8) -> DataFrame:
    """(item_id, doc_id, place): passages that occur word for word in texts.

    A passage's longest inner word is its anchor. Texts meet passages in an equi-join on the
    anchors they hold; only those pairs are compared. Passages of one or two words have no inner
    word; their longest word may be part of a text's word, and meets it through its characters.
    """
    asked = queries.select("item_id", t.normalized(F.col("text")).alias("phrase")).where(F.length("phrase") >= least)
    words = F.split("phrase", " ")
    # inner words only: the outer ones may be parts of longer words in a text
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(F.array().cast("array<string>"))
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.select("item_id", "phrase", longest(inner).alias("anchor"), longest(words).alias("part"))
    texts = spread(docs.select("doc_id", "text"), "doc_id")
    held = texts.select("doc_id", F.explode(F.array_distinct(F.split(t.normalized(F.col("text")), " "))).alias("anchor"))
    whole = asked.where("anchor is not null").select("item_id", "phrase", "anchor")
    short = asked.where("anchor is null")
    if not short.isEmpty():
        part = words_holding(short, held.select(F.col("anchor").alias("word")))
        whole = whole.union(short.join(part, "part").select("item_id", "phrase", F.col("word").alias("anchor")))
    pairs = held.join(whole, "anchor").select("doc_id", "item_id", "phrase").distinct()
    near = staged(pairs).join(texts, "doc_id")
    # a text's normal form is made once a pair, not again for the filter on the place
    return q.once(near, {"place": F.instr(t.normalized(F.col("text")), F.col("phrase"))}).select("item_id", "doc_id", "place").where("place > 0")


def excerpt_matches(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, score, coverage, ordered, exact, start, size): texts that hold a passage, with its best window.

    A window of four lines that fits holds a given share of the passage's terms, parts of words included. Of any of
    them it may lack no more than of all, so of that many and two more it holds two: texts meet passages on the rarest
    of each passage's longer terms, by their distinct words. What a text meets is carried as one list, its lines are
    made normal once, and only passages of which it holds enough terms are scored.
    """
    asked = queries.select("item_id", F.col("text").alias("query"), t.search_terms(F.col("text")).alias("terms")).where("size(terms) > 0")
    n = F.size("terms")
    share = F.when(n <= 2, 1.0).when(n == 3, 0.78).otherwise(0.66)
    asked = asked.withColumn("least", F.ceil(n * share - 1e-9))
    ranked = asked.select("item_id", (n - F.col("least")).alias("spare"), F.ceil(F.col("least") / 2).alias("half"), F.least(F.lit(2), F.col("least")).alias("few"), F.explode("terms").alias("part"))
    turn = lambda *order: F.row_number().over(Window.partitionBy("item_id").orderBy(*order, "part"))
    longer = staged(ranked.withColumn("turn", turn(F.desc(F.length("part")))).where(F.col("turn") <= F.col("spare") + F.greatest("half", "few")).drop("turn", "half"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split(t.normalized(F.col("text")), " "))).alias("word"))
    holds = staged(words_holding(longer, words.groupBy("word").agg(F.count("*").alias("df")), "df"))
    rarity = holds.groupBy("part").agg(F.sum("df").alias("df"))
    rare = longer.join(rarity, "part", "left").withColumn("turn", turn(F.coalesce("df", F.lit(0)))).where(F.col("turn") <= F.col("spare") + F.col("few"))
    rare = staged(rare.select("item_id", "few", "part"))
    wanted = holds.select("part", "word").join(rare, "part")
    shortest = rare.agg(F.min(F.length("part"))).first()[0] or 0
    met = words.where(F.length("word") >= shortest).join(wanted, "word").groupBy("doc_id", "item_id", "few").agg(F.count_distinct("part").alias("n")).where(F.col("n") >= F.col("few"))
    few = asked.select("item_id", t.normalized(F.col("query")).alias("asked"), "terms", "least")
    lists = staged(met.select("doc_id", "item_id")).join(few, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "asked", "terms", "least")).alias("passages"))
    rows = spread(docs.select("doc_id", "text"), "doc_id").join(lists, "doc_id")
    rows = q.once(rows, {"ls": F.transform(q.lines(F.col("text")), t.normalized)}).select("doc_id", "ls", "passages")
    enough = lambda text: F.filter("passages", lambda x: F.size(F.filter(x["terms"], lambda w: F.contains(text, w))) >= x["least"])
    own = F.array_join(F.array_distinct(F.split(F.array_join("ls", " "), " ")), " ")
    rows = rows.select("doc_id", "ls", F.explode(t.let(own, enough)).alias("p")).select("doc_id", "ls", "p.item_id", "p.asked", "p.terms")
    found = sim.with_best_window(rows, "m", "ls", "asked", "terms", only_matched=True, normal=True)
    return found.select("item_id", "doc_id", "m.score", "m.coverage", "m.ordered", "m.exact", "m.start", "m.size")


def excerpt_candidates(results: DataFrame) -> DataFrame:
    """Of results (query, title, preview, ...) to passages those that may hold theirs: by the preview, or as a title of that name."""
    made = results.withColumns({"__asked": t.normalized(F.col("query")), "__terms": t.search_terms(F.col("query")), "__lines": q.lines(F.col("preview")), "__title": t.normalized(F.col("title"))})
    m = sim.with_best_window(made, "__m", "__lines", "__asked", "__terms")
    shown = ~t.is_generic_preview(F.col("preview")) & F.coalesce(F.col("__m.matched") | (F.col("__m.coverage") >= 0.72), F.lit(False))
    named = (sim.dice(F.col("__title"), F.col("__asked"), normal=True) >= 0.76) | (sim.term_coverage(F.col("__title"), F.col("__terms")) >= 0.86)
    return m.where(shown | named).drop("__asked", "__terms", "__lines", "__title", "__m")


def catalog_score(query: Column, title: Column, artist: Column, place: Column, has_lyrics: Column) -> Column:
    """Relevance of a catalog record at a place of its response; ``query``, ``title`` and ``artist`` are normal forms."""
    near = lambda c: F.contains(c, query) | F.contains(query, c)
    bonus = F.when(query == "", 0).when(title == query, 32).when(artist == query, 26).when(near(title), 18).when(near(artist), 14).otherwise(0)
    return F.lit(82) - F.least(place, F.lit(20)) + bonus + F.when(has_lyrics, 4).otherwise(0)


def _near_terms(query: Column, context: Column) -> tuple[Column, Column, Column]:
    """A query's terms, how many of them are around a link, and how many are asked for there."""
    terms = t.search_terms(query)
    n = F.size(terms)
    around = F.size(F.filter(terms, lambda w: F.contains(t.search_normalized(context), w)))
    return terms, around, F.when(n >= 5, F.least(F.lit(3), F.ceil(n * 0.35))).otherwise(1)


def context_suffices(context: Column, query: Column) -> Column:
    """Whether what is around a link holds enough of a query's terms to be shown for it."""
    _, around, least = _near_terms(query, context)
    return around >= least


def anchor_score(label: Column, path: Column, context: Column, query: Column) -> Column:
    """Score of a result page's link for a query, null where too few of its terms are near: all but ``query`` are texts.

    With five terms and more, a link whose own words hold none needs a third of them, three at most, around it.
    """
    terms, around, least = _near_terms(query, context)
    n, own = F.size(terms), t.search_normalized(F.concat_ws(" ", label, path))
    held = F.size(F.filter(terms, lambda w: F.contains(own, w)))
    score = F.lit(54) + held * 9 + around * 6 + F.when((held == n) & (n > 0), 14).otherwise(0)
    return F.when((n == 0) | (held > 0) | (around >= least), score)


def query_variants(queries: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, rank, variant): the ways in which a query is put to a source, without repeats."""
    squeeze = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    raw, artist = squeeze(F.col("query")), squeeze(F.col("artist"))
    pair = F.when((artist != "") & (raw != ""), F.concat_ws(" ", artist, raw))
    alone = F.when(raw != "", raw).otherwise(artist)
    words, terms = F.split(raw, " "), t.search_terms(raw)
    joined = lambda xs: F.array_join(xs, " ")
    passage = F.array(
        alone, pair, F.when(F.size(words) > 5, joined(F.slice(words, 1, 8))), F.when(F.size(words) > 8, joined(F.slice(words, -8, 8))),
        joined(F.slice(terms, 1, 8)), F.when(artist != "", F.concat_ws(" ", artist, joined(F.slice(terms, 1, 6)))),
    )
    made = F.filter(F.when(t.is_excerpt(F.col("query")), passage).otherwise(F.array(pair, alone)), lambda v: v.isNotNull() & (F.trim(v) != ""))
    keyed = queries.select(key, F.posexplode(made).alias("pos", "variant")).withColumn("norm", t.normalized(F.col("variant")))
    first = F.row_number().over(Window.partitionBy(key, "norm").orderBy("pos"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    once = keyed.withColumn("turn", first).where("turn = 1").withColumn("rank", rank)
    return once.where(F.col("rank") <= most).select(key, "rank", F.left("variant", F.lit(180)).alias("variant"))


def local_score(query: Column, title: Column, artist: Column, lyrics: Column, themes: Column, want: dict[str, Column] | None = None) -> Column:
    """Score of a record for a free query; all arguments but ``themes`` (an array) are normal forms.

    ``want`` may hold normal forms of a wanted title, artist and theme; asked for nothing, every record scores 10.
    """
    want = {k: F.coalesce((want or {}).get(k, F.lit("")), F.lit("")) for k in ("title", "artist", "theme")}
    asked = lambda c: c != ""
    coverage = sim.term_coverage(lyrics, t.search_terms(query))
    by_text = F.when(F.contains(lyrics, query), 36.0).when((F.size(t.search_terms(query)) >= 4) & (coverage >= 0.55), coverage * 30).otherwise(0.0)
    by_title = F.when(title == query, 85).when(F.contains(title, query), 60).otherwise(0)
    by_artist = F.when(artist == query, 70).when(F.contains(artist, query), 45).otherwise(0)
    by_theme = F.when(F.exists(themes, lambda x: F.contains(x, query)), 30).otherwise(0)
    fields = (
        F.when(asked(want["artist"]) & F.contains(artist, want["artist"]), 55).otherwise(0) + F.when(asked(want["title"]) & F.contains(title, want["title"]), 55).otherwise(0)
        + F.when(asked(want["theme"]) & F.exists(themes, lambda x: F.contains(x, want["theme"])), 35).otherwise(0)
    )
    nothing = ~asked(query) & ~asked(want["title"]) & ~asked(want["artist"]) & ~asked(want["theme"])
    return F.when(nothing, 10.0).otherwise(F.when(asked(query), by_title + by_artist + by_text + by_theme).otherwise(0.0) + fields)


def intent_score(query: Column, title: Column, artist: Column, base: Column, preview: Column, has_image: Column, has_album: Column, verified: Column, want_artist: Column | None = None) -> Column:
    """How well a result fits what a query means; ``query``, ``title``, ``artist`` and ``want_artist`` are normal forms."""
    terms, passage = t.search_terms(query), t.is_excerpt(query)
    equal = F.when(title == query, 95).when(F.contains(title, query) | F.contains(query, title), 52).otherwise(0)
    like = lambda c: sim.dice(c, query, normal=True)
    named = like(title) * 54 + like(artist) * 30 + like(F.concat_ws(" ", artist, title)) * 34 + like(F.concat_ws(" ", title, artist)) * 28
    covered = sim.term_coverage(F.concat_ws(" ", title, artist), terms) * F.when(passage, 26).otherwise(48)
    shown = F.when(t.is_generic_preview(preview), 0.0).otherwise(sim.term_coverage(t.normalized(preview), terms) * F.when(passage, 82).otherwise(22))
    extra = has_image.cast("int") * 3 + has_album.cast("int") * 2 + verified.cast("int") * 110
    by_query = F.when(query == "", 0.0).otherwise(equal + F.when(passage, 0.0).otherwise(named) + covered + shown)
    by_artist = F.lit(0.0)
    if want_artist is not None:
        near = sim.dice(artist, want_artist, normal=True)
        by_artist = F.when(F.coalesce(want_artist, F.lit("")) == "", 0.0).when(artist == want_artist, 72.0).when(F.contains(artist, want_artist) | F.contains(want_artist, artist), 48.0).otherwise(near * 34 - F.when(near < 0.42, 18).otherwise(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), base)) * 0.35 + by_query + by_artist + extra


def ranked(results: DataFrame, by: str, limit: int = 12) -> DataFrame:
    """The final list of each query: best relevance first, cut at the limit, without the columns that only ranking needs."""
    return top(results, by, [F.desc("relevance"), F.col("id")], limit).drop("relevance", "verified", "preview_norm")


def top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)

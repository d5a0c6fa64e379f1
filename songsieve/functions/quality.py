"""Quality of a text as lyrics: line figures, signals, score and confidence."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.functions.text import let, noise_hits, unaccented

#: Fixed patterns; all are matched on lower-cased text.
MARKER = r"(?:^|\n)\s*\[?\s*(?:verso|verse|refr[aã]o|coro|chorus|ponte|bridge|intro|outro|final|pré-refr[aã]o|pre-chorus)\b"
VOCABULARY = r"\b(?:senhor|jesus|deus|esp[ií]rito|louvor|adora|gra[cç]a|santo|aleluia|gl[oó]ria)\b"
LINKS = r"https?://"
NAVIGATION = r"\b(?:menu|login|home|newsletter|copyright)\b"
#: Fixed bonus of each way in which a text was found on a page.
METHOD_BONUS = {
    "dom-semantic": 22, "microdata": 20, "hydration-state": 18, "json-ld": 16, "json-embedded": 14, "dom-density": 10, "dom-readability": 16,
    "dom-cluster": 15, "baseline-rescue": 1, "cheerio-dom": 9, "heuristic-regex": 2, "api": 24, "database": 24,
}


#: Blanks as the SQL counterparts' patterns know them: no vertical tab among them.
BLANKS = " \t\n\f\r"


def ascii_words(pattern: str) -> str:
    """The pattern with word borders between ASCII letters, digits and underscores only."""
    return re.sub(r"\\b$", "(?![A-Za-z0-9_])", re.sub(r"^\\b", "(?<![A-Za-z0-9_])", pattern))


def rounded(c: Column, places: int) -> Column:
    """Half up, with ties that binary fractions miss by a hair counted as ties."""
    return F.floor(c * 10**places + 0.5 + 1e-7) / 10**places


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def metrics(text: Column, ls: Column | None = None) -> dict[str, Column]:
    """Line and word figures, unrounded; ``ls`` are the text's lines where they are at hand."""
    ls = lines(text) if ls is None else ls
    n = F.size(ls)
    # letters that Java's lower case changes by their place or into two
    low = lambda x: F.lower(F.translate(x, "\u0130\u03a3", "i\u03c3"))
    distinct = F.size(F.array_distinct(F.transform(ls, lambda x: F.regexp_replace(low(x), f"[{BLANKS}]+", " "))))
    ratio = F.when(n > 0, distinct / n).otherwise(0.0)
    return {
        "line_count": n,
        "word_count": F.size(F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")),
        "distinct_ratio": ratio,
        "duplicate_ratio": F.when(n > 0, 1 - ratio).otherwise(0.0),
        "mean_length": F.when(n > 0, F.aggregate(ls, F.lit(0), lambda s, x: s + F.length(x)) / n).otherwise(0.0),
        "short_ratio": F.when(n > 0, F.size(F.filter(ls, lambda x: F.length(x).between(3, 90))) / n).otherwise(0.0),
    }


def signs(text: Column) -> Column:
    """Struct (markers, vocabulary, noise, pagelike) of the signs that a text holds."""
    return let(F.lower(text), lambda low: _signs(text, low))


def _signs(text: Column, low: Column) -> Column:
    named = reduce(or_, (F.contains(low, F.lit(w)) for w in re.findall("[a-z]{2,}", NAVIGATION)))
    pagelike = F.regexp_count(text, F.lit(LINKS)) + F.when(named, F.regexp_count(low, F.lit(ascii_words(NAVIGATION)))).otherwise(0)
    return F.struct(F.regexp_count(low, F.lit(ascii_words(MARKER))).alias("markers"), low.rlike(ascii_words(VOCABULARY)).alias("vocabulary"), noise_hits(text).alias("noise"), pagelike.alias("pagelike"))


def signals(text: Column, short: Column | None = None) -> dict[str, Column]:
    """Score of lyric-like and page-like signs, with the names of those seen."""
    return signals_of(signs(text), metrics(text)["short_ratio"] if short is None else short)


def signals_of(seen_: Column, short: Column) -> dict[str, Column]:
    """The same from a text's ``signs`` and its share of short lines."""
    markers, vocabulary, noise, pagelike = (seen_[k] for k in ("markers", "vocabulary", "noise", "pagelike"))
    score = (
        F.least(F.lit(28), markers * 7) + F.when(short >= 0.72, 18).when(short >= 0.5, 8).otherwise(0) + F.when(vocabulary, 8).otherwise(0)
        - noise * 18 - F.when(pagelike >= 4, F.least(F.lit(36), pagelike * 4)).otherwise(0)
    )
    seen = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))
    return {
        "signal_score": score,
        "signals": seen(("section-markers", markers > 0), ("lyric-line-shape", short >= 0.72), ("gospel-vocabulary", vocabulary)),
        "warnings": seen(("page-noise-detected", noise > 0), ("navigation-like-text", pagelike >= 4)),
    }


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows with columns that are made once each: filters and later columns read them and never make them again."""
    made = rows.withColumn("__once", F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    return made.withColumns({k: F.col("__once")[k] for k in columns}).drop("__once")


def with_signals(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with their texts' ``signal_score``, ``signals`` and ``warnings``."""
    c = F.col(text)
    made = once(rows.withColumn("__lines", lines(c)), {"__signs": signs(c), "__short": metrics(c, F.col("__lines"))["short_ratio"]})
    return made.withColumns(signals_of(F.col("__signs"), F.col("__short"))).drop("__lines", "__signs", "__short")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


FIGURES = ("line_count", "word_count", "distinct_ratio", "mean_length", "short_ratio")


def with_figures(rows: DataFrame, text: str = "text") -> DataFrame:
    """The rows with what :func:`judged` needs of a text alone: its figures, ``char_count`` and signs, each made once."""
    c = F.col(text)
    out = rows.withColumn("__lines", lines(c))
    made = metrics(c, F.col("__lines"))
    return once(out, {k: made[k] for k in FIGURES} | {"char_count": F.length(c), "__signs": signs(c)}).drop("__lines")


def with_quality(rows: DataFrame, text: str = "text", link_chars: Column | None = None) -> DataFrame:
    """The rows with their texts' figures, ``quality`` (0 to 100), ``confidence`` and ``link_density``, rounded.

    Lines, figures, signals and score are columns of one step after the other, so each is made once.
    """
    return judged(with_figures(rows, text), link_chars)


def judged(out: DataFrame, link_chars: Column | None = None) -> DataFrame:
    """Rows of :func:`with_figures` with their quality."""
    density = clamp((F.lit(0) if link_chars is None else link_chars) / F.greatest(F.lit(1), F.col("char_count")), 0.0, 1.0)
    out = out.withColumns({"__signal": signals_of(F.col("__signs"), F.col("short_ratio"))["signal_score"], "__density": density, "duplicate_ratio": F.when(F.col("line_count") > 0, 1 - F.col("distinct_ratio")).otherwise(0.0)})
    m = {k: F.col(k) for k in (*FIGURES, "duplicate_ratio", "char_count")}
    distinct = F.round(m["distinct_ratio"] * m["line_count"])
    raw = (
        F.least(F.lit(38.0), m["char_count"] / 180) + F.least(F.lit(24.0), m["line_count"] * 1.15) + F.least(F.lit(16.0), m["word_count"] / 35) + m["distinct_ratio"] * 9
        + F.when(m["mean_length"].between(8, 90), 8).otherwise(0)
        - F.when((m["duplicate_ratio"] > 0.82) & (distinct <= 4) & (m["line_count"] >= 12), 18).when((m["duplicate_ratio"] > 0.7) & (distinct <= 7) & (m["line_count"] >= 16), 7).otherwise(0)
        - F.col("__density") * 70 + F.col("__signal")
    )
    out = out.withColumn("__score", clamp(raw, 0.0, 100.0))
    confidence = clamp(0.08 + F.col("__score") / 100 * 0.78 + F.least(F.lit(0.12), F.col("line_count") / 250), 0.0, 0.99)
    return out.withColumns({"quality": rounded(F.col("__score"), 2), "confidence": rounded(confidence, 3), "link_density": rounded(F.col("__density"), 3)}).drop("__signs", "__signal", "__density", "__score")


def method_bonus(method: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in METHOD_BONUS.items() for x in pair])
    return F.coalesce(table[method], F.lit(0))


def big_enough() -> Column:
    """Whether a text with figures may be a candidate."""
    return (F.col("char_count") >= 45) & (F.col("word_count") >= 10) & (F.col("line_count") >= 2)


def with_candidate_score(rows: DataFrame) -> DataFrame:
    """Rows (text, method, link_chars, bonus) with their quality and ``score`` (0 to 140), null where a text is too small."""
    return candidates_judged(with_figures(rows, "text"))


def candidates_judged(rows: DataFrame) -> DataFrame:
    """Rows (method, link_chars, bonus) of :func:`with_figures` with their quality and ``score``."""
    out = judged(rows, F.col("link_chars"))
    score = F.col("quality") + method_bonus(F.col("method")) + F.col("bonus") + F.when(F.col("char_count").between(250, 20_000), 6).otherwise(0) + F.when(F.col("line_count").between(8, 180), 8).otherwise(0) - F.when(F.col("link_density") > 0.28, 18).otherwise(0)
    return out.withColumn("score", F.when(big_enough(), clamp(score, 0.0, 140.0)))


def block_score(text: Column, density: Column) -> Column:
    """Weight of one block for the reading passes over a page; its lines are cut once."""
    return let(lines(text), lambda ls: _block_score(text, density, metrics(text, ls), ls))


def _block_score(text: Column, density: Column, m: dict[str, Column], ls: Column) -> Column:
    short = F.when(m["line_count"] > 0, F.size(F.filter(ls, lambda x: F.length(x).between(2, 92))) / m["line_count"]).otherwise(0.0)
    stops = F.least(F.lit(8.0), F.regexp_count(text, F.lit("[,;:]")) * 0.65 + F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")) * 0.35)
    score = (
        1 + F.least(F.lit(4.0), F.length(text) / 180) + F.least(F.lit(6.0), m["line_count"] * 0.55) + stops + short * 10
        + F.least(F.lit(12), F.regexp_count(F.lower(text), F.lit(r"(?:^|\n)\s*\[?\s*(?:verso|verse|refr[aã]o|coro|chorus|ponte|bridge|intro|outro|final|tag)(?![A-Za-z0-9_])")) * 4)
        - density * 32 - noise_hits(text) * 12 - F.when(m["mean_length"] > 150, 7).otherwise(0)
    )
    return F.when((m["word_count"] < 4) | (F.length(text) < 20), F.lit(-20.0)).otherwise(score)


def final_confidence(confidence: Column, signals_: Column, warnings_: Column, method: Column) -> Column:
    """Confidence of a winner, raised by agreement and a strong method, lowered by warnings."""
    up = F.when(F.array_contains(signals_, "multi-parser-consensus"), 0.05).otherwise(0.0) + F.when(F.array_contains(signals_, "cross-extractor-consensus"), 0.04).otherwise(0.0)
    strong = F.when(method.isin("dom-semantic", "microdata"), 0.05).when(method.isin("hydration-state", "json-ld"), 0.03).otherwise(0.0)
    return rounded(clamp(confidence + up + strong - F.least(F.lit(0.16), F.size(warnings_) * 0.05), 0.0, 0.995), 3)


def canonical_lines(text: Column) -> Column:
    """Distinct normal lines of at least four characters without section markers."""
    plain = F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(F.regexp_replace(unaccented(x), "[^a-z0-9]+", " ")))
    return F.array_distinct(F.filter(plain, lambda x: (F.length(x) >= 4) & ~x.rlike(r"^(?:verso|verse|refrao|coro|chorus|ponte|bridge|intro|outro|final|tag)\s*\d*$")))

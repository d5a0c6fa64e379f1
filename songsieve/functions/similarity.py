"""Similarity columns for pairs that a join has already brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.functions.text import comparable, let, normalized, search_terms


def bigrams(n: Column) -> Column:
    """Consecutive character pairs of a text, none where it has fewer than two characters."""
    return F.regexp_extract_all(n, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(..))"), F.lit(1))


def dice(left: Column, right: Column, normal: bool = False) -> Column:
    """Dice coefficient of the bigram multisets of two titles or names (``normal``: already in normal form).

    Both forms and their bigrams are made once a pair; only bigrams that both sides repeat are counted.
    """
    if not normal:
        return let(normalized(left), lambda a: let(normalized(right), lambda b: dice(a, b, normal=True)))
    a, b = left, right
    count = lambda grams, g: F.size(grams) - F.size(F.array_remove(grams, g))
    single = lambda grams: F.size(F.array_distinct(grams)) == F.size(grams)

    def overlap(ga: Column, gb: Column) -> Column:
        each = lambda common: F.aggregate(common, F.lit(0), lambda s, g: s + F.least(count(ga, g), count(gb, g)))
        return let(F.array_intersect(ga, gb), lambda common: F.when(single(ga) | single(gb), F.size(common)).otherwise(each(common)))

    shared = let(bigrams(a), lambda ga: let(bigrams(b), lambda gb: 2.0 * overlap(ga, gb) / (F.size(ga) + F.size(gb))))
    contained = F.contains(a, b) | F.contains(b, a)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when((F.length(a) < 3) | (F.length(b) < 3), F.when(contained, 0.85).otherwise(0.0)).otherwise(shared)


def term_coverage(text: Column, terms: Column) -> Column:
    """Share of the terms that the normal text holds as substrings; the text is made once."""
    held = let(text, lambda whole: F.size(F.filter(terms, lambda t: F.contains(whole, t))))
    return F.when(F.size(terms) > 0, held / F.size(terms)).otherwise(0.0)


def ordered_coverage(text: Column, terms: Column) -> Column:
    """Share of the terms found from left to right, each after the one before: in a word of the text, or a word in the term.

    The text is searched as a string. Words that lie in a term are picked from its distinct words once, so work
    grows with the text and not with words times terms.
    """

    def found(tokens: Column) -> Column:
        joined = F.array_join(terms, " ")
        within = let(joined, lambda whole: F.filter(F.array_distinct(tokens), lambda t: F.contains(whole, t)))
        return let(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), lambda line: let(within, lambda short: in_order(line, short, terms)))

    return F.when(F.size(terms) > 0, let(F.array_remove(F.split(text, " "), ""), found)).otherwise(0.0)


def in_order(line: Column, short: Column, terms: Column) -> Column:
    """:func:`ordered_coverage` of a text given as its words between blanks and those of them that lie in a term."""

    def step(acc: Column, term: Column) -> Column:
        after = lambda part: F.nullif(F.position(part, line, acc["cursor"]), F.lit(0))
        words = F.transform(F.filter(short, lambda t: F.contains(term, t)), lambda t: after(F.concat(F.lit(" "), t, F.lit(" "))))
        # the cursor is the blank after the word that was found
        to = lambda at: F.struct(F.when(at.isNull(), acc["cursor"]).otherwise(F.position(F.lit(" "), line, at)).alias("cursor"), (acc["found"] + at.isNotNull().cast("int")).alias("found"))
        return let(F.least(after(term), F.array_min(words) + 1), to)

    zero = F.struct(F.lit(1).alias("cursor"), F.lit(0).alias("found"))
    return F.when(line.isNotNull(), F.aggregate(terms, zero, step, lambda acc: acc["found"] / F.size(terms)))


def title_similarity(left: Column, right: Column) -> Column:
    """1 for equal titles, the ratio of lengths for contained ones, else the overlap of words; version words do not count."""
    return let(comparable(left), lambda a: let(comparable(right), lambda b: comparable_similarity(a, b)))


def comparable_similarity(a: Column, b: Column) -> Column:
    """The same of two titles in comparable form."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(F.contains(a, b) | F.contains(b, a), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b)))
        .otherwise(F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb)))
    )


def same_song(title_a: Column, artist_a: Column, title_b: Column, artist_b: Column) -> Column:
    """Confidence that two records are one song."""
    return dice(title_a, title_b) * 0.72 + dice(artist_a, artist_b) * 0.28


def matches_request(want_title: Column, want_artist: Column, title: Column, artist: Column) -> Column:
    """Whether a fetched song is the one that was asked for."""
    t, a = normalized(want_title) != "", normalized(want_artist) != ""
    return (
        F.when(t & a, same_song(want_title, want_artist, title, artist) >= 0.68)
        .when(t, dice(title, want_title) >= 0.72)
        .when(a, dice(artist, want_artist) >= 0.58)
        .otherwise(True)
    )


def once(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """The rows with a column behind a generator, so that no later column makes it again."""
    return rows.withColumn(name, F.explode(F.array(column)))


def with_best_window(rows: DataFrame, out: str, lines: str, asked: str, terms: str, only_matched: bool = False, normal: bool = False) -> DataFrame:
    """The rows with the window of one to four lines that fits a passage best, as a struct column
    (score, coverage, ordered, exact, start, size, matched).

    The named columns hold a text's lines and the passage's normal form and terms. Null where there
    are no terms or no lines; windows of equal score go by place and size. Terms are words of the
    passage, so a window holds those that its lines hold, told once a line, and one with the whole
    passage holds all. Order and likeness add 0.42 at most, by a window's length mostly less, so they are
    only looked at in windows whose coverage is that near to the best. ``only_matched`` drops rows without
    a match, most before that: a match holds its share of the terms, and in order;
    ``normal``: the lines are already in normal form.
    """
    ls, asked_, terms_ = F.col(lines), F.col(asked), F.col(terms)
    n, many = F.size(ls), F.size(terms_)
    # a window's normal form is that of its lines, each made once, joined
    places = F.sequence(F.lit(1), many)
    hits = F.transform("__n", lambda x: F.filter(places, lambda i: F.contains(x, F.element_at(terms_, i))))
    span = lambda i, s: F.struct(i.alias("start"), s.alias("size"), (F.size(F.array_distinct(F.flatten(F.slice("__h", i, s)))) / many).alias("coverage"))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), n - i + 1)), lambda s: span(i, s))))

    def partial(w: Column) -> Column:
        return let(F.array_join(F.array_remove(F.slice("__n", w["start"], w["size"]), ""), " "), lambda text: figures(w, text))

    def figures(w: Column, text: Column) -> Column:
        exact = (F.length(asked_) >= 8) & F.contains(text, asked_)
        compact = F.least(F.lit(1.0), F.length(asked_) / F.greatest(F.length(text), F.length(asked_)))
        words = F.array_distinct(F.flatten(F.slice("__k", w["start"], w["size"])))
        ordered = let(F.concat(F.lit(" "), text, F.lit(" ")), lambda line: let(words, lambda short: in_order(line, short, terms_)))
        made = let(ordered, lambda o: F.struct((F.when(exact, 1.25).otherwise(0.0) + w["coverage"] * 0.62 + o * 0.28 + compact * 0.04).alias("score"), o.alias("ordered")))
        return let(made, lambda m: F.struct(m["score"].alias("score"), w["start"].alias("start"), w["size"].alias("size"), text.alias("n"), w["coverage"].alias("coverage"), m["ordered"].alias("ordered"), exact.alias("exact")))

    def whole(w: Column) -> Column:
        return F.struct((w["score"] + dice(w["n"], asked_, normal=True) * 0.10).alias("score"), (-w["start"]).alias("before"), (-w["size"]).alias("short"), w["coverage"].alias("coverage"), w["ordered"].alias("ordered"), w["exact"].alias("exact"))

    def extra(w: Column) -> Column:
        """The most that order, length and likeness add to a window's score."""
        chars = F.length(F.array_join(F.array_remove(F.slice("__n", w["start"], w["size"]), ""), " "))
        low, high = (lambda c: F.least(c, F.length(asked_))), (lambda c: F.greatest(c, F.length(asked_)))
        like = lambda c: F.when(low(c) < 3, 1.0).otherwise(2 * low(c) / (low(c) + high(c)))
        return let(chars, lambda c: 0.28 + F.least(F.lit(1.0), F.length(asked_) / high(c)) * 0.04 + like(c) * 0.10)

    highest = lambda c, k: F.array_max(F.transform(c, lambda x: x[k]))
    # each step is a column of its own, made once a row
    made = rows.withColumn("__n", F.when((asked_ != "") & (many > 0) & (n > 0), ls if normal else F.transform(ls, normalized)))
    least = F.when(many <= 2, 1.0).when(many == 3, 0.78).otherwise(0.66)
    fits = lambda x: x["exact"] | (x["coverage"] >= least) & (x["ordered"] >= F.greatest(F.lit(0.55), least - 0.08))
    first = least if only_matched else F.col("__c")
    near = lambda w: (w["coverage"] < first) & (w["coverage"] * 0.62 + 0.42 >= F.col("__s") - 1e-9)
    inner = F.transform("__n", lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda w: (w != "") & F.contains(F.col("__j"), w)))
    for name, column in (
        ("__h", hits), ("__w", F.when(F.col("__n").isNotNull(), windows)), ("__c", highest("__w", "coverage")), ("__j", F.array_join(terms_, " ")), ("__k", inner),
        ("__p", F.transform(F.filter("__w", lambda w: w["coverage"] >= first), partial)), ("__s", highest("__p", "score")),
        ("__q", F.transform(F.filter("__w", lambda w: F.when(near(w), w["coverage"] * 0.62 + extra(w) >= F.col("__s") - 1e-9).otherwise(False)), partial)),
    ):
        made = once(made, name, column)
        if only_matched and name == "__c":  # a window with the whole passage holds all of its terms
            made = made.where(F.col("__c") >= least)
        if only_matched and name == "__p":
            made = made.where(F.exists("__p", fits))
    made = once(made, "__p", F.concat("__p", "__q"))
    made = made.withColumn("__top", highest("__p", "score"))
    made = made.withColumn("__b", F.array_max(F.transform(F.filter("__p", lambda x: x["score"] >= F.col("__top") - 0.1), whole)))
    # a generator, so that filters on the result are not pushed below and the windows made again for them
    made = made.withColumn("__best", F.explode(F.array("__b")))
    b = F.col("__best")
    matched = fits(b)
    best = F.struct(*[b[c].alias(c) for c in ("score", "coverage", "ordered", "exact")], (-b["before"]).alias("start"), (-b["short"]).alias("size"), matched.alias("matched"))
    made = made.where(matched) if only_matched else made
    return made.withColumn(out, F.when(b.isNotNull(), best)).drop("__n", "__h", "__w", "__c", "__j", "__k", "__p", "__s", "__q", "__top", "__b", "__best")


__all__ = ["bigrams", "dice", "matches_request", "ordered_coverage", "same_song", "search_terms", "term_coverage", "title_similarity", "with_best_window"]

"""Building blocks of the SQL counterparts."""

from __future__ import annotations

from songsieve.functions.text import NOISE, STOPWORDS, VERSION_WORDS


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_filter(string_split({norm(x)}, ' '), lambda w: length(w) > 1 AND w NOT IN ({stop})), lambda t, i: list_position(list_filter(string_split({norm(x)}, ' '), lambda w: length(w) > 1 AND w NOT IN ({stop})), t) = i)"


def distinct_terms(x: str) -> str:
    """The terms in no certain order."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: length(w) > 1 AND w NOT IN ({stop})))"


def comparable(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({norm(x)}, '\b(?:{VERSION_WORDS})\b', ' ', 'g'), '\s+', ' ', 'g'))"


def noise(x: str) -> str:
    return " + ".join(f"CAST(regexp_matches({x}, '(?i){p}') AS INTEGER)" for p in NOISE)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def bigram_counts(n: str) -> str:
    return f"list_transform(range(1, length({n})), lambda i: substr({n}, i, 2))"


def dice(a: str, b: str) -> str:
    """Dice of two normal forms given as SQL."""
    ga, gb = bigram_counts(a), bigram_counts(b)
    overlap = f"coalesce(list_sum(list_transform(list_distinct({ga}), lambda g: least(len(list_filter({ga}, lambda x: x = g)), len(list_filter({gb}, lambda x: x = g))))), 0)"
    return (
        f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN length({a}) < 3 OR length({b}) < 3 THEN CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.85 ELSE 0.0 END"
        f" ELSE 2.0::DOUBLE * {overlap} / (length({a}) + length({b}) - 2) END)::DOUBLE"
    )

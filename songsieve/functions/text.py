"""Text columns: normal forms, keys and small predicates, all native expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed word list: words that carry no meaning in a search (Portuguese and English).
STOPWORDS = (
    "a o as os de da do das dos e em no na nos nas um uma uns umas que pra para por com me te se eu tu"
    " ele ela meu minha meus minhas seu sua seus suas ao aos the and of to in my you your is it"
).split()
#: Fixed patterns of page furniture in a text.
NOISE = (
    r"pol[ií]tica de privacidade", r"termos de uso", r"aceitar cookies?", r"gerenciar cookies?", r"publicidade",
    r"fa[cç]a login", r"cadastre-se", r"todos os direitos reservados", r"compartilhe nas redes", r"download (?:our|the) app",
)
#: Fixed patterns of pages that ask for a human.
ANTI_BOT = (r"cf-chl-", r"cloudflare.*(?:challenge|ray id)", r"just a moment\.\.\.", r"verify you are human", r"captcha", r"access denied", r"enable javascript and cookies")


def _accents() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from canonical decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def unaccented(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def normalized(c: Column) -> Column:
    """Lower case, no accents, only letters, digits and single spaces; null gives the empty text."""
    return F.trim(F.regexp_replace(unaccented(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def code_point(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def numeric_entities_decoded(c: Column) -> Column:
    """Decimal and hexadecimal character references replaced; those out of range removed."""
    entities = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?i)&#x?[0-9a-f]+;"), F.lit(0)))

    def value(e: Column) -> Column:
        digits = F.regexp_extract(e, r"(?i)&#x?([0-9a-f]+);", 1)
        is_hex = F.lower(F.substring(e, 3, 1)) == "x"
        return F.when(is_hex, F.conv(digits, 16, 10)).when(digits.rlike("^[0-9]+$"), digits).cast("decimal(38,0)")

    def step(acc: Column, e: Column) -> Column:
        n = value(e)
        put = F.when(n.between(0, 0x10FFFF), code_point(n.cast("long"))).otherwise("")
        return F.when(n.isNull(), acc).otherwise(F.replace(acc, e, put))

    return F.aggregate(entities, c, step)


def lyrics_normalized(c: Column) -> Column:
    """Entities decoded, blanks around line ends dropped, runs of blanks and of blank lines shortened."""
    out = numeric_entities_decoded(c)
    for pattern, put in ((r" ", " "), (r"\r", ""), (r"(?<![ \t])[ \t]++\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{4,}", "\n\n\n")):
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def html_cleaned(c: Column) -> Column:
    """A lyrics field with simple markup as text."""
    out = c
    for pattern, put in (
        (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)<p[^>]*>", ""), (r"(?i)&nbsp;", " "), (r"(?i)&amp;", "&"),
        (r"(?i)&quot;", '"'), (r"(?i)&apos;", "'"), (r"<[^>]*>", ""), (r"\r", ""), (r"\n{3,}", "\n\n"),
    ):
        out = F.regexp_replace(out, pattern, put)
    return F.regexp_replace(out, r"^\s+|\s+$", "")


#: Two noncharacters that stand for ``<`` where an opening has no end.
UNPAIRED = "\ufdd0\ufdd1"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def paired(c: Column, tags: tuple[str, ...]) -> Column:
    """A page in which each opening of the tags that no end follows begins with a mark instead of ``<``.

    A pattern from an opening to its end then never looks through a page in vain.
    """

    def marked(tag: str) -> Callable[[Column], Column]:
        put = lambda page, head, tail: F.when(F.contains(F.lower(tail), F.lit(f"<{tag}")), F.concat(head, F.regexp_replace(tail, rf"(?i)<(?={tag}\b)", UNPAIRED))).otherwise(page)
        return lambda page: let(F.regexp_extract(page, rf"(?is)^.*</{tag}>", 0), lambda head: let(F.substr(page, F.length(head) + 1), lambda tail: put(page, head, tail)))

    for tag in tags:
        c = let(c, marked(tag))
    return c


def unpaired(c: Column) -> Column:
    return F.replace(c, F.lit(UNPAIRED), F.lit("<"))


def tags_dropped(c: Column) -> Column:
    """The text without tags; what follows the last ``>`` holds none and is not searched."""
    dropped = lambda page, head: F.concat(F.regexp_replace(head, r"<[^>]+>", ""), F.substr(page, F.length(head) + 1))
    return let(c, lambda page: let(F.regexp_extract(page, r"(?s)^.*>", 0), lambda head: dropped(page, head)))


def html_stripped(c: Column) -> Column:
    """A page as text: scripts dropped, block ends as line ends, tags removed, lyrics normal form."""
    hidden = ("script", "style", "noscript", "template")
    out = unpaired(F.regexp_replace(paired(c, hidden), rf"(?is)<({'|'.join(hidden)})\b[^<>]*+>.*?</\1>", ""))
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|section|article|h[1-6]|pre|blockquote)>", "\n")
    return lyrics_normalized(named_entities_decoded(tags_dropped(out)))


#: Fixed values of the named references that texts of songs use.
NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def named_entities_decoded(c: Column) -> Column:
    for name, put in NAMED:
        c = F.replace(c, F.lit(name), F.lit(put))
    return c


def search_terms(c: Column, most: int | None = None) -> Column:
    """Distinct words of the normal form, longer than one letter and not stopwords, in order."""
    words = F.filter(F.split(normalized(c), " "), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
    out = F.array_distinct(words)
    return F.slice(out, 1, most) if most else out


def slug(c: Column) -> Column:
    """A URL part: lower case, no accents, ``&`` as ``e``, other characters as single dashes."""
    out = F.regexp_replace(F.replace(F.lower(unaccented(c)), F.lit("&"), F.lit(" e ")), r"[^a-z0-9]+", "-")
    return F.regexp_replace(out, r"^-+|-+$", "")


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters' code points, in base 36."""
    basis = F.lit(2166136261).cast("long")
    h = F.aggregate(F.split(c, ""), basis, lambda h, x: h.bitwiseXOR(F.ascii(x).cast("long")) * F.lit(16777619) % F.lit(4294967296))
    return F.lower(F.conv(F.when(c == "", basis).otherwise(h).cast("string"), 10, 36))


def fingerprint(c: Column) -> Column:
    """Length and hash of the whole normal form; equal for texts that differ in case, accents or marks."""
    plain = F.trim(F.regexp_replace(unaccented(F.lower(c)), "[^a-z0-9]+", " "))
    return let(plain, lambda x: F.concat_ws(":", F.length(x).cast("string"), fnv1a(x)))


def identity(title: Column, artist: Column) -> Column:
    """Key of a song: title without version words, artist without guests."""
    t = F.trim(F.regexp_replace(normalized(title), r"\b(ao vivo|live|lyrics|letra|official|video oficial|clipe oficial)\b", ""))
    a = F.trim(F.regexp_replace(normalized(artist), r"\b(feat|ft)\b.*$", ""))
    return F.concat(t, F.lit("|"), a)


def timestamps_stripped(c: Column) -> Column:
    """Plain lyrics from synchronised ones: time stamps at the beginning of lines dropped."""
    return lyrics_normalized(F.regexp_replace(c, r"(?m)^[^\S\n]*+(?:\[[0-9]{1,3}:[0-9]{2}(?:[.:][0-9]{1,3})?\])++[^\S\n]*", ""))


def search_normalized(c: Column) -> Column:
    """The normal form of a text whose entities and blanks are put in order before; it tells only where there are such."""
    c = F.coalesce(c, F.lit(""))
    return normalized(F.when(c.rlike("&#|\r"), lyrics_normalized(c)).otherwise(c))


#: Fixed words that tell versions of one song apart.
VERSION_WORDS = "ao vivo|live|acustico|remaster(?:ed)?|versao|radio edit|single|official|video|clipe"


def comparable(c: Column) -> Column:
    """A title's normal form without words that name its version."""
    return F.trim(F.regexp_replace(F.regexp_replace(search_normalized(c), rf"\b(?:{VERSION_WORDS})\b", " "), r"\s+", " "))


def title_and_artist(heading: Column, url: Column) -> Column:
    """Struct (title, artist) read from a page's heading, else from the parts of its address.

    The heading may say ``title by artist`` or part the two by a dash or a bar; what a site
    appends to it is dropped.
    """
    raw = F.regexp_replace(named_entities_decoded(numeric_entities_decoded(F.coalesce(heading, F.lit("")))), r"(?i)\s*[-|]\s*(letras(?:\.mus\.br|\.com)?|vagalume).*$", "")
    raw = F.trim(F.regexp_replace(raw, r"(?i)\s+lyrics\s*$", ""))
    named = r"(?i)^(.+?)\s+(?:by|por)\s+(.+)$"
    parts = F.filter(F.transform(F.split(raw, r"\s[-–—|]\s"), lambda p: F.trim(p)), lambda p: p != "")
    path = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda p: p != "")
    raised = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, F.length(w)))
    pretty = lambda c: F.array_join(F.transform(F.split(F.regexp_replace(F.try_url_decode(c), "[-_]+", " "), " "), raised), " ")
    slug_artist, slug_title = F.coalesce(pretty(F.get(path, F.lit(0))), F.lit("Artista")), F.coalesce(pretty(F.get(path, F.lit(1))), F.lit("Música"))
    pair = lambda t, a: F.struct(t.alias("title"), a.alias("artist"))
    return (
        F.when(raw.rlike(named), pair(F.trim(F.regexp_extract(raw, named, 1)), F.trim(F.regexp_extract(raw, named, 2))))
        .when(F.size(parts) >= 2, pair(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
        .otherwise(pair(F.when(raw != "", raw).otherwise(slug_title), slug_artist))
    )


def is_excerpt(c: Column) -> Column:
    """Whether a query looks like a passage rather than a title or an artist."""
    n = normalized(c)
    words = F.size(F.filter(F.split(n, " "), lambda w: w != ""))
    return (words >= 5) | (F.size(search_terms(c)) >= 5) | ((words >= 4) & (F.length(n) >= 26))


def is_generic_preview(c: Column) -> Column:
    n = normalized(c)
    return (n == "") | n.rlike("resultado encontrado|toque para carregar|disponivel na biblioteca|indice de busca|api personalizada")


def error_code(name: Column, message: Column) -> Column:
    """Class of a source's failure."""
    n, m = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(n.rlike("timeout|abort") | m.rlike("tempo limite|timeout"), "TIMEOUT")
        .when(m.rlike(r"http\s+\d{3}"), F.concat(F.lit("HTTP_"), F.regexp_extract(m, r"http\s+(\d{3})", 1)))
        .when(m.rlike("getaddrinfo|dns|name resolution"), "DNS")
        .when(F.contains(m, F.lit("json")), "INVALID_JSON")
        .when(m.rlike("host n[ãa]o autorizado"), "HOST_REJECTED")
        .otherwise("UPSTREAM_ERROR")
    )


def plain_part(pattern: str, most: int = 12) -> str:
    """A piece of a pattern that stands in all that it matches: its longest without classes, groups and options."""
    return max(re.split(r"\[[^]]*\]|\([^)]*\)|.\?", pattern), key=len)[:most]


def noise_hits(c: Column) -> Column:
    """How many kinds of page furniture a text holds; a pattern is tried only where its plain part is seen."""
    held = lambda low, p: (F.contains(low, F.lit(plain_part(p))) & c.rlike(f"(?i){p}")).cast("int")
    return let(F.lower(c), lambda low: sum((held(low, p) for p in NOISE), F.lit(0)))


def asks_for_human(c: Column, most: int = 180_000) -> Column:
    """Whether the head of a page is a challenge instead of content."""
    return F.left(c, F.lit(most)).rlike("(?i)" + "|".join(f"(?:{p})" for p in ANTI_BOT))


def js_string_decoded(c: Column) -> Column:
    """The value of an embedded string literal's inside."""
    strict = F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0]
    loose = c
    for a, b in (("\\n", "\n"), ("\\r", ""), ("\\t", "\t"), ("\\/", "/"), ('\\"', '"')):
        loose = F.replace(loose, F.lit(a), F.lit(b))
    return F.coalesce(strict, loose)


def preview(c: Column, query: Column, size: int = 180) -> Column:
    """A window of the text around the first query term it holds, with ellipses where it was cut."""

    def cut(text: Column) -> Column:
        places = let(F.lower(text), lambda low: F.filter(F.transform(search_terms(query), lambda t: F.instr(low, t)), lambda p: p > 0))
        start = let(places, lambda ps: F.when(F.size(ps) > 0, F.greatest(F.lit(0), ps[0] - 1 - F.lit(int(size * 0.32)))).otherwise(0))
        return let(start, lambda s: F.concat(F.when(s > 0, F.lit("…")).otherwise(""), F.trim(F.substring(text, s + 1, F.lit(size))), F.when(s + size < F.length(text), F.lit("…")).otherwise("")))

    return let(F.trim(F.regexp_replace(c, r"\s+", " ")), lambda text: F.when(F.length(text) <= size, text).otherwise(cut(text)))

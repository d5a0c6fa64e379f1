r"""Personal data, with DataFrame functions only.

Regular expressions propose spans, leftmost and non-overlapping per kind. Validators confirm them:
Luhn for cards, mod-97 for IBANs, the weighted sum of bank routing numbers, ranges of the parts of
addresses. Every confirmed span gets a score: the kind's prior, raised by words of the kind nearby and
lowered by words that mark a made-up value. A span stays with a score of ``LEAST`` or more; the priors of
the base kinds are so high that their spans always stay, the others need a checksum or their context.

Nearby means the last and first ``NEAR`` code points of the text before and after a match, as far as the
neighbouring match of the same kind. Each pattern is linear in the text: runs are matched possessively and
entered at their start only. Offsets are running sums made in blocks, so a text of n matches takes about
n * ``BLOCK`` steps.

Defined cases: a null text is an empty one; an empty text has no span; rows that repeat an id are searched
each on its own text; other columns pass unread or, if not named in ``keep``, take no part, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a match's surroundings that are read for context words.
NEAR = 40
#: Least score of a span.
LEAST = 50
#: What a word of the kind adds, and what a word that marks a made-up value takes away.
RAISED, LOWERED = 25, 15
#: Prefix sums are made over stretches of so many matches.
BLOCK = 64

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Length of an IBAN by country, from its public registry.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29, ES=24, FI=18, FO=18, FR=27,
    GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20, LB=28, LI=21, LT=20, LU=20, LV=21, MC=27, MD=24, ME=22,
    MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25, QA=29, RO=24, RS=22, SA=24, SE=24, SI=19, SK=24, SM=27, TN=24, TR=26, UA=29, VA=22, XK=20,
)


def _iban_regex() -> str:
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    return "(?:" + "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by_length.items())) + ")"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number, its first four signs moved to the end and letters as 10 to 35, is 1 modulo 97."""
    bare = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return (a * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def routing_sum(digits: Column) -> Column:
    """Whether nine digits weighted by 3, 7, 1 in turn have a sum divisible by ten."""
    value = lambda c, i: c.cast("int") * F.element_at(F.array(F.lit(3), F.lit(7), F.lit(1)), i % 3 + 1)
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits_of(match)).between(least, most)


def _card(match: Column) -> Column:
    digits = digits_of(match)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))


IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SSN_WRONG = "^(?:000|666|9)|-00-|-0000$"
DATE = r"(?:0[1-9]|[12][0-9]|3[01])[./-](?:0[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    ``plain`` is its pattern in portable form, ``regex`` the same matches in linear time on the JVM;
    ``valid`` confirms a match; ``apart``: no letter or digit may touch it.
    """

    name: str
    plain: str
    regex: str
    prior: int
    context: str
    valid: Callable[[Column], Column] | None = None
    apart: bool = False


#: Base kinds, in the order in which ties are listed.
BASE = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 70, "mail|e-mail|email|contact|write|kontakt|courriel|correo"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 65, "ip|host|server|address|adresse|client", lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", 70, "card|credit|visa|payment|karte|carte|tarjeta", _card),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 65, "phone|tel|call|mobile|fax|telefon|telephone|telefono", _between(10, 15)),
)
#: Kinds that stay by a checksum or by their context.
MORE = (
    Kind("iban", _iban_regex(), "(?=[A-Z]{2}[0-9]{2})" + _iban_regex(), 60, "iban|account|bank|konto|compte|cuenta", mod97, True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, "ssn|social security|tax id|taxpayer", lambda m: ~m.rlike(SSN_WRONG), True),
    Kind("birth", DATE, DATE, 30, "born|birth|birthday|dob|geboren|geburtsdatum|naissance|nacimiento|nacido|nacida", None, True),
    Kind("routing", r"[0-9]{9}", r"[0-9]{9}", 30, "routing|aba|wire transfer", routing_sum, True),
)
KINDS = BASE + MORE
MADE_UP = "example|sample|dummy|placeholder|fake|test"


def word_regex(words: str) -> str:
    """Any of the words, with no letter on either side, in text whose A-Z are lowered."""
    return f"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def _sums(xs: Column, start: Column) -> Column:
    """Running sums of a short array."""
    zero = F.struct(start.alias("sum"), F.array().cast("array<int>").alias("all"))
    step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["all"], F.array(a["sum"] + x)).alias("all"))
    return F.aggregate(xs, zero, step, lambda a: a["all"])


def running_sums(xs: Column) -> Column:
    """Running sums of a non-empty array of integers, made block by block."""

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), F.lit(BLOCK)), lambda i: F.slice(x, i, F.lit(BLOCK)))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        before = _let(totals, lambda t: F.zip_with(_sums(t, F.lit(0)), t, lambda s, x: s - x))
        return F.flatten(F.zip_with(blocks, before, _sums))

    return _let(xs, of)


SPAN = "array<struct<start:int,rank:int,kind:string,stop:int,score:int>>"


def _located(text: Column, rank: int, kind: Kind) -> Column:
    """The kind's confirmed spans in a text that holds a match of its pattern."""

    def assembled(part: Column) -> Column:
        matches, pieces = part["matches"], part["pieces"]
        rows = F.arrays_zip(matches.alias("match"), F.slice(pieces, F.lit(1), F.size(matches)).alias("before"), F.slice(pieces, F.lit(2), F.size(matches)).alias("after"))
        return _let(rows, lambda r: F.zip_with(r, running_sums(F.transform(r, lambda x: F.length(x["before"]) + F.length(x["match"]))), judged))

    def judged(row: Column, stop: Column) -> Column:
        near = F.translate(F.concat_ws(" ", F.right(row["before"], F.lit(NEAR)), F.left(row["after"], F.lit(NEAR))), UPPER, LOWER)
        ok = kind.valid(row["match"]) if kind.valid is not None else F.lit(True)
        if kind.apart:
            ok = ~F.right(row["before"], F.lit(1)).rlike("[A-Za-z0-9]") & ~F.left(row["after"], F.lit(1)).rlike("[A-Za-z0-9]") & ok
        score = F.lit(kind.prior) + F.when(near.rlike(word_regex(kind.context)), RAISED).otherwise(0) - F.when(near.rlike(word_regex(MADE_UP)), LOWERED).otherwise(0)
        return F.struct(
            (stop - F.length(row["match"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), stop.alias("stop"), F.when(ok, score).otherwise(F.lit(0)).alias("score")
        )

    part = F.struct(F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)).alias("matches"), F.split(text, kind.regex, -1).alias("pieces"))
    return F.filter(_let(part, assembled), lambda s: s["score"] >= LEAST)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds=KINDS, keep: tuple[str, ...] = (), out: str = "found") -> DataFrame:
    """Every row's ``keep`` columns, key and text with ``out``: sorted structs (start, rank, kind, stop, score).

    Spans are leftmost and non-overlapping per kind; kinds may overlap each other.
    """
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    base = docs.select(kept.alias("__keep"), F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    t, none = F.col("__text"), F.array().cast(SPAN)
    per_kind = [F.when(t.rlike(k.regex), _located(t, n, k)).otherwise(none).alias(f"__s{n}") for n, k in enumerate(kinds)]
    each = base.select("__keep", "__key", "__text", *per_kind)
    found = F.array_sort(F.concat(*[F.col(f"__s{n}") for n in range(len(kinds))]))
    return each.select(*[F.col("__keep")[c].alias(c) for c in keep], F.col("__key").alias(key), F.col("__text").alias(text), found.alias(out))

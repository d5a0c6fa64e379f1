"""Secret scans over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that any
match must contain. Postings (trigram, document) of the rules' trigrams are intersected
by an aggregation; only the documents left are verified with the expression itself.
A rule without mandatory trigrams (long hex runs) scans every text.

Defined cases: a null text is an empty one; an empty text has no span; rows that repeat
an id are scanned each on its own text; a null id joins null-safely; other columns of
the input do not take part, so clashing names are harmless.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.llm.common import small, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and a group that must reach a least length."""

    name: str
    regex: str
    group: int = 0
    least: int = 0


#: Base kinds, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Further kinds of credentials with fixed public prefixes.
MORE = (
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("web_key", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 30),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 26),
)
RULES = BASE + MORE

#: Bound on the strings that one stretch of an expression may stand for.
MOST_STRINGS = 64


def _stretches(parsed) -> list[set[str] | None]:
    """A parsed expression as a sequence of string sets; None stands for anything."""
    out: list[set[str] | None] = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            out.append({chr(c).lower() for _, c in arg})
        elif op is sre.SUBPATTERN:
            out += _stretches(arg[3])
        elif op is sre.MAX_REPEAT and arg[1] == 1 and (inner := _joined(_stretches(arg[2]))) is not None:
            out.append(inner | {""} if arg[0] == 0 else inner)
        elif op is sre.MAX_REPEAT and 0 < arg[0] == arg[1] <= 8:
            out += _stretches(arg[2]) * arg[0]
        elif op is sre.BRANCH:
            options = [_joined(_stretches(x)) for x in arg[1]]
            out.append(None if None in options else set().union(*options))
        else:
            out.append(None)
    return out


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    whole = {""}
    for p in parts:
        if p is None or len(whole) * len(p) > MOST_STRINGS:
            return None
        whole = {a + b for a, b in itertools.product(whole, p)}
    return whole


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams that must all occur; empty: no constraint."""
    runs: list[set[str]] = [{""}]
    for part in _stretches(sre_parse.parse(regex)):
        if part is None:
            runs.append({""})
        elif len(runs[-1]) * len(part) > MOST_STRINGS:
            runs.append(part)
        else:
            runs[-1] = {a + b for a, b in itertools.product(runs[-1], part)}
    grams = lambda s: frozenset(s[i : i + 3] for i in range(len(s) - 2))
    # one run is enough for a sound query; the one with the longest shortest string prunes most
    best = max(runs, key=lambda r: min(map(len, r)))
    return sorted({grams(s) for s in best}, key=sorted) if min(map(len, best)) >= 3 else []


def candidates(docs: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """(key, rules): the indexed rules whose trigram query a document meets, as a set of bits."""
    clauses = [(1 << k, i, sorted(c)) for k, r in enumerate(rules) for i, c in enumerate(trigram_query(r.regex))]
    wanted = sorted({g for *_, c in clauses for g in c})
    low = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(n)) for n, g in enumerate(wanted)]))
    postings = low.select("key", F.explode(found).alias("gram"))
    rows = [(wanted.index(g), f"{bit}/{i}", bit, len(c)) for bit, i, c in clauses for g in c]
    # the fixed rule table is bounded by the rules above
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "gram int, clause string, rule long, needed int"))
    met = postings.join(table, "gram").groupBy("key", "clause", "rule", "needed").agg(F.count_distinct("gram").alias("n")).where("n = needed")
    return met.groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _located(text: Column, rule: Rule) -> Column:
    """Spans (start, stop) of a rule's matches in code points, failing matches dropped.

    The pieces between matches and the matches themselves alternate, so the offsets
    are running sums of their lengths.
    """
    rx = F.lit(rule.regex)
    matches = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), lambda m: F.length(m))
    checked = F.transform(F.regexp_extract_all(text, rx, F.lit(rule.group)), lambda m: F.length(m))
    pieces = F.transform(F.split(text, rule.regex, -1), lambda p: F.length(p))
    span_type = "array<struct<start:int,stop:int>>"
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(span_type).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["piece"]
        stop = start + x["match"]
        grown = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))
        return F.struct(stop.alias("pos"), F.when(x["checked"] >= rule.least, grown).otherwise(acc["spans"]).alias("spans"))

    zipped = F.arrays_zip(matches.alias("match"), checked.alias("checked"), F.slice(pieces, 1, F.size(matches)).alias("piece"))
    return F.aggregate(zipped, zero, step, lambda acc: acc["spans"])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, keep: tuple[str, ...] = (), out: str = "found") -> DataFrame:
    """Every row's ``keep`` columns, key and text with ``out``: sorted structs (start, rank, kind, stop).

    Spans are leftmost and non-overlapping per kind; kinds may overlap each other. The texts are
    not shuffled where the candidates are few enough to be broadcast.
    """
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    base = docs.select(kept.alias("__keep"), F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    cand = written(candidates(base, "__key", "__text", rules), "candidates").select(F.col("key").alias("__cand"), F.col("rules").alias("__rules"))
    joined = base.join(small(cand), F.col("__key").eqNullSafe(F.col("__cand")), "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    for n, r in enumerate(rules):
        due = F.coalesce(F.col("__rules"), F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0 if trigram_query(r.regex) else F.lit(True)
        hit = F.when(due, F.col("__text").rlike(r.regex)).otherwise(F.lit(False))
        joined = joined.withColumn(f"__s_{r.name}", F.when(hit, _located(F.col("__text"), r)).otherwise(none))

    def named(n: int, r: Rule) -> Column:
        return F.transform(f"__s_{r.name}", lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), F.lit(r.name).alias("kind"), s["stop"].alias("stop")))

    found = F.array_sort(F.concat(*[named(n, r) for n, r in enumerate(rules)]))
    return joined.select(*[F.col("__keep")[c].alias(c) for c in keep], F.col("__key").alias(key), F.col("__text").alias(text), found.alias(out))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or union of overlapping spans, replaced by the mark."""
    zero = F.struct(F.array().cast("array<struct<start:int,stop:int>>").alias("gaps"), F.lit(0).alias("pos"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["pos"].alias("start"), s["start"].alias("stop"))
        grown = F.when(s["start"] >= acc["pos"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"])
        return F.struct(grown.alias("gaps"), F.greatest(acc["pos"], s["stop"]).alias("pos"))

    def joined(acc: Column) -> Column:
        clear = F.transform(acc["gaps"], lambda g: F.substring(text, g["start"] + 1, g["stop"] - g["start"]))
        return F.concat(F.array_join(clear, mark), F.lit(mark), F.substring(text, acc["pos"] + 1, F.length(text)))

    return F.when(F.size(found) > 0, F.aggregate(found, zero, step, joined)).otherwise(text)

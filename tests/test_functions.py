"""Column functions on typed fixtures: normal forms, similarity, quality, enrichment, screening."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import similarity as sim
from songsieve.functions import text as t
from songsieve.operators import enrich, screening


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("make", "value", "want"),
    [
        (t.normalized, "  Graça & PAZ, Irmão!\n", "graca paz irmao"),
        (t.normalized, None, ""),
        (t.numeric_entities_decoded, "caf&#233; &#x4E2D; &#99999999;", "café 中 "),
        (t.lyrics_normalized, " a  b \r\n\n\n\n\n c ", "a b\n\n\nc"),
        (t.html_cleaned, "<p>um<br/>dois</p><p>tr&amp;s</p>", "um\ndois\n\ntr&s"),
        (t.html_stripped, "<div>a<script>x</script></div><p>b &lt;c</p>", "a\nb <c"),
        (t.slug, " Fé & Graça! ", "fe-e-graca"),
        (t.timestamps_stripped, "[00:01.20]um\n[00:02.00][00:09.1] dois", "um\ndois"),
        (t.js_string_decoded, r"um\ndois é", "um\ndois é"),
        (lambda c: t.identity(c, F.lit("Banda feat. Outro")), "Canção (Ao Vivo)", "cancao|banda"),
        (lambda c: F.array_join(t.search_terms(c), " "), "o amor de Deus e o amor", "amor deus"),
        (t.fnv1a, "a", "1oylnj0"),
    ],
)
def test_text(spark, make, value, want):
    got = one(spark, value, make)
    if make is t.fnv1a:
        h = 2166136261
        for c in value:
            h = (h ^ ord(c)) * 16777619 % 2**32
        want = ""
        while h:
            want, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + want, h // 36
    assert got == want


def test_errors(spark):
    rows = [("TimeoutError", "", "TIMEOUT"), ("", "HTTP 404", "HTTP_404"), ("", "getaddrinfo x", "DNS"), ("", "bad JSON", "INVALID_JSON"), ("", "Host não autorizado", "HOST_REJECTED"), (None, None, "UPSTREAM_ERROR")]
    df = spark.createDataFrame(rows, "n string, m string, want string")
    assert df.where(t.error_code(F.col("n"), F.col("m")) != F.col("want")).count() == 0


def dice_reference(a, b):
    from collections import Counter

    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 3:
        return 0.85 if a in b or b in a else 0.0
    x, y = (Counter(s[i : i + 2] for i in range(len(s) - 1)) for s in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.text("ab c", max_size=9), st.text("ab c", max_size=9)), min_size=1, max_size=20))
def test_dice_is_exact_and_symmetric(spark, pairs):
    clean = [(" ".join(a.split()), " ".join(b.split())) for a, b in pairs]
    df = spark.createDataFrame(clean, "a string, b string")
    for r in df.select("a", "b", sim.dice(F.col("a"), F.col("b")).alias("d"), sim.dice(F.col("b"), F.col("a")).alias("e")).collect():
        assert r.d == pytest.approx(dice_reference(r.a, r.b))
        assert r.d == pytest.approx(r.e)


def test_ordered_coverage_and_requests(spark):
    df = spark.createDataFrame([("um dois tres", ["um", "tres", "dois"])], "x string, terms array<string>")
    assert df.select(sim.ordered_coverage(F.col("x"), F.col("terms"))).first()[0] == pytest.approx(2 / 3)
    row = spark.createDataFrame([("Canção", "Banda", "Cancao", "banda", "Outra")], "a string, b string, c string, d string, e string")
    ok = row.select(sim.matches_request(F.col("a"), F.col("b"), F.col("c"), F.col("d")), sim.matches_request(F.col("a"), F.lit(""), F.col("e"), F.lit(""))).first()
    assert ok[0] and not ok[1]


def test_quality_bounds(spark):
    text = "[Refrão]\nJesus, meu Senhor\nSanto és tu\n" * 6
    r = q.with_quality(spark.createDataFrame([(text,), ("",)], "x string"), "x").collect()
    assert 0 <= r[1].quality <= r[0].quality <= 100 and r[0].line_count == 18 and r[1].line_count == 0
    s = q.signals(F.col("x"))
    seen = spark.createDataFrame([(text,)], "x string").select(s["signals"]).first()[0]
    assert seen == ["section-markers", "lyric-line-shape", "gospel-vocabulary"]


def test_enrichment(spark):
    n = lambda x: spark.createDataFrame([(x,)], "x string").select(enrich.themes(t.normalized(F.col("x"))), enrich.verses(t.normalized(F.col("x")))).first()
    assert n("Santo, digno de louvor; tua graça")[0] == ["Adoração", "Gratidão"]
    assert n("nada")[0] == ["Louvor & Adoração"] and n("nada")[1] == ["Salmos 150:6", "Colossenses 3:16"]
    rows = [(1, 0, "[Intro]\noi"), (1, 1, "um"), (1, 2, "um"), (1, 3, "Refrão: la"), (1, 4, "dois")]
    got = enrich.sections(spark.createDataFrame(rows, "k int, p int, t string"), "k", "p", "t").orderBy("p").collect()
    assert [(r.type, r.label) for r in got] == [("intro", "Introdução"), ("verse", "Verso 1"), ("chorus", "Refrão"), ("chorus", "Refrão"), ("verse", "Verso 3")]


def test_screening(spark):
    rows = [
        ("https://www.example.com/a", None), ("https://a.example.com./x", None), ("ftp://example.com", "SCHEME"), ("http://u:p@example.com", "CREDENTIALS"), ("http://10.1.1.1/", "PRIVATE"),
        ("http://172.20.0.1", "PRIVATE"), ("http://169.254.1.1", "PRIVATE"), ("http://[::ffff:10.0.0.1]/", "PRIVATE"), ("http://x.internal", "PRIVATE"), ("http://evil-example.com", "NOT_ALLOWED"),
    ]
    df = spark.createDataFrame(rows, "u string, want string")
    assert df.where(~screening.reason(F.col("u"), ["example.com"]).eqNullSafe(F.col("want"))).count() == 0


def test_fingerprint_covers_whole_texts(spark):
    long = "abcd " * 2000
    df = spark.createDataFrame([(long + "one",), (long + "two",), (long.upper() + "-ONE!",)], "x string")
    a, b, c = (r.f for r in df.select(t.fingerprint(F.col("x")).alias("f")).collect())
    assert a != b and a == c


def test_best_window_of_a_passage(spark):
    """Against the same rules over plain lists."""
    lines = ["the sun goes down", "over the quiet river", "a boat without oars", "drifts to the sea", "and sings", "over the river quietly"]
    df = spark.createDataFrame([(lines, "quiet river boat", ["quiet", "river", "boat"]), (lines, "zzz", ["zzz"]), ([], "sun", ["sun"]), (lines, "goes down over the quiet", ["goes", "down", "over", "quiet"])], "ls array<string>, a string, t array<string>")
    got = [r.m for r in sim.with_best_window(df, "m", "ls", "a", "t").collect()]

    def dice(a, b):
        ga, gb = ([x[i : i + 2] for i in range(len(x) - 1)] for x in (a, b))
        return 2 * sum(min(ga.count(g), gb.count(g)) for g in set(ga)) / (len(ga) + len(gb))

    best = {}
    for asked, terms in (("quiet river boat", ["quiet", "river", "boat"]), ("goes down over the quiet", ["goes", "down", "over", "quiet"])):
        for start in range(len(lines)):
            for size in range(1, min(4, len(lines) - start) + 1):
                w = " ".join(lines[start : start + size])
                at, found = 0, 0
                for term in terms:
                    hit = next((i for i, x in enumerate(w.split()) if i >= at and (term in x or x in term)), None)
                    if hit is not None:
                        at, found = hit + 1, found + 1
                score = 1.25 * (len(asked) >= 8 and asked in w) + 0.62 * sum(x in w for x in terms) / len(terms) + 0.28 * found / len(terms) + 0.1 * dice(w, asked) + 0.04 * min(1, len(asked) / max(len(w), len(asked)))
                best[asked] = max(best.get(asked, (0,)), (score, -start, -size))
    for m, asked in ((got[0], "quiet river boat"), (got[3], "goes down over the quiet")):
        score, start, size = best[asked]
        assert abs(m.score - score) < 1e-9 and (m.start, m.size) == (1 - start, -size) and m.matched
    assert not got[1].matched and got[2] is None


def test_titles_and_stamps(spark):
    row = spark.createDataFrame([("Canção (Ao Vivo)", "Canção", "  [00:01.20][101:02] a\n\t[00:03]b\nc [00:04]")], "a string, b string, c string")
    r = row.select(sim.title_similarity(F.col("a"), F.col("b")).alias("s"), t.timestamps_stripped(F.col("c")).alias("c"), t.comparable(F.col("a")).alias("k")).first()
    assert (r.s, r.c, r.k) == (1.0, "a\nb\nc [00:04]", "cancao")

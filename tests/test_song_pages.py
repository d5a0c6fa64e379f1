"""Pages to songs: pages are read once, texts judged once, and rows that repeat an id are pages of their own."""

from pyspark.sql import functions as F

from songsieve.functions import text as t
from songsieve.operators import pages as p

VERSE = ["Line one of the song is here", "Line two of the song is here", "Line three ends the song"]


def page(title: str) -> str:
    body = "".join(f"<p>{x} and it goes on, verse {i} of {title}</p>" for i, x in enumerate(VERSE * 4))
    return f'<html><head><title>{title} by The Band</title><script type="application/ld+json">{{"album": "{title} album"}}</script></head><body><div class="lyrics">{body}</div></body></html>'


def test_songs_read_pages_once_and_repeated_ids_apart(spark, monkeypatch):
    read = []
    monkeypatch.setattr(p, "nodes", lambda pages, nodes=p.nodes: read.append(1) or nodes(pages))
    rows = [(1, "https://h.example/a/one.html", page("One")), (1, "https://h.example/a/two.html", page("Two")), (2, "https://h.example/a/two.html", page("Two"))]
    got = sorted((r.page_id, r.title, r.album, r.source_url, "of One" in r.lyrics) for r in p.songs(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "One", "One album", rows[0][1], True), (1, "Two", "Two album", rows[1][1], False), (2, "Two", "Two album", rows[2][1], False)]
    assert len(read) == 1


def test_a_text_found_in_many_ways_is_judged_once(spark):
    text = "\n".join(f"{x}, verse {i}" for i, x in enumerate(VERSE * 4))
    rows = [(1, text, 0, f"m{i}", "tree", "s", float(i)) for i in range(5)] + [(1, "short", 0, "m", "tree", "s", 0.0), (1, None, 0, "m", "tree", "s", 0.0)]
    found = p.scored(spark.createDataFrame(rows, "page_id long, text string, link_chars long, method string, parser string, source string, bonus double"), "quality")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(ways") < plan.index("collect_list(")  # the ways part again above the one row of a text
    got = found.select("method", "score", "print", F.round("quality", 2).alias("quality")).collect()
    assert {r.method for r in got} == {f"m{i}" for i in range(5)} and len({r.print for r in got}) == 1 and len({r.quality for r in got}) == 1
    assert [r.score for r in sorted(got)] == [sorted(got)[0].score + i for i in range(5)]


def test_noise_is_looked_for_only_where_its_words_are(spark):
    assert all(t.plain_part(x) in x and len(t.plain_part(x)) >= 5 for x in t.NOISE)
    df = spark.createDataFrame([("POLÍTICA DE PRIVACIDADE",), ("Politica de Privacidade, Aceitar cookie",), ("Download THE app, faça LOGIN",), ("",), (None,)], "x string")
    assert [r.n for r in df.select(t.noise_hits(F.col("x")).alias("n")).collect()] == [0, 2, 2, 0, None]

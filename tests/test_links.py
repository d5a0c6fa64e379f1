"""Links of small pages, and what songs lack."""

from pyspark.sql import functions as F

from songsieve.operators import links, recovery

SONG = "id int, title string, artist string, album string, image_url string, image_kind string"


def frame(spark, *html, terms=()):
    return spark.createDataFrame([(i, "https://www.h.example/x/y", h, list(terms)) for i, h in enumerate(html)], "page_id long, url string, html string, terms array<string>")


def test_addresses(spark):
    cases = {"a.html": "https://h.example/x/a.html", "/b?q=1": "https://h.example/b?q=1", "//c.example/d": "https://c.example/d", "http://e.example": "http://e.example", "#f": None, "mailto:g": None, "javascript:x()": None, "": None, "/i?a&amp;b": "https://h.example/i?a&b"}
    df = spark.createDataFrame([(k,) for k in cases], "href string")
    got = {r.href: r.u for r in df.select("href", links.absolute(F.col("href"), F.lit("https://h.example/x/y?z#w")).alias("u")).collect()}
    assert got == cases
    root = df.limit(1).select(links.absolute(F.lit("a"), F.lit("https://h.example")).alias("u"), links.absolute(F.lit("a"), F.lit("no address")).alias("v")).first()
    assert (root.u, root.v) == ("https://h.example/a", None)


def test_site_links(spark):
    html = """<a href='/band/song-one.html?x#y' title="My Song">My <b>Song</b> - The Band</a> <A data-href="/no/no" HREF="https://h.example/band/song-one.html">again</A>
    <a href="/top/list">Top list</a><a href="/band/album">Its album</a><a href="/alone">One part only</a><a href="/a/b/c/d/e/f">Six parts</a>
    <a href="https://o.example/band/song">Other site</a><a href="/other-band/tune">ab</a><a href="/other-band/tune">A tune</a><a>none</a><a href="/x/unclosed">open"""
    got = sorted((r.page_id, r.url, r.title, r.artist, r.score) for r in links.site_links(frame(spark, html, None, "", "<p>no links</p>")).collect())
    assert got == [
        (0, "https://h.example/band/song-one.html", "again", "Band", 58),
        (0, "https://www.h.example/band/song-one.html", "My Song", "The Band My Song", 58),
        (0, "https://www.h.example/other-band/tune", "A tune", "Other Band", 58),
    ]
    asked = {r.url[-4:]: r.score for r in links.site_links(frame(spark, html, terms=("tune", "other"))).collect()}
    assert asked == {"tune": 58 + 16 + 18}


def test_listed_songs(spark):
    state = '{"a": [{"url": "/band/one", "title": "One", "artist": {"name": "The Band"}}, {"songUrl": "/band/two", "name": "Two", "author": "Them"}, {"url": "/band/three"}, {"title": "no address"}]}'
    html = f'<script type="application/json">{state}</script><script>{state.replace("band", "plain")}</script><script id="__NEXT_DATA__">{{broken</script>'
    got = sorted((r.url, r.title, r.artist, r.score) for r in links.listed_songs(frame(spark, html, None, "")).collect())
    assert got == [("https://www.h.example/band/one", "One", "The Band", 64), ("https://www.h.example/band/two", "Two", "Them", 64)]


def test_recovery(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), SONG)
    songs = make((1, "A", "X", "own", "own.png", "own"), (2, "B (Ao Vivo)", "X", None, None, None), (3, "C", "X", "kept", None, None), (4, None, "X", None, None, None), (5, "D", None, None, None, None), (6, "E", "X", None, "e.png", "own"))
    media = make((0, "a", "x", "no", "no.png", "album"), (0, "b", "x", "First", "b.png", "album"), (0, "b", "x", "Second", "c.png", "album"), (0, None, "X", "no", "no.png", "album"))
    second = make((0, "C", "X", "other", "s.png", "song"), (0, "E", "X", "never asked", "n.png", "song"))
    got = {r.id: (r.album, r.image_url, r.image_kind) for r in recovery.recovered(songs, media, second).collect()}
    assert got == {1: ("own", "own.png", "own"), 2: ("First", "b.png", "album"), 3: ("kept", "s.png", "song"), 4: (None, None, None), 5: (None, None, None), 6: (None, "e.png", "own")}
    assert recovery.recovered(songs.limit(0), media, second).count() == 0


def test_dotted_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c d": "x"}]}}',)], "j string")
    at = lambda path: df.select(recovery.value_at(F.col("j"), F.lit(path)).alias("v")).first().v
    assert (at("a.b.1.c d"), at("a..b.0"), at("a.z"), at(""), at("a.b")) == ("x", "1", None, None, '[1,{"c d":"x"}]')


def test_cards_and_queries_are_read_to_their_end(spark):
    words = [f"word{chr(97 + i)}" for i in range(20)]
    html = f"<li><a href='/band/song.html'>My Song</a><p>{'x ' * 2000}</p><p>golden {words[19]}</p></li>"
    df = spark.createDataFrame([(1, "https://h.example/", html, "golden"), (2, "https://h.example/", html, " ".join(words[:17]) + " song wordt my")], "page_id long, url string, html string, query string")
    got = {r.page_id: (r.score, r.preview is not None) for r in links.result_cards(df, ["h.example"]).collect()}
    assert got == {1: (60, True), 2: (54 + 9 * 1 + 6 * 2, False)}

"""Page operators on small pages made here."""

from pyspark.sql import functions as F

from songsieve.operators import pages as p

VERSE = ["Line one of the song is here", "Line two of the song is here", "Line three ends the song"]


def frame(spark, *html):
    return spark.createDataFrame([(i, f"https://h.example/the-band/my-song-{i}.html", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def test_quoted_properties_of_any_length(spark):
    long = "word \\\\n" * 200_000  # over a million characters
    df = frame(spark, f'<script>{{"lyrics": "{long}"}}</script>', "<script>{'letra' : '" + "it\\'s a long enough line of text, as it must be" + "'}</script>", '{"lyrics": "short"}')
    got = {r.page_id: r for r in p.quoted_props(df).collect()}
    assert set(got) == {0, 1} and got[0].text.count("word") == 200_000 and "a long enough line" in got[1].text and got[1].bonus == 12


def test_structured_data_tells_its_kinds(spark):
    body = "\\n".join(VERSE)
    df = frame(spark, f'<script type="application/ld+json">{{"lyrics": "{body}"}}</script>', f'<script id="__NEXT_DATA__">{{"a": {{"verse": ["{VERSE[0]}", "{VERSE[1]}", "{VERSE[2]}"]}}}}</script>', "<script>not json</script><script>[1, {</script>")
    got = {(r.page_id, r.method, r.source, r.bonus) for r in p.json_candidates(p.nodes(df)).collect()}
    assert got == {(0, "json-ld", "structured-key:$.lyrics", 18.0), (0, "json-ld", "structured:$.lyrics", 12.0), (1, "hydration-state", "structured-array:$.a.verse", 8.0)}


def test_streamed_state_and_alternate_markup(spark):
    inside = "{\\\\\"lyrics\\\\\":\\\\\"" + "\\\\\\\\n".join(VERSE) + "\\\\\"}"
    df = frame(spark, f'<script>self.__next_f.push([1,"{inside}"])</script>'.replace("\\\\", "\\"), "<noscript>" + "<br>".join(VERSE) + "</noscript><template>x</template>")
    assert "\n".join(VERSE) in {r.text for r in p.flight_chunks(df).collect()}
    assert [(r.page_id, r.text, r.parser, r.bonus) for r in p.alternate_markup(df).collect()] == [(1, "\n".join(VERSE), "noscript", 3.0)]


def test_near_duplicates_of_a_page_are_merged(spark):
    lines = [f"line number {i} of the text" for i in range(20)]
    rows = [(1, "\n".join(lines), "a", "m1", "s", 50.0), (1, "\n".join([*lines, "one more line"]), "b", "m2", "s", 60.0), (1, "\n".join(f"other line {i} of it" for i in range(20)), "a", "m1", "s", 40.0)]
    df = spark.createDataFrame(rows, "page_id long, text string, parser string, method string, source string, score double").withColumn("link_chars", F.lit(0)).withColumn("bonus", F.lit(0.0))
    got = sorted((r.method, r.score, r.parsers, r.extractors) for r in p.near_merged(p.deduped(df)).collect())
    assert got == [("m1", 40.0, False, False), ("m2", 73.0, True, True)]


def test_page_to_song(spark):
    body = "".join(f"<p>{x} and it goes on, verse {i}</p>" for i, x in enumerate(VERSE * 4))
    html = f'<html><head><meta property="og:title" content="My Song by The Band"><meta name="music:album" content="First"><meta content="//img.example/a.png" property="og:image"></head><body><div class="lyrics">{body}</div></body></html>'
    plain = f"<html><head><title>Letras - x</title></head><body><nav>menu</nav><div class='letra'>{body}</div></body></html>"
    got = {r.page_id: r for r in p.songs(frame(spark, html, plain, "<p>nothing</p>", "")).collect()}
    assert set(got) == {0, 1}
    assert (got[0].title, got[0].artist, got[0].album, got[0].image_url) == ("My Song", "The Band", "First", "https://img.example/a.png")
    assert VERSE[0] in got[0].lyrics and (got[1].title, got[1].artist) == ("Letras", "x")


def test_encodings(spark):
    raw = [("<meta charset='windows-1252'>\u20ac\u201cx\u201d é".encode("cp1252"),), ("é ok".encode(),), (b"\xff bad",), (b"",), (None,)]
    df = spark.createDataFrame(raw, "content binary").withColumn("c", p.charset(F.col("content")))
    got = [r.t for r in df.select(p.decoded(F.col("content"), F.col("c")).alias("t")).collect()]
    assert got == ["<meta charset='windows-1252'>\u20ac\u201cx\u201d é", "é ok", "\ufffd bad", "", None]

"""Pages as trees by intervals: against a plain walk, on hand-made pages, and on pages meant to hurt."""

import random
import re
import time

from pyspark.sql import functions as F

from songsieve.functions import text as t
from songsieve.operators import links, tree
from songsieve.operators import pages as p

VERSE = ["Line one of the song is here", "Line two of the song is here", "Line three ends the song"]


def frame(spark, *html):
    return spark.createDataFrame([(i, f"https://h.example/the-band/my-song-{i}.html", h) for i, h in enumerate(html)], "page_id long, url string, html string")


def plain_text(raw):
    """The lyrics' normal form, in plain Python."""
    out = raw.replace("\u00a0", " ").replace("\r", "")
    for pattern, put in ((r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{4,}", "\n\n\n")):
        out = re.sub(pattern, put, out)
    return re.sub(r"^\s+|\s+$", "", out, flags=re.ASCII)


def plain_elements(html):
    """{node: (text, link characters)} of the block elements that hold text, each walked for itself."""
    flat = tree.Flat()
    flat.read(html)
    rows = [dict(zip([f[0] for f in tree.FIELDS], r, strict=True)) for r in flat.rows]
    out = {}
    for e in rows:
        if e["kind"] == "e" and e["tag"] in tree.BLOCKS and not e["in_noise"]:
            inside = [x for x in rows if x["kind"] == "t" and not x["in_noise"] and e["node"] <= x["node"] <= e["last"]]
            raw, block = "", None
            for x in inside:
                raw += ("\n" if block is not None and x["block"] != block else "") + x["text"]
                block = x["block"]
            if plain_text(raw):
                out[e["node"]] = (plain_text(raw), sum(len(x["text"].replace("\u00a0", " ").strip(" \t\r\n")) for x in inside if x["in_link"]))
    return out


def random_page(rng):
    bits = ["<div>", "</div>", "<p>", "</p>", "<b>", "</b>", "<br>", "<li>", "<section>", "</section>", "<a href=x>", "</a>", "<nav>", "</nav>", "<script>", "</script>", "text here", " two  words ", "\n", "\n\n \n", "x", "&nbsp;", "<div class='Cookie-bar'>", "<span>", "</span>", "</ul>", "<td>", "\t"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))


def test_elements_equal_a_plain_walk(spark):
    rng = random.Random(4)
    html = [random_page(rng) for _ in range(120)]
    flat = tree.nodes(frame(spark, *html)).cache()
    runs = tree.runs(flat).cache()
    got = {}
    for r in tree.with_texts(tree.measured(flat, runs), runs).collect():
        got.setdefault(r.page_id, {})[r.node] = (r.text, r.link_chars)
        assert r.chars == len(r.text) and r.lines == len([x for x in r.text.split("\n") if x.strip()])
    assert [got.get(i, {}) for i in range(len(html))] == [plain_elements(h) for h in html]


def test_any_element_by_its_pieces(spark):
    flat = tree.nodes(frame(spark, "<p>a <span class='letra'>b<br>c</span> d</p>"))
    assert [(r.text, r.link_chars) for r in tree.pieces_of(flat, flat.where("name = 'letra'").select("page_id", "node", "pos", "stop")).collect()] == [("b\nc", 0)]


def test_selectors_and_hidden_parts(spark):
    html = "<div data-lyrics-container='true' id=Lyrics-1>one</div><p itemprop='lyrics'>two</p><i class='x letra'>three</i><div class='letras' style='display: none'><p class=letra>hidden</p></div><div aria-hidden=true class=lyric>no</div>"
    got = {(r.text, r.method, r.source, r.bonus) for r in p.semantic_blocks(tree.nodes(frame(spark, html))).collect()}
    assert got == {
        ("one", "dom-semantic", 'selector:[data-lyrics-container="true"]', 12.0), ("one", "dom-semantic", 'selector:[id*="lyrics" i]', 12.0), ("one", "dom-semantic", 'selector:[id*="lyric" i]', 12.0),
        ("two", "microdata", 'selector:[itemprop="lyrics"]', 12.0), ("three", "dom-semantic", "selector:.letra", 12.0),
    }


def test_density_blocks(spark):
    body = "".join(f"<p>{x}</p>" for x in VERSE * 2)
    many = "".join(f"<p>{x} {i}</p>" for i, x in enumerate(VERSE * 7))
    html = [f"<article><div>{body}</div></article>", f"<section>{many}</section>", f"<div><a href=x>{' '.join(VERSE)}</a><p>a</p><p>b</p></div>", f"<div>{' '.join(VERSE)}</div>", f"<nav><div>{body}</div></nav>"]
    got = sorted((r.page_id, r.source, r.bonus, r.text.count("\n"), r.link_chars) for r in p.density_blocks(tree.nodes(frame(spark, *html))).collect())
    assert got == [(0, "density:article", 4.0, 5, 0), (0, "density:div", 4.0, 5, 0), (1, "density:section", -7.0, 20, 0)]


def test_readability_lifts_the_block_around_and_joins_siblings(spark):
    verses = "".join(f"<p>{chr(10).join(x.replace(' ', ' ') for x in VERSE)}, {i}</p>" for i in range(3))
    flat = tree.nodes(frame(spark, f"<div class=a><div class=b>{verses}</div><div class=c>short</div></div>"))
    rows = p.readability(flat).collect()
    winners = [r for r in rows if r.source.startswith("winner")]
    assert {r.source for r in winners} == {"winner:div", "winner:p"} and max(winners, key=lambda r: r.bonus).text.count("Line one") == 3
    assert any(r.source == "siblings" and r.text.count("Line one") == 3 and r.bonus == 13.0 for r in rows)


def test_rescue_leaves_out_repeats_and_furniture(spark):
    html = "<div><p>First quite usable line of the page</p><p>First quite usable line of the page</p><p>Publicidade aqui</p><li>Second usable line of the page is <b>here</b></li><p><a href=x>a link that is all of it</a></p><p>tiny</p></div>"
    got = [r.text for r in p.baseline_rescue(tree.nodes(frame(spark, html))).collect()]
    assert got == ["First quite usable line of the page\nSecond usable line of the page is here"]


def test_pages_that_hurt_take_linear_time(spark):
    n = 100_000
    html = ["<div>x" * n, "<script>" * n, "<a href=x>" * n, "<p>y" * n, "<script " * n, "<" * n, "</div>" * n, "<b>" * n + "</i>" * n, "<noscript><template>" * n, "<div>" * 50_000 + "one text" + "</div>" * 50_000]
    pages = frame(spark, *html).repartition(5).cache()
    pages.count()
    began = time.perf_counter()
    flat = tree.nodes(pages)
    assert flat.where("page_id = 0").count() == 2 * n and flat.where("page_id = 9").count() == 50_001
    assert tree.measured(flat, tree.runs(flat)).where("page_id = 9").agg(F.count("*"), F.min("chars"), F.max("chars")).first()[:] == (50_000, 8, 8)
    assert pages.select(F.max(F.length(t.html_stripped(F.col("html"))))).first()[0] is not None
    assert p.regex_containers(pages).count() == p.flight_chunks(pages).count() == p.alternate_markup(pages).count() == 0
    assert links.anchors(pages.withColumn("terms", F.array().cast("array<string>"))).count() == 0
    assert time.perf_counter() - began < 90


def test_rows_that_repeat_an_id_are_pages_of_their_own(spark):
    body = lambda x: "<div class=lyrics>" + "".join(f"<p>{line} {x}</p>" for line in VERSE * 4) + "</div>"
    df = spark.createDataFrame([(1, body("one")), (1, body("two")), (1, body("two")), (2, None), (None, "")], "page_id long, html string")
    got = sorted((r.page_id or 0, r.text.count("one"), r.text.count("two")) if r.text else (r.page_id or 0, r.rejected) for r in p.extract(df).collect())
    assert got == [(0, "no-candidate"), (1, 4, 16), (1, 4, 16), (1, 16, 4), (2, "no-candidate")]


def test_tags_that_tell_nothing_are_not_looked_through(monkeypatch):
    asked = []

    class Selectors(dict):
        def items(self):
            asked.append(1)
            return super().items()

    monkeypatch.setattr(tree, "SELECTORS", Selectors(tree.SELECTORS))
    page = tree.Flat()
    page.read('<li><a href="/x.html">one</a><img src="i.png" alt="two"></li>' * 50 + '<p class="letra" hidden>three</p>')
    assert len(asked) == 1 and page.rows[-2][10] == [".letra"] and page.rows[-2][14]

"""Work that grows with the tables and not with the squares of their groups."""

import random

from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import similarity as sim
from songsieve.functions import text as t
from songsieve.operators import linkage, pages, search, tree
from songsieve.sources.tables import staged


def ordered(text: str, terms: list[str]) -> float:
    tokens, cursor, found = [w for w in text.split(" ") if w], 0, 0
    for term in terms:
        at = next((i for i in range(cursor, len(tokens)) if term in tokens[i] or tokens[i] in term), None)
        if at is not None:
            cursor, found = at + 1, found + 1
    return found / len(terms)


def test_ordered_coverage_equals_the_search_word_by_word(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 4)))
    rows = [(i, rng.choice([" ", "  "]).join(word() for _ in range(rng.randint(0, 9))), [word() for _ in range(rng.randint(1, 5))]) for i in range(300)]
    got = spark.createDataFrame(rows, "id long, text string, terms array<string>").select("id", sim.ordered_coverage(F.col("text"), F.col("terms")).alias("c"))
    assert {r.id: round(r.c, 9) for r in got.collect()} == {i: round(ordered(text, terms), 9) for i, text, terms in rows}


def test_ordered_coverage_of_a_long_text_is_no_search_of_all_words_for_each_term(spark):
    text = " ".join(f"w{i}" for i in range(20_000)) + " last"
    df = spark.createDataFrame([(text, [f"q{i}" for i in range(300)] + ["last"])] * 8, "text string, terms array<string>")
    plan = df.select(sim.ordered_coverage(F.col("text"), F.col("terms")).alias("c"))
    assert {round(r.c * 301) for r in plan.collect()} == {1}


def test_texts_are_cut_into_lines_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(linkage, "staged", lambda df: written.append(df) or staged(df))
    texts = ["\n".join(f"shared line number {j} of the text" for j in range(i, i + 12)) for i in (0, 1, 40)] + [None, "one line"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = linkage.line_pairs(df, "id", "text", 0.86)
    assert [(r.a, r.b) for r in out.collect()] == [(0, 1)]
    assert "Á" not in out._jdf.queryExecution().optimizedPlan().toString() and len(written) == 2  # accents are taken off before the rows are written, only there


def test_normal_form_equals_the_two_steps_it_replaces(spark):
    texts = ["", None, " a  b\t\n", "Ação!--É x", "\u000b1 a_b", "é́Z"]
    two = lambda c: F.trim(F.regexp_replace(F.regexp_replace(t.unaccented(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", " "), r"\s+", " "))
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select(t.normalized(F.col("x")).alias("one"), two(F.col("x")).alias("two"))
    assert all(r.one == r.two for r in rows.collect())


def test_quality_of_candidates_is_told_once(spark, monkeypatch):
    calls = []
    plain = q.with_quality
    monkeypatch.setattr(q, "with_quality", lambda *args: calls.append(1) or plain(*args))
    lines = "<br>".join(f"the river number {i} sings of the light" for i in range(12))
    df = spark.createDataFrame([(1, f"<html><body><article><p>{lines}</p></article></body></html>"), (2, None)], "page_id long, html string")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert len(calls) == 3  # of all candidates, of the rescued and of the winners
    assert got[2].rejected == "no-candidate" and len(got[1].text.split("\n")) == 12


def shuffled(spark, figure: str = "shuffleWriteRecords") -> int:
    """Records that the session's stages have written to shuffles so far, or another figure of theirs."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(getattr(stages.apply(i), figure)() for i in range(stages.size()))


def test_passages_meet_texts_by_words_and_not_by_lines(spark):
    words = [f"river{c}{c}stone" for c in "abcdefghijkl"]
    texts = [(i, "\n".join([" ".join(words[:7])] * 50)) for i in range(40)] + [(40, "x\n" + " ".join(words[:9]) + "\n" + " ".join(words[9:]))]
    docs, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(words)) for i in range(5)], "item_id long, text string")
    before, small = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as larger tables are joined
    try:
        got = search.excerpt_matches(asked, docs).select("item_id", "doc_id", "start", "size").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert sorted(map(tuple, got)) == [(i, 40, 2, 2) for i in range(5)]
    assert shuffled(spark) - before < 5 * 40 * 50  # a text's lines are not dealt out for each passage


def test_texts_of_good_pages_are_written_once(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(pages, "staged", lambda df: tables.append(staged(df)) or tables[-1])
    verses = "".join(f"<p>the river number {i} sings of the light<br>and verse {i} goes on to the sea,</p>" for i in range(30))
    df = spark.createDataFrame([(i, f"<html><body><article class='lyrics'>{verses} song {i}</article></body></html>") for i in range(2)], "page_id long, html string")
    assert {r.rejected for r in pages.extract(df).collect()} == {None}
    texts = [(r.page_id, r.text) for x in tables if {"text", "print"} <= set(x.columns) for r in x.select("page_id", "text").collect()]
    assert len(texts) == len(set(texts)) > 0


def test_what_is_put_together_of_runs_is_not_shuffled(spark):
    rng = random.Random(2)
    words = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=200))
    runs = staged(spark.createDataFrame([(1, i, 1, words()) for i in range(1, 51)], "page_id long, run int, gap int, text string"))
    ranges = staged(spark.createDataFrame([(1, i, 1 + i % 2, 50 - i // 2 % 10) for i in range(200)], "page_id long, node int, first int, final int"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as larger tables are joined
    before = shuffled(spark, "shuffleWriteBytes")
    try:
        got = {r.node: r.text for r in tree.with_texts(ranges, runs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    texts = [r.text for r in runs.orderBy("run").collect()]
    assert got == {i: "\n".join(texts[i % 2 : 50 - i // 2 % 10]) for i in range(200)}
    assert shuffled(spark, "shuffleWriteBytes") - before < 5 * 50 * 200

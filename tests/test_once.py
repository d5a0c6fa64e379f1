"""What is heavy is made once a row, whatever reads it, and equal rows have one outcome."""

import duckdb
from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import similarity as sim
from songsieve.functions import text as t
from songsieve.operators import discography
from songsieve.operators import pages as p
from songsieve.plans import page_texts, search, texts
from songsieve.sources.tables import spread


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def docs(spark, *xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "doc_id long, text string")


def written(spark, tmp_path, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_alt_markup_shows_references_as_its_sql(spark, tmp_path):
    title = "Rock &amp; token = &quot;0b96a8c8d of the old river, a song"
    d = written(spark, tmp_path, "pages", [(1, "u", f"<title>{title}</title>")], "page_id long, url string, html string")
    line = title.replace("&amp;", "&")
    assert [r.text for r in page_texts.QUERIES["alt_markup"](spark, d).collect()] == ["\n".join([line] * 3)]


def test_ordered_distinct_takes_the_first_of_equal_lines(spark, tmp_path):
    rows = [(1, 7, 1, "R"), (1, 7, 1, "A"), (1, 8, 1, "N"), (2, 7, 1, "A"), (2, 7, 1, "R")]
    d = written(spark, tmp_path, "lineitem", rows, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string")
    assert {tuple(r) for r in search.QUERIES["ordered_distinct"](spark, d).collect()} == {(1, "R", 3), (2, "A", 2)}


def test_ordered_distinct_sees_gaps_as_its_sql(spark, tmp_path):
    rows = [(1, 7, 1, None), (1, 8, 1, "A"), (2, None, 1, "A"), (2, 5, 1, "R"), (3, 5, None, "A"), (3, 5, 2, "R"), (4, None, None, "X"), (5, 1, 1, None), (6, None, None, "C"), (6, None, 1, "D"), (None, 3, 1, "N")]
    d = written(spark, tmp_path, "lineitem", rows, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{d}/lineitem.parquet/*.parquet')")
    assert {tuple(r) for r in search.QUERIES["ordered_distinct"](spark, d).collect()} == set(con.execute(search.ORACLES["ordered_distinct"]).fetchall())


def test_line_metrics_of_odd_texts_equal_their_sql(spark, tmp_path):
    odd = ["", None, "  \n ", "a\x0bb c", "a \x0b\nA\x0b\nb\x0b\x0bc\nb\x0b c", "\u039f\u0394\u039f\u03a3\n\u03bf\u03b4\u03bf\u03c2\n\u03bf\u03b4\u03bf\u03c3", "\u0130x\nix", "a\r\nA\t b\na b"]
    odd += ["\n".join("l%d" % (i if i % 3 else 0) + "y" * (i % 97) for i in range(n)) for n in (128, 640, 1280, 3200)]
    d = written(spark, tmp_path, "documents", list(enumerate(odd)), "doc_id long, text string")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    assert {tuple(r) for r in texts.QUERIES["line_metrics"](spark, d).collect()} == set(con.execute(texts.ORACLES["line_metrics"]).fetchall())


def test_names_and_texts_are_made_normal_once(spark):
    df = docs(spark, "The river. The river of erst", None)
    for made in (sim.term_coverage, sim.ordered_coverage):
        out = df.select(made(t.normalized(F.col("text")), t.search_terms(F.lit("erst river gone"))).alias("c"))
        assert plan(out).count("translate(") == 1
    assert plan(df.select(sim.dice(F.col("text"), F.lit("x")).alias("c"))).count("translate(") == 1
    assert plan(df.select(t.preview(F.col("text"), F.lit("river gone")).alias("c"))).count("regexp_replace(text") == 1


def test_dice_of_repeated_pairs_and_of_nothing(spark):
    df = spark.createDataFrame([("aaaa", "aaab"), ("abab", "baba"), (None, "abcd"), ("abcd", "bcda")], "a string, b string")
    got = [r.d for r in df.select(sim.dice(F.col("a"), F.col("b"), normal=True).alias("d")).collect()]
    assert got[0] == 2 * 2 / 6 and got[1] == 2 * 2 / 6 and got[2] is None and got[3] == 2 * 2 / 6


def test_a_filter_on_a_score_does_not_make_it_again(spark):
    rows = docs(spark, "one two three four five six\nseven eight nine ten eleven twelve thirteen").withColumns({"method": F.lit("api"), "link_chars": F.lit(0), "bonus": F.lit(0)})
    out = q.with_candidate_score(rows).where("score is not null")
    assert plan(out).count("privacidade") == 1 and out.count() == 1
    assert plan(q.with_signals(docs(spark, "x"))).count("privacidade") == 1


def test_heavy_rows_are_dealt_to_all_tasks(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id")).coalesce(1)
    assert spread(df, "doc_id").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_a_title_is_compared_in_one_form(spark):
    df = docs(spark, "The River (Ao Vivo)")
    assert plan(df.select(sim.title_similarity(F.col("text"), F.lit("the river")).alias("s"))).count("translate(") <= 4
    titles = discography._titles(df.select("doc_id", F.col("text").alias("title")), "doc_id")
    like = titles.select(discography._like("titles", F.lit("x").substr(F.lit(1), F.col("doc_id")), 0.9).alias("like"))
    assert plan(like).count("translate(") <= 4  # once each for the title and the text, with and without entities


def test_json_values_tell_where_objects_begin(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": {"c": ["y", "z"], "d": {"e": "w"}}}', "k")], "id int, raw string, base string")
    rows = p.json_values(df, "id", "raw", keep=("base",)).orderBy("place").collect()
    assert [(r.base, r.path, r.place, list(r.begins)) for r in rows if not r.joined] == [("k", "$.a", 0, [0]), ("k", "$.b.c[0]", 2, [0, 1, 1]), ("k", "$.b.c[1]", 3, [0, 1, 1]), ("k", "$.b.d.e", 4, [0, 1, 4])]


def test_pages_are_read_once(spark):
    pages = spark.createDataFrame([(1, "u", "<article>" + "<p>line of a song here,</p>" * 9 + "</article>")], "page_id long, url string, html string")
    for out in (p.density_blocks(p.nodes(pages)), p.readability(p.nodes(pages))):
        assert "MapInArrow" not in plan(out) and out.count() > 0


def test_windows_take_their_lines_made_normal_once(spark):
    df = docs(spark, "The River!\n***\nof erst, tion\nlast line").select("doc_id", F.split("text", "\n").alias("ls"), F.lit("river of erst tion").alias("asked"), t.search_terms(F.lit("river of erst tion")).alias("terms"))
    out = sim.with_best_window(df, "m", "ls", "asked", "terms")
    made = plan(out)
    assert "array_join(array_remove(slice(" in made or "array_join(filter(slice(" in made
    m = out.select("m.*").first()
    assert (m.start, m.size, m.exact, m.matched) == (1, 3, True, True)

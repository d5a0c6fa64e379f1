"""Greedy absorption, songs merged, and passages found, each against a plain version."""

import random

from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import similarity as sim
from songsieve.functions import text as t
from songsieve.operators import linkage, search
from songsieve.operators import pages as p


def greedy(links, ranks):
    """{taken: by}, rows gone through in order."""
    kept, taken = set(), {}
    for r in sorted(ranks):
        by = [a for a, b in links if b == r and a in kept]
        if by:
            taken[r] = min(by)
        else:
            kept.add(r)
    return taken


def test_absorption_equals_the_sequential_rule(spark):
    rng, rows, want = random.Random(8), [], {}
    for group in range(40):
        n = rng.randint(2, 30)
        links = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < rng.choice([0.05, 0.2, 0.6])}
        rows += [(group, a, b) for a, b in links]
        want |= {(group, b): a for b, a in greedy(links, range(n)).items()}
    chain = [(100, i, i + 1) for i in range(50)]
    want |= {(100, b): a for b, a in greedy([x[1:] for x in chain], range(51)).items()}
    df = spark.createDataFrame(rows + chain, "g int, a int, b int")
    assert {(r.g, r.b): r.a for r in linkage.absorbed(df, ["g"]).collect()} == want
    assert linkage.absorbed(df.limit(0), ["g"]).count() == 0


def test_a_chain_of_candidates_keeps_every_other_one(spark):
    # each text shares most lines with the next only
    texts = ["\n".join(f"shared line number {j} of the text" for j in range(i, i + 12)) for i in range(0, 12, 2)]
    rows = [(1, x, "a", f"m{i}", "s", 90.0 - i) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "page_id long, text string, parser string, method string, source string, score double").withColumn("link_chars", F.lit(0)).withColumn("bonus", F.lit(0.0))
    got = sorted(r.method for r in p.near_merged(p.deduped(df), 0.86).collect())
    ls = [set(x.split("\n")) for x in texts]
    alike = {(i, j) for i in range(6) for j in range(i + 1, 6) if len(ls[i] & ls[j]) / 12 * 0.82 + min(len(texts[i]), len(texts[j])) / max(len(texts[i]), len(texts[j])) * 0.18 >= 0.86}
    assert alike == {(i, i + 1) for i in range(5)} and got == ["m0", "m2", "m4"]


def test_songs_are_merged_in_order_of_score(spark):
    rows = [(1, "Amazing Grace", "John Newton", None, 1, 50), (2, "Amazing Grace", "John Newtom", "Hymns", 2, 40), (3, "Amazing Grace!", "Johnny Cash", "Gospel", 3, 45), (4, "Other", "John Newton", None, 1, 60), (5, "Hey", "U2", None, 1, 9), (6, "Hey", "U2 x", "A", 2, 8), (7, "", "", None, 1, 1), (8, "", "", None, 2, 1)]
    df = spark.createDataFrame(rows, "id long, title string, artist string, album string, sources int, score int")
    got = {r.id: (r.album, r.sources, r.score, r.members) for r in linkage.fuzzy_merged(df, ["album"], ["sources"], ["score"]).collect()}
    assert got == {1: ("Hymns", [1, 2], 50, 2), 3: ("Gospel", [3], 45, 1), 4: (None, [1], 60, 1), 5: ("A", [1, 2], 9, 2), 7: (None, [1], 1, 1), 8: (None, [2], 1, 1)}


def test_links_of_songs_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["love", "lover", "of", "my", "life", "song", "songs", "a", "b"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice(["The Band", "The Bands", "Band", "x", "xy", "U2", "", "Other Ones"])) for i in range(150)]
    df = spark.createDataFrame(rows, "rank long, title string, artist string")
    side = lambda x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in df.columns])
    every = side("a").crossJoin(side("b")).where("rank_a < rank_b").where(sim.same_song(F.col("title_a"), F.col("artist_a"), F.col("title_b"), F.col("artist_b")) >= 0.9)
    assert sorted(map(tuple, linkage.same_song_links(df).collect())) == sorted(map(tuple, every.select("rank_a", "rank_b").collect()))


def test_passages_found_equal_all_pairs(spark):
    rng = random.Random(6)
    words = ["river", "rivers", "mountain", "shine", "shining", "light", "lamp", "the", "of", "sea", "season", "gold", "golden", "x"]
    docs = [(i, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, ""), (61, "river light\nsea gold")]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(25)] + [(25, "the of"), (26, None), (27, "river light sea gold"), (28, "zzz yyy")]
    docs_df, asked_df = spark.createDataFrame(docs[:-1], "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    pairs = asked_df.select("item_id", t.normalized(F.col("text")).alias("asked"), t.search_terms(F.col("text")).alias("terms")).crossJoin(docs_df.select("doc_id", q.lines(F.col("text")).alias("ls")))
    want = sim.with_best_window(pairs, "m", "ls", "asked", "terms").where("m.matched").select("item_id", "doc_id", F.round("m.score", 6), "m.start", "m.size")
    got = search.excerpt_matches(asked_df, docs_df).select("item_id", "doc_id", F.round("score", 6), "start", "size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20

"""Collocations against a plain count, SQL, and the defined cases."""

import random
import re
from collections import Counter

import duckdb
import pytest

from songsieve.llm import collocations, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=5):
    got, words = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                got.update((lang or "und", k, " ".join(w[i : i + k])) for i in range(len(w) - k + 1))
    return got, words


def plain(rows, threshold=100, top=2000):
    f, words = plain_counts(rows)
    found = {x: n for x, n in f.items() if x[1] > 1 and n >= threshold}
    inside = set()
    for (lang, k, phrase), n in found.items():
        w = phrase.split(" ")
        for j in range(2, k):
            for i in range(k - j + 1):
                short = (lang, j, " ".join(w[i : i + j]))
                if 100 * n >= 100 * f[short]:
                    inside.add(short)
    out = {}
    for (lang, k, phrase), a in found.items():
        if (lang, k, phrase) in inside:
            continue
        w, cuts = phrase.split(" "), []
        for j in range(1, k):
            left, right = f[lang, j, " ".join(w[:j])], f[lang, k - j, " ".join(w[j:])]
            cuts.append((1000 * a * words[lang] // (left * right), j, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, words[lang], -score) for lang, x in out.items() for i, (score, a, p, left, right) in enumerate(sorted(x)[:top]))


def rows_of(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "The", "the"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = ["New York City Hall here", "once upon a time, there", "a\tb  c d e f", "late words come last"]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(fixed) + rng.choice(["", ".", "\n", ";", "\x0b"]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    return [*rows, ("en", None), ("fr", ""), (None, "...")]


@pytest.mark.parametrize(("shards", "threshold"), [(3, 60), (2, 20), (1, 20)])
def test_counts_and_ranks_equal_a_plain_count(spark, shards, threshold):
    rows = rows_of(shards)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    f, words = plain_counts(rows)
    got = {(r.lang, r.k, r.phrase): r.n for r in collocations.counts(df, threshold=threshold, shards=shards).collect()}
    assert {x: n for x, n in got.items() if x[1]} == {x: n for x, n in f.items() if n >= threshold}
    assert {x[0]: n for x, n in got.items() if not x[1]} == dict(words)
    ranked = sorted(map(tuple, collocations.collocations(df, threshold=threshold, top=7, shards=shards).collect()))
    assert ranked == plain(rows, threshold, 7)


def test_a_full_bitmap_changes_no_count(spark):
    rows = rows_of(9, 250)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    f, _ = plain_counts(rows)
    got = {(r.lang, r.k, r.phrase): r.n for r in collocations.counts(df, threshold=30, filter_bits=64).where("k > 0").collect()}
    assert got == {x: n for x, n in f.items() if n >= 30}


def test_scores_beyond_64_bits_are_exact(spark):
    n, a, left, right = 4 * 10**15 + 7, 10**15 - 9, 10**15 + 3, 10**15 + 1
    known = spark.createDataFrame([("en", 0, "", n), ("en", 1, "a", left), ("en", 1, "b", right), ("en", 2, "a b", a)], "lang string, k int, phrase string, n long")
    assert collocations.ranked(known, 5).first()["score"] == 1000 * a * n // (left * right)


def test_odd_rows(spark, odd):
    assert collocations.collocations(odd.limit(0)).count() == 0
    got = collocations.collocations(odd, threshold=2).collect()
    assert {r.lang for r in got} == {"en"} and "one two three four five" in {r.phrase for r in got}


def test_the_query_equals_its_sql(spark, frame, tmp_path):
    rows = rows_of(3, 900)
    df = frame([(i, text, "a") for i, (_, text) in enumerate(rows)])
    langs = spark.createDataFrame([(i, lang) for i, (lang, _) in enumerate(rows)], "doc_id long, l string")
    df.drop("lang").join(langs.withColumnRenamed("l", "lang"), "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_collocations(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.OP13_SQL).fetchall()) == plain(rows)
    assert len(got) > 20

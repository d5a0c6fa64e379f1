"""Periodic runs against a plain search, the transform against sums, SQL, and the defined cases."""

import random
import time

import duckdb
import numpy as np

from songsieve.llm import periodic, queries


def plain(words, least=12):
    """Every maximal stretch for every period, the smallest period of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in found.items())


def test_the_transform_convolves_exactly():
    rng = np.random.default_rng(3)
    for n in (8, 64, 128, 1024, 1 << 13):
        x, y = rng.integers(0, periodic.PRIME, (2, 3, n))
        got = periodic.transformed(periodic._mod(periodic.transformed(x.astype(float)) * periodic.transformed(y.astype(float))), inverse=True)
        k = 5
        want = sum(int(x[1, i]) * int(y[1, (k - i) % n]) for i in range(n)) % periodic.PRIME
        assert int(got[1, k]) == want
        assert (periodic.transformed(periodic.transformed(x.astype(float)), inverse=True) == x).all()


def texts_of(rng):
    for _ in range(250):
        alphabet = [f"w{i}" for i in range(rng.choice([1, 2, 2, 3, 5, 40]))]
        words = [rng.choice(alphabet) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 3)):
            if words:
                at, period = rng.randrange(len(words)), rng.randint(1, 30)
                words[at:at] = (words[at : at + period] * rng.randint(2, 6))[: rng.randint(12, 150)]
        yield words
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 900:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    yield ["x"] * 700
    yield [f"u{i % 211}" for i in range(1500)]
    yield ["a", "b", "a", "a"] * 100 + ["z"] + ["b", "a", "a", "a"] * 100


def test_runs_equal_a_plain_search():
    all_words = list(texts_of(random.Random(11)))
    texts = [" ".join(w) for w in all_words]
    runs, collapsed, sizes = periodic.searched(texts)
    for words, got, left, n in zip(all_words, runs, collapsed, sizes, strict=True):
        want = plain(words)
        assert [(r["start"], r["period"], r["length"]) for r in got] == want and n == len(words)
        gone = {i for s, q, length in want for i in range(s + q, s + length)}
        assert left == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_a_smaller_largest_block_gives_the_same(monkeypatch):
    words = [f"w{i}" for i in range(300)] * 3 + ["y", "z"] * 30
    text = [" ".join(words)]
    want = periodic.searched(text)
    monkeypatch.setattr(periodic, "LARGEST", 8)
    assert periodic.searched(text) == want and [r["period"] for r in want[0][0]] == [300, 2]


def test_long_texts_take_no_square_time():
    began = time.perf_counter()
    texts = ["x " * 300_000, " ".join(f"w{i % 70_000}" for i in range(300_000)), "a b a a " * 70_000]
    runs, *_ = periodic.searched(texts)
    assert [[(r["start"], r["length"], r["period"]) for r in x] for x in runs] == [[(0, 300_000, 1)], [(0, 300_000, 70_000)], [(0, 280_000, 4)]]
    assert time.perf_counter() - began < 60


def test_odd_rows(spark, odd):
    got = periodic.with_runs(odd)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = sorted(((r.doc_id, r.n_words, len(r.runs), r.collapsed[:9]) for r in got.collect()), key=repr)
    assert rows == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 6, 0, "one two t"), (3, 6, 0, "one two t"), (None, 3, 0, "seven eig"), (5, 60_000, 1, "word0 wor"), (6, 0, 0, ""), (7, 1, 0, "x")], key=repr)
    assert periodic.with_runs(odd.limit(0)).count() == 0


def test_the_query_equals_its_sql(spark, frame, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(w), "a") for i, w in enumerate(texts_of(rng)) if len(w) < 400]
    rows += [(10_000, None, "a"), (10_001, "", "a"), (10_002, "é " * 20, "a")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.OP12_SQL).fetchall())
    assert sum(r[1] for r in got) > 50

"""Vector operators against brute force, and on odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from songsieve.llm import ann, neardup
from songsieve.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int, d int, n string, rank int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(500):
        x = rng.normal(size=16)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 4))):
            rows.append(((x + rng.normal(size=16) * rng.choice([0, 0.05, 0.12])).astype(np.float32), label))
    hot = rng.normal(size=16).astype(np.float32)
    rows += [(hot, 1)] * 300
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8]
    table = [(i, [float(v) for v in x], lab, 1, "n", 2) for i, (x, lab) in enumerate(rows)]
    table += [(len(table) + k, b, 1, 1, "n", 2) for k, b in enumerate(bad)]
    table.append((len(table), table[0][1], None, 1, "n", 2))
    return table, spark.createDataFrame(table, SCHEMA)


def usable(x):
    return x and all(v is not None and math.isfinite(v) for v in x) and any(x)


def test_near_duplicates(vectors):
    table, df = vectors
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    ok = [t for t in table if t[2] is not None and usable(t[1]) and len(t[1]) == 16]
    x = np.array([t[1] for t in ok])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    lab = np.array([t[2] for t in ok])
    links = (u @ u.T >= 0.93) & (lab[:, None] == lab[None])
    np.fill_diagonal(links, False)
    label = neardup.forest(len(ok), *np.nonzero(links))
    for i, t in enumerate(ok):
        r = got[t[0]]
        assert (r.n_links, r.component_id, r.kept) == (links[i].sum(), ok[label[i]][0], ok[label[i]][0] == t[0])
    for t in table:
        if t not in ok:
            assert (got[t[0]].n_links, got[t[0]].component_id, got[t[0]].kept) == (0, t[0], True)


def test_tiles_do_not_change_the_result(vectors, monkeypatch):
    _, df = vectors
    rows = lambda: sorted(map(tuple, neardup.near_duplicates(df).collect()))
    usual = rows()
    monkeypatch.setattr(neardup, "TILE", 100)
    assert rows() == usual


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = 0.9301 * a + math.sqrt(1 - 0.9301**2) * side
    found = set(zip(*(x.tolist() for x in neardup.candidates(a, b, math.sqrt(2 - 2 * 0.93))), strict=True))
    assert sum((i, i) in found for i in range(len(a))) >= 0.998 * len(a)


@pytest.mark.parametrize("group", [4096, 20])
def test_nearest_neighbours(vectors, group, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", group)
    table, df = vectors
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    by_length = {}
    for t in table:
        if usable(t[1]):
            by_length.setdefault(len(t[1]), []).append(t)
    hits = []
    for rows in by_length.values():
        x, ids = np.array([t[1] for t in rows]), np.array([t[0] for t in rows])
        for k in np.flatnonzero(ids % 10 == 0):
            d = np.sqrt(((x - x[k]) ** 2).sum(1))
            d[k] = np.inf
            want = ids[np.lexsort((ids, d))][: min(10, len(ids) - 1)]
            mine = sorted(got.get(int(ids[k]), []))
            assert [r for r, *_ in mine] == list(range(1, len(want) + 1))
            assert all(s == pytest.approx(d[np.flatnonzero(ids == v)[0]], abs=1e-12) for _, v, s in mine)
            assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
            hits.append(len({v for _, v, _ in mine} & set(want.tolist())) / max(1, len(want)))
    assert np.mean(hits) >= 0.95


def test_small_and_empty_tables(spark, vectors):
    _, df = vectors
    few = df.where("vec_id < 4")
    assert ann.search(few, F.lit(True)).groupBy("query_id").count().where("count <> 3").count() == 0
    none = df.limit(0)
    assert ann.search(none, F.lit(True)).count() == 0 and neardup.near_duplicates(none).count() == 0


def test_steps_are_in_order_of_cost():
    inside = np.array([0.1, 0.8, 0.45])
    got = ann.steps(inside, 27)
    cost = lambda s: sum(inside[i] ** 2 if m < 0 else (1 - inside[i]) ** 2 for i, m in enumerate(s) if m)
    assert [cost(s) for s in got] == sorted(cost(s) for s in got) and len({tuple(s) for s in got}) == 27


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (7, 8), (5, 5), (3, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3)} == {1} and {got[i] for i in (7, 8, 9, 10)} == {7} and {got[100 + i] for i in range(41)} == {100}

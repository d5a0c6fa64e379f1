"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector by ``FUNCTIONS`` quantised Gaussian projections.
A query visits, besides its own bucket, those reached by stepping some functions to a
neighbouring cell, in the order of their estimated success (the squared distances to the
cell borders that are crossed). Rows and probes meet in an equi-join on the bucket; the
candidates of all tables are merged and reranked by exact distance in double precision.

Equal vectors are one candidate that keeps its smallest ids, as many as an answer can hold,
and equal queries are searched once. A bucket of many rows is dealt to several groups by a
salt, to each of which its probes go. Queries whose buckets held too few candidates are
answered by a scan of all rows, in blocks of queries, so answers are never short.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take
no part; vectors of different lengths never meet; ties go to the smaller id; rows that
repeat an id are separate candidates of that id, and a query never answers with its own id;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.llm.common import small, written
from songsieve.llm.neardup import usable

TABLES = 8
FUNCTIONS = 4
PROBES = 24  # buckets visited in each table
WIDTH = 1.4  # of a cell, in root mean square lengths of the vectors
GROUP = 4096  # rows of a bucket in one group
SEED = 11
BLOCK = 4096  # queries in one scan


class Hashes:
    """The tables' projections for vectors of one length."""

    def __init__(self, dim: int, scale: float):
        rng = np.random.default_rng([SEED, dim])
        self.lines = rng.normal(size=(TABLES, dim, FUNCTIONS)) / (WIDTH * scale)
        self.shift = rng.uniform(size=(TABLES, 1, FUNCTIONS))
        self.dim = dim

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Position in cells: (table, row, function)."""
        return np.einsum("nd,tdk->tnk", x, self.lines) + self.shift

    def codes(self, cells: np.ndarray, table: int) -> np.ndarray:
        """A 64-bit bucket number for each row of cell numbers."""
        out = np.full(cells.shape[:-1], table * 1_000_003 + self.dim, np.uint64)
        for k in range(FUNCTIONS):
            out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def steps(inside: np.ndarray, probes: int = PROBES) -> list[np.ndarray]:
    """Cell steps of a query, best first; ``inside`` is its place in its cell, each in [0, 1)."""
    k = len(inside)
    costs = np.concatenate([inside, 1 - inside]) ** 2
    order = np.argsort(costs, kind="stable")
    cost = costs[order].tolist()
    out = [np.zeros(k, np.int64)]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        c, chosen = heapq.heappop(heap)
        at = [int(order[j]) for j in chosen]
        if len({a % k for a in at}) == len(at):
            step = np.zeros(k, np.int64)
            for a in at:
                step[a % k] = -1 if a < k else 1
            out.append(step)
        last = chosen[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (c - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (c + cost[last + 1], (*chosen, last + 1)))
    return out


def by_length(column: pa.Array):
    """(row numbers, matrix in double precision) of a list column, for each vector length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, np.asarray(column.take(pa.array(at)).flatten()).astype(np.float64).reshape(-1, int(d))


def hashed(rows: DataFrame, scale: float, probes: int) -> DataFrame:
    """A row for each table, or each probe of each table: its columns and ``code``."""

    def run(batches):
        made: dict[int, Hashes] = {}
        for b in batches:
            for at, x in by_length(b.column("vector")):
                h = made.setdefault(x.shape[1], Hashes(x.shape[1], scale))
                cells = h.cells(x)
                part = b.take(pa.array(at))
                for t in range(TABLES):
                    low = np.floor(cells[t])
                    if probes == 1:
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h.codes(low, t))], names=[*b.schema.names, "code"])
                        continue
                    moves = [np.array(steps(f, probes)) for f in cells[t] - low]
                    codes = [h.codes(c + m, t) for c, m in zip(low, moves, strict=True)]
                    again = part.take(pa.array(np.repeat(np.arange(len(x)), [len(c) for c in codes])))
                    yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.concatenate(codes))], names=[*b.schema.names, "code"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", code long")


def nearest(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact distances (queries, vectors) from differences, in chunks of bounded memory."""
    out = np.empty((len(query), len(vectors)))
    step = max(1, 4_000_000 // max(1, query.shape[1] * len(vectors)))
    for at in range(0, len(query), step):
        d = query[at : at + step, None, :] - vectors[None]
        out[at : at + step] = np.sqrt((d * d).sum(axis=-1))
    return out


def best(dist: np.ndarray, firsts: np.ndarray, ids, keep: int) -> list[tuple[float, int]]:
    """The ``keep`` nearest (distance, id) of candidate vectors, each with its sorted ids."""
    top = np.lexsort((firsts, dist))[:keep]
    return sorted((float(dist[i]), x) for i in top for x in ids[i])[:keep]


ANSWER = "qid long, vec_id long, score double"


def answers(found: dict[int, list[tuple[float, int]]]) -> pa.Table:
    rows = [(q, v, s) for q, pairs in found.items() for s, v in pairs]
    q, v, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"qid": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def scan(rows: DataFrame, queries: DataFrame, keep: int) -> DataFrame | None:
    """Exact answers of some queries from all rows, a block of queries at a time."""
    spark, out = rows.sparkSession, None
    blocks = -(-queries.count() // BLOCK)
    for n in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n).select("qid", "vector").toArrow()  # a block's queries, about BLOCK of them
        shared = spark.sparkContext.broadcast([(part.column("qid").take(pa.array(at)).to_pylist(), x) for at, x in by_length(part.column("vector"))])

        def run(batches, shared=shared):
            for b in batches:
                for at, x in by_length(b.column("vector")):
                    ids = b.column("ids").take(pa.array(at)).to_pylist()
                    firsts = np.array([i[0] for i in ids])
                    for qids, q in shared.value:
                        if q.shape[1] == x.shape[1]:
                            got = {k: best(d, firsts, ids, keep) for k, d in zip(qids, nearest(q, x), strict=True)}
                            yield from answers(got).to_batches()

        made = rows.select("ids", "vector").mapInArrow(run, ANSWER)
        out = made if out is None else out.union(made)
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``is_query`` holds for."""
    spark, keep = vectors.sparkSession, k + 1
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    first = F.row_number().over(Window.partitionBy("vector", F.pmod("id", F.lit(64))).orderBy("id"))
    few = rows.select("id", "vector").distinct().withColumn("r", first).where(F.col("r") <= keep)
    data = written(few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids")), "vectors")
    asked = written(rows.where("asks").select("id", "vector").distinct(), "queries")
    alone = written(asked.groupBy("vector").agg(F.min("id").alias("qid")).select("qid", "vector"), "alone")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = data.select(F.avg(square).alias("s"), F.count("*").alias("n")).first()
    scale = float(np.sqrt(stats["s"])) if stats["s"] else 1.0

    index = hashed(data, scale, 1)
    crowded = small(written(index.groupBy("code").count().where(F.col("count") > GROUP).select(F.col("code").alias("c"), F.ceil(F.col("count") / GROUP).cast("int").alias("parts")), "crowded"))
    parts = F.coalesce("parts", F.lit(1))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stats["n"] * TABLES // 50_000))
    place = lambda salt: F.pmod(F.xxhash64("code", salt), F.lit(groups)).alias("place")
    left = index.join(crowded, F.col("code") == F.col("c"), "left").select("code", "ids", "vector", place(F.pmod(F.xxhash64("vector"), parts).cast("int")))
    right = hashed(alone, scale, PROBES).join(crowded, F.col("code") == F.col("c"), "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select("code", "qid", "vector", place(F.col("salt"))).distinct()

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        codes, wanted = np.asarray(rows.column("code")), np.asarray(asks.column("code"))
        order = np.argsort(codes, kind="stable")
        ids = rows.column("ids").to_pylist()
        firsts = np.array([i[0] for i in ids], np.int64)
        qids = np.asarray(asks.column("qid"))
        table = {d.shape[1]: (at, d) for at, d in by_length(rows.column("vector"))}
        for qat, q in by_length(asks.column("vector")):
            if q.shape[1] not in table:
                continue
            rat, d = table[q.shape[1]]
            row_of = np.full(len(codes), -1)
            row_of[rat] = np.arange(len(rat))
            q_order = np.argsort(wanted[qat], kind="stable")
            bounds = np.flatnonzero(np.diff(wanted[qat][q_order])) + 1
            for some in np.split(q_order, bounds):
                code = wanted[qat][some[0]]
                lo, hi = np.searchsorted(codes, code, "left", sorter=order), np.searchsorted(codes, code, "right", sorter=order)
                at = order[lo:hi]
                at = at[row_of[at] >= 0]
                if len(at):
                    for j, dist in zip(some, nearest(q[some], d[row_of[at]]), strict=True):
                        top = np.lexsort((firsts[at], dist))[:keep]
                        found.setdefault(int(qids[qat][j]), []).append((dist[top], at[top]))
        out = {}
        for k_, lists in found.items():
            at, place_ = np.unique(np.concatenate([a for _, a in lists]), return_index=True)
            dist = np.concatenate([x for x, _ in lists])[place_]
            # a vector found in two tables of the same group is one candidate
            _, once = np.unique(firsts[at], return_index=True)
            out[k_] = best(dist[once], firsts[at][once], [ids[a] for a in at[once]], keep)
        return answers(out)

    got = left.groupBy("place").cogroup(right.groupBy("place")).applyInArrow(lambda a, b: meet(a.drop(["place"]), b.drop(["place"])), ANSWER)
    merged = written(got.distinct(), "found")
    ranked = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "vec_id"))).where(F.col("rank") <= n)
    short = written(alone.join(merged.groupBy("qid").count().where(F.col("count") >= keep), "qid", "left_anti"), "short")
    exact = scan(data, short, keep)
    if exact is not None:
        merged = merged.union(exact).distinct()
    top = ranked(merged, keep).select("qid", F.col("vec_id").alias("v"), "score")
    to = asked.join(alone.withColumnRenamed("vector", "w"), F.col("vector") == F.col("w")).select(F.col("id").alias("query_id"), "qid")
    other = to.join(top, "qid").where("v <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "v"))
    return other.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("v").alias("vec_id"), "score")

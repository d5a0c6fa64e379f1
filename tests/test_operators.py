"""Operators on small frames, batch against stream, and the registered queries against SQL."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from songsieve import plans
from songsieve.operators import linkage, traffic
from songsieve.operators.search import phrase_matches, query_variants
from songsieve.streaming import traffic as stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_phrases_are_whole(spark):
    docs = spark.createDataFrame([(1, "O amor, de Deus é bom demais"), (2, "amordedeus"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "amor de deus e bom"), (8, "deus e x"), (9, "mor de deus e bo")], "item_id long, text string")
    assert {(r.item_id, r.doc_id) for r in phrase_matches(asked, docs).collect()} == {(7, 1), (9, 1)}


def test_variants_are_ordered_and_distinct(spark):
    q = spark.createDataFrame([(1, "grande é o senhor e mui digno de louvor", "Banda"), (2, "Canção", None)], "item_id int, query string, artist string")
    got = {}
    for r in query_variants(q, "item_id").orderBy("item_id", "rank").collect():
        got.setdefault(r.item_id, []).append(r.variant)
    assert got[1][:2] == ["grande é o senhor e mui digno de louvor", "Banda grande é o senhor e mui digno de louvor"] and len(got[1]) == 5
    assert got[2] == ["Canção"]


def test_merge_fills_blanks(spark):
    rows = [("k", 1, 5, None, "a"), ("k", 2, 9, None, "b"), ("k", 3, 1, "x", "a")]
    r = linkage.merge_groups(spark.createDataFrame(rows, "g string, id int, score int, album string, src string"), "g", [F.desc("score"), F.col("id")], ["album"], ["src"], ["score"]).first()
    assert (r.id, r.album, r.src, r.score, r.members) == (2, "x", ["a", "b"], 9, 3)


def test_breaker_blocks_after_the_second_failure(spark):
    rows = [(i, "p", i * 1000, bad) for i, bad in enumerate([True, True, True, False, True])]
    log = spark.createDataFrame(rows, "event_id int, p string, ms long, bad boolean").withColumn("ts", F.timestamp_millis("ms"))
    got = traffic.circuit_breaker(log, "p", "ts", F.col("bad")).orderBy("event_id").collect()
    assert [r.failures for r in got] == [1, 2, 3, 0, 1] and [r.block_ms for r in got] == [0, 2200, 8800, 0, 0]
    assert [r.blocked_attempt for r in got] == [False, False, True, True, False]


def drained(query):
    query.processAllAvailable()
    query.stop()


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("client", F.col("user_id").cast("string")).withColumn("bad", F.col("event_type") == "error")
    # one later row per stream lets the watermark pass everything else
    last = events.limit(1).withColumn("ts", F.expr("timestamp'2100-01-01'")).withColumn("client", F.lit("end"))
    events.unionByName(last).repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(events.schema).parquet(str(tmp_path / "log"))
    conf = lambda n: {"checkpointLocation": str(tmp_path / n)}
    drained(stream.rate_windows(log, "client", "ts", "1 day", 2).writeStream.format("memory").queryName("windows").options(**conf("w")).start())
    got = {(r.client, r.window_start): (r.requests, r.rejected) for r in spark.table("windows").collect()}
    want = {}
    for r in traffic.rate_limit(events, "client", "ts", "1 day", 2).collect():
        n, bad = want.get((r.client, r.window_start), (0, 0))
        want[r.client, r.window_start] = (n + 1, bad + (not r.allowed))
    assert {k: v for k, v in got.items() if k[0] != "end"} == want
    drained(stream.breaker_states(log, "client", "ts", "bad").writeStream.format("memory").queryName("states").options(**conf("b")).start())
    rows = {(r.client, r.ts): r.failures for r in spark.table("states").collect() if r.client != "end"}
    batch = {(r.client, r.ts): r.failures for r in traffic.circuit_breaker(events, "client", "ts", F.col("bad")).collect()}
    assert rows == batch


def cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int | float):
        return None if v != v else round(float(v), 6)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    want = duck.sql(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: Counter(str(tuple(cell(v) for v in r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert plans.queries()[name](spark, DATA).count() >= 0

"""Queries of the catalog: one list for all that ask the same."""

from songsieve.plans import search


def test_queries_that_ask_the_same_are_answered_once(spark, tmp_path):
    rows = [(i, f"royal title{i}", "Brand#1", "LARGE TIN", 1) for i in range(400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    met = []
    plain = search.met
    search.met = lambda asked, r: met.append(plain(asked, r)) or met[-1]
    try:
        out = search.search_local(spark, str(tmp_path))
    finally:
        search.met = plain
    assert met[0].count() == 400  # 160,000 where each title asks for itself
    got = {(r.query_id, r.rank): r.id for r in out.collect()}
    assert got == {(i, k + 1): k for i in range(400) for k in range(12)}

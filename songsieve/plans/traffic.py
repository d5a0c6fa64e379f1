"""Log queries over the events table: a client's event is a request, its type the outcome."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from songsieve.operators import traffic
from songsieve.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def failed():
    return F.col("event_type") == "error"



def rate_limit(spark, d):
    out = traffic.rate_limit(read(spark, d, "events"), "user_id", "ts", "1 day", 5)
    return out.select("event_id", "request_no", "allowed", "remaining")


QUERIES["rate_limit"] = rate_limit
ORACLES["rate_limit"] = """SELECT event_id, CAST(n AS INTEGER) AS request_no, n <= 5 AS allowed, CAST(greatest(0, 5 - n) AS INTEGER) AS remaining
 FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 DAY, ts) ORDER BY ts, event_id) AS n FROM events)"""

HITS = """SELECT *, sum(CASE WHEN g IS NULL OR g > {ttl}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS session
 FROM (SELECT *, event_type <> 'error' AS cacheable, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS g FROM {src})"""
QUERIES["cache_hits"] = lambda spark, d: traffic.cache_hits(read(spark, d, "events"), ["user_id"], "ts", ~failed(), 86_400).select("event_id", "hit")
ORACLES["cache_hits"] = f"""SELECT event_id, coalesce(bool_or(cacheable) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit
 FROM ({HITS.format(ttl=86400, key='user_id', src='events')})"""


def cache_epochs(spark, d):
    """Every hundredth event clears the cache; entries of earlier epochs are gone."""
    clears = F.sum((F.col("event_id") % 100 == 0).cast("int")).over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    log = read(spark, d, "events").withColumn("epoch", clears).withColumn("day", F.to_date("ts"))
    return traffic.cache_hits(log, ["user_id", "day", "epoch"], "ts", ~failed(), 86_400).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count_if("hit").alias("hits"), F.max("epoch").cast("long").alias("clears"))


QUERIES["cache_epochs"] = cache_epochs
EPOCH = "(SELECT *, CAST(ts AS DATE) AS day, sum(CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS epoch FROM events)"
ORACLES["cache_epochs"] = f"""SELECT CAST(day AS VARCHAR) AS day, CAST(count_if(hit) AS BIGINT) AS hits, CAST(max(epoch) AS BIGINT) AS clears FROM (SELECT *, coalesce(bool_or(cacheable) OVER (PARTITION BY user_id, day, epoch, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit
 FROM ({HITS.format(ttl=86400, key='user_id, day, epoch', src=EPOCH)})) GROUP BY day"""

QUERIES["circuit_breaker"] = lambda spark, d: traffic.circuit_breaker(read(spark, d, "events"), "user_id", "ts", failed()).select("event_id", F.col("failures").cast("long").alias("failures"), "block_ms", "blocked_attempt")
ORACLES["circuit_breaker"] = """WITH r AS (SELECT *, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
 f AS (SELECT *, CASE WHEN bad THEN CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS BIGINT) ELSE 0 END AS failures FROM r),
 b AS (SELECT *, CAST(CASE WHEN failures < 2 THEN 0 ELSE least(45000, (failures - 1) * (failures - 1) * 2200) END AS BIGINT) AS block_ms FROM f)
 SELECT event_id, failures, block_ms, coalesce(lag(epoch_us(ts) + block_ms * 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) > epoch_us(ts), false) AS blocked_attempt FROM b"""


def orphan_requests(spark, d):
    """User turns of conversations without an assistant turn right after them."""
    turns = read(spark, d, "conversations")
    starts = turns.where("role = 'user'").select("conv_id", "turn")
    done = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return traffic.orphans(starts, done, ["conv_id", "turn"])


QUERIES["orphan_requests"] = orphan_requests
ORACLES["orphan_requests"] = "SELECT conv_id, turn FROM conversations u WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1)"
QUERIES["log_recent"] = lambda spark, d: read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")
ORACLES["log_recent"] = "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100"
QUERIES["log_by_method"] = lambda spark, d: read(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("slowest"))
ORACLES["log_by_method"] = "SELECT user_id, count(*) AS n, round(max(value), 4) AS slowest FROM events WHERE event_type = 'purchase' GROUP BY user_id"
QUERIES["truncate_log"] = lambda spark, d: read(spark, d, "documents").select("doc_id", F.when(F.length("text") > 600, F.concat(F.left("text", F.lit(600)), F.lit("…"))).otherwise(F.col("text")).alias("logged"))
ORACLES["truncate_log"] = "SELECT doc_id, CASE WHEN length(text) > 600 THEN left(text, 600) || '…' ELSE text END AS logged FROM documents"
QUERIES["mask_secrets"] = lambda spark, d: read(spark, d, "customer").select("c_custkey", F.when(F.col("c_name") != "", F.lit("[REDACTED]")).alias("c_name"), F.concat(F.left("c_mktsegment", F.lit(2)), F.lit("…")).alias("segment"))
ORACLES["mask_secrets"] = "SELECT c_custkey, CASE WHEN c_name <> '' THEN '[REDACTED]' END AS c_name, left(c_mktsegment, 2) || '…' AS segment FROM customer"


def search_summary(spark, d):
    """One row per order as a query: its hits, how many have art, sources, whether it is partial and its cache status."""
    hits = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("source"), F.col("l_discount") > 0.05, F.col("l_tax") > 0.07)
    hits = hits.toDF("query_id", "source", "has_art", "failed")
    out = hits.groupBy("query_id").agg(F.count("*").alias("total"), F.count_if("has_art").alias("artwork_count"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("providers"), F.max("failed").alias("partial"))
    status = F.when(F.col("partial"), "bypass-partial").when(F.col("total") == 0, "bypass-empty").otherwise("stored")
    unavailable = F.col("partial") & (F.col("artwork_count") == 0)
    return out.withColumn("cache_status", status).withColumn("http_status", F.when(unavailable, 503).otherwise(200))


QUERIES["search_summary"] = search_summary
ORACLES["search_summary"] = """SELECT *, CASE WHEN partial THEN 'bypass-partial' ELSE 'stored' END AS cache_status, CASE WHEN partial AND artwork_count = 0 THEN 503 ELSE 200 END AS http_status FROM
 (SELECT l_orderkey AS query_id, count(*) AS total, CAST(count_if(l_discount > 0.05) AS BIGINT) AS artwork_count, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS providers, bool_or(l_tax > 0.07) AS partial FROM lineitem GROUP BY l_orderkey)"""
QUERIES["cache_stats"] = lambda spark, d: traffic.cache_hits(read(spark, d, "events"), ["user_id"], "ts", ~failed(), 86_400).groupBy("user_id").agg(F.max("session").alias("sessions"), F.count_if("hit").alias("hits"), F.count("*").alias("lookups"))
ORACLES["cache_stats"] = f"""SELECT user_id, CAST(max(session) AS BIGINT) AS sessions, CAST(count_if(hit) AS BIGINT) AS hits, count(*) AS lookups FROM (SELECT user_id, session, coalesce(bool_or(cacheable) OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit
 FROM ({HITS.format(ttl=86400, key='user_id', src='events')})) GROUP BY user_id"""

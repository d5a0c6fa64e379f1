"""Search, ranking, linkage and routing queries; parts are catalog records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from songsieve.functions import quality as q
from songsieve.functions import similarity as sim
from songsieve.functions import text as t
from songsieve.operators import linkage
from songsieve.operators import search as s
from songsieve.plans import duck
from songsieve.sources.tables import read, records, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def titles(spark, d):
    """Distinct titles with the smallest id that has each."""
    return records(spark, d).groupBy("title").agg(F.min("id").alias("id"))


T = "(SELECT p_name AS title, min(p_partkey) AS id FROM part GROUP BY p_name)"
NT = f"(SELECT id, title, {duck.norm('title')} AS n FROM {T})"
QUERIES["dice_pairs"] = lambda spark, d: linkage.dice_pairs(titles(spark, d), "id", "title", 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))
ORACLES["dice_pairs"] = f"SELECT * FROM (SELECT a.id AS a, b.id AS b, round({duck.dice('a.n', 'b.n')}, 6)::DOUBLE AS similarity FROM {NT} a JOIN {NT} b ON a.id < b.id) WHERE similarity >= 0.6"


def pairs(spark, d):
    """Titles with a common word, as (a, b) pairs to score."""
    w = titles(spark, d).select("id", "title", F.explode(F.array_distinct(F.split(t.normalized(F.col("title")), " "))).alias("w"))
    side = lambda x: w.select("w", F.col("id").alias(x), F.col("title").alias(f"t{x}"))
    return side("a").join(side("b"), "w").where("a < b").select("a", "b", "ta", "tb").distinct()


PAIRS = f"(SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM (SELECT id, n, unnest(string_split(n, ' ')) AS w FROM {NT}) a JOIN (SELECT id, n, unnest(string_split(n, ' ')) AS w FROM {NT}) b ON a.w = b.w AND a.id < b.id)"
QUERIES["title_similarity"] = lambda spark, d: pairs(spark, d).select("a", "b", F.round(sim.title_similarity(F.concat(F.col("ta"), F.lit(" (Ao Vivo)")), F.concat(F.col("tb"), F.lit(" - Official Video"))), 6).alias("similarity"))
ORACLES["title_similarity"] = f"""SELECT a, b, round(CASE WHEN na = nb THEN 1.0 WHEN contains(na, nb) OR contains(nb, na) THEN least(length(na), length(nb))::DOUBLE / greatest(length(na), length(nb))
 ELSE len(list_intersect(string_split(na, ' '), string_split(nb, ' ')))::DOUBLE / greatest(len(list_distinct(string_split(na, ' '))), len(list_distinct(string_split(nb, ' ')))) END, 6)::DOUBLE AS similarity FROM {PAIRS}"""
QUERIES["same_song"] = lambda spark, d: pairs(spark, d).select("a", "b", F.round(sim.same_song(F.col("ta"), F.lit("Brand A"), F.col("tb"), F.lit("Brand B")), 6).alias("confidence"))
ORACLES["same_song"] = f"SELECT a, b, round({duck.dice('na', 'nb')} * 0.72 + {duck.dice(chr(39) + 'brand a' + chr(39), chr(39) + 'brand b' + chr(39))} * 0.28, 6)::DOUBLE AS confidence FROM {PAIRS}"
QUERIES["request_match"] = lambda spark, d: pairs(spark, d).select("a", "b", sim.matches_request(F.col("ta"), F.lit(""), F.col("tb"), F.lit("x")).alias("matches"))
ORACLES["request_match"] = f"SELECT a, b, {duck.dice('nb', 'na')} >= 0.72 AS matches FROM {PAIRS}"
QUERIES["token_coverage"] = lambda spark, d: spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.round(sim.term_coverage(t.normalized(F.col("text")), t.search_terms(F.lit("idiot the heart, of erst tion"))), 6).alias("coverage"))
ORACLES["token_coverage"] = f"SELECT doc_id, round(len(list_filter(['idiot', 'heart', 'erst', 'tion'], lambda w: contains({duck.norm('text')}, w))) / 4.0::DOUBLE, 6)::DOUBLE AS coverage FROM documents"
QUERIES["ordered_coverage"] = lambda spark, d: spread(read(spark, d, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.round(sim.ordered_coverage(t.normalized(F.col("text")), t.search_terms(F.lit("erst tion heen that"))), 6).alias("coverage"))


def queries_of_nations(spark, d):
    """Free queries: the first word of each title that some order's customer segment asks for."""
    return titles(spark, d).select(F.col("id").alias("query_id"), F.element_at(F.split(t.normalized(F.col("title")), " "), 1).alias("query"))


def once_each(asked):
    """Each distinct query with the smallest id that asks it."""
    return asked.groupBy("query").agg(F.min("query_id").alias("query_id"))


def met(asked, r):
    """Queries with the records that hold them; they meet on the query's longest word, which may be part of a record's word."""
    held = r.select("id", F.explode(F.array_distinct(F.concat(F.split("nt", " "), F.split("na", " "), F.split("ny", " ")))).alias("word"))
    longest = F.array_max(F.transform(F.split("query", " "), lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    parts = asked.select("query_id", "query", longest.alias("part"))
    return parts.join(s.words_holding(parts, held), "part").join(held, "word").select("query_id", "query", "id").distinct().join(r, "id")


def search_local(spark, d):
    """Best records for each query."""
    r = records(spark, d).select("id", t.normalized(F.col("title")).alias("nt"), t.normalized(F.col("artist")).alias("na"), t.normalized(F.col("album")).alias("ny"))
    asked = queries_of_nations(spark, d)
    # titles that begin with one word ask the same: its list is made once and given to each
    scored = met(once_each(asked), r).withColumn("score", s.local_score(F.col("query"), F.col("nt"), F.col("na"), F.col("ny"), F.array("ny")))
    best = s.top(scored.where("score > 0"), "query", [F.desc("score"), F.col("id")], 12).select("query", "id", "rank", F.round("score", 4).alias("score"))
    return asked.join(best, "query").select("query_id", "id", "rank", "score")


QUERIES["search_local"] = search_local
LOCAL = "(CASE WHEN nt = query THEN 85 WHEN contains(nt, query) THEN 60 ELSE 0 END + CASE WHEN na = query THEN 70 WHEN contains(na, query) THEN 45 ELSE 0 END + CASE WHEN contains(ny, query) THEN 66 ELSE 0 END)::DOUBLE"
RECORDS = f"SELECT p_partkey AS id, {duck.norm('p_name')} AS nt, {duck.norm('p_brand')} AS na, {duck.norm('p_type')} AS ny FROM part"
ORACLES["search_local"] = f"""WITH q AS (SELECT id AS query_id, split_part(n, ' ', 1) AS query FROM {NT}), r AS ({RECORDS}), m AS (SELECT query_id, id, {LOCAL} AS score FROM q JOIN r ON contains(nt || '|' || na || '|' || ny, query))
 SELECT query_id, id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m WHERE score > 0) WHERE rank <= 12"""


def local_fields(spark, d):
    """Local scores of all records for wanted titles, artists and themes, and for nothing."""
    r = records(spark, d).select("id", t.normalized(F.col("title")).alias("nt"), t.normalized(F.col("artist")).alias("na"), t.normalized(F.col("album")).alias("ny"))
    word = lambda c: F.element_at(F.split(c, " "), 1)
    want = {"title": F.when(F.col("id") % 4 == 1, word("nt")), "artist": F.when(F.col("id") % 4 == 2, F.col("na")), "theme": F.when(F.col("id") % 4 == 3, word("ny"))}
    return r.select("id", s.local_score(F.lit(""), F.col("nt"), F.col("na"), F.col("ny"), F.array("ny"), want).alias("score"))


QUERIES["search_fields"] = local_fields
ORACLES["search_fields"] = "SELECT p_partkey AS id, [10.0, 55.0, 55.0, 35.0][CAST(p_partkey % 4 AS INTEGER) + 1]::DOUBLE AS score FROM part"


def catalog_rank(spark, d):
    """Relevance of catalog records within each artist, decaying with their place, for queries of four kinds."""
    r = records(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("artist").orderBy("id")) - 1)
    n, a = t.search_normalized(F.col("title")), t.search_normalized(F.col("artist"))
    query = F.when(F.col("id") % 4 == 0, n).when(F.col("id") % 4 == 1, a).when(F.col("id") % 4 == 2, F.concat_ws(" ", n, a)).otherwise("zz")
    return r.select("id", s.catalog_score(query, n, a, F.col("pos"), F.col("id") % 2 == 0).cast("long").alias("score"))


QUERIES["catalog_rank"] = catalog_rank
ORACLES["catalog_rank"] = "SELECT p_partkey AS id, CAST(82 - least(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1, 20) + [32, 26, 18, 0][CAST(p_partkey % 4 AS INTEGER) + 1] + CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END AS BIGINT) AS score FROM part"


def relevance(r, query, want_artist):
    return s.intent_score(query, F.col("nt"), F.col("na"), F.col("score"), F.lit(""), F.col("id") % 2 == 0, F.col("album").isNotNull(), F.lit(False), want_artist)


def intent_rank(spark, d):
    r = spread(records(spark, d), "id").withColumn("nt", t.normalized(F.col("title"))).withColumn("na", t.normalized(F.col("artist")))
    want = F.when(F.col("id") % 4 == 0, F.col("na")).when(F.col("id") % 4 == 1, "brand").when(F.col("id") % 4 == 2, "bran 99").otherwise("")
    return r.select("id", F.round(relevance(r, F.lit("royal green"), want), 4).alias("relevance"))


QUERIES["intent_rank"] = intent_rank
QN, TN, AN = "'royal green'", duck.norm("p_name"), duck.norm("p_brand")


def relevance_sql(query: str, covered: str, want: str) -> str:
    like = lambda c: duck.dice(c, query)
    near = duck.dice("a", want)
    return f"""least(100, greatest(0, score)) * 0.35 + CASE WHEN t = {query} THEN 95 WHEN contains(t, {query}) OR contains({query}, t) THEN 52 ELSE 0 END + {like('t')} * 54 + {like('a')} * 30 + {like("(a || ' ' || t)")} * 34 + {like("(t || ' ' || a)")} * 28 + ({covered}) * 48
 + CASE WHEN {want} = '' THEN 0 WHEN a = {want} THEN 72 WHEN contains(a, {want}) OR contains({want}, a) THEN 48 ELSE {near} * 34 - CASE WHEN {near} < 0.42 THEN 18 ELSE 0 END END + CASE WHEN id % 2 = 0 THEN 3 ELSE 0 END + 2"""


ORACLES["intent_rank"] = f"""SELECT id, round({relevance_sql(QN, "(contains(t || ' ' || a, 'royal')::INTEGER + contains(t || ' ' || a, 'green')::INTEGER) / 2.0::DOUBLE", 'want')}, 4)::DOUBLE AS relevance
 FROM (SELECT p_partkey AS id, p_size AS score, {TN} AS t, {AN} AS a, CASE p_partkey % 4 WHEN 0 THEN {AN} WHEN 1 THEN 'brand' WHEN 2 THEN 'bran 99' ELSE '' END AS want FROM part)"""


def search_ranked(spark, d):
    """The final list of each query: records of one title and artist are one, by relevance, cut."""
    once = records(spark, d).groupBy("title", "artist").agg(F.min("id").alias("id"), F.max("score").alias("score"), F.max("album").alias("album"))
    r = once.select("id", "score", "album", t.normalized(F.col("title")).alias("nt"), t.normalized(F.col("artist")).alias("na"), F.lit("").alias("ny"))
    hits = met(once_each(queries_of_nations(spark, d)), r)
    hits = hits.withColumn("relevance", F.round(relevance(hits, F.col("query"), None), 4))
    return s.ranked(hits.select("query_id", "id", "relevance"), "query_id", 12).select("query_id", "id", "rank")


QUERIES["search_ranked"] = search_ranked
ORACLES["search_ranked"] = f"""WITH q AS (SELECT min(id) AS query_id, split_part(n, ' ', 1) AS query FROM {NT} GROUP BY 2), r AS (SELECT min(p_partkey) AS id, max(p_size) AS score, {TN} AS t, {AN} AS a FROM part GROUP BY p_name, p_brand),
 m AS (SELECT query_id, id, round({relevance_sql('query', '1.0::DOUBLE', "''")}, 4)::DOUBLE AS relevance FROM q JOIN r ON contains(t || '|' || a, query))
 SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, id) AS rank FROM m) WHERE rank <= 12"""


def keyed(spark, d):
    return records(spark, d).withColumn("identity", t.identity(F.col("title"), F.col("artist")))


def dedupe_results(spark, d):
    """One record for each title and artist: the best one, its blanks filled, sources united."""
    r = keyed(spark, d).withColumn("album", F.when(F.col("id") % 3 != 0, F.col("album"))).withColumn("sources", F.col("source"))
    out = linkage.merge_groups(r, "identity", [F.desc("score"), F.col("id")], ["album"], ["sources"], ["score"])
    return out.select("id", "identity", "album", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "score", "members")


QUERIES["dedupe_results"] = dedupe_results
IDENT = rf"trim(regexp_replace({duck.norm('p_name')}, '\b(ao vivo|live|lyrics|letra|official|video oficial|clipe oficial)\b', '', 'g')) || '|' || trim(regexp_replace({duck.norm('p_brand')}, '\b(feat|ft)\b.*$', '', 'g'))"
ORACLES["dedupe_results"] = f"""WITH r AS (SELECT p_partkey AS id, {IDENT} AS identity, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS album, p_partkey % 3 AS source, p_size AS score FROM part)
 SELECT arg_max(id, (score, -id)) AS id, identity, arg_max(album, (score, -id)) FILTER (WHERE album IS NOT NULL) AS album, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources, max(score) AS score, count(*) AS members FROM r GROUP BY identity"""


def best_of_each(spark, d):
    """The best record of each title and artist, some without their album."""
    best = keyed(spark, d).groupBy("identity").agg(F.min(F.struct((-F.col("score")).alias("s"), "id", "title", "artist", "album", "source", "score")).alias("b"))
    return best.select("b.id", "b.title", "b.artist", F.when(F.col("b.id") % 3 != 0, F.col("b.album")).alias("album"), F.col("b.source").alias("sources"), "b.score")


def fuzzy_dupes(spark, d):
    """Records of one song by alike titles and artists, taken in order of score: the one that stays, its blanks filled, sources united."""
    out = linkage.fuzzy_merged(best_of_each(spark, d), ["album"], ["sources"], ["score"])
    return out.select("id", "title", "artist", "album", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"), "score", "members")


QUERIES["fuzzy_dupes"] = fuzzy_dupes
#: Rows in order, one after the other: a row is kept unless a kept one before it is the same song.
ORACLES["fuzzy_dupes"] = f"""WITH RECURSIVE i AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS album, p_partkey % 3 AS source, p_size AS score, {IDENT} AS identity FROM part),
 e AS (SELECT arg_max(i, (score, -id)) AS r FROM i GROUP BY identity), o AS (SELECT row_number() OVER (ORDER BY r.score DESC, r.id) AS k, r.id AS id, r.title AS title, r.artist AS artist, CASE WHEN r.id % 3 <> 0 THEN r.album END AS album, r.source AS source, r.score AS score, {duck.norm('r.title')} AS nt, {duck.norm('r.artist')} AS na FROM e),
 u AS (SELECT DISTINCT nt AS n FROM o), v AS (SELECT DISTINCT na AS n FROM o), tp AS (SELECT a.n AS x, b.n AS y, {duck.dice('a.n', 'b.n')} AS s FROM u a, u b), ap AS (SELECT a.n AS x, b.n AS y, {duck.dice('a.n', 'b.n')} AS s FROM v a, v b),
 l AS (SELECT p.k AS a, q.k AS b FROM o p JOIN tp ON tp.x = p.nt JOIN ap ON ap.x = p.na JOIN o q ON q.nt = tp.y AND q.na = ap.y AND p.k < q.k WHERE tp.s * 0.72 + ap.s * 0.28 >= 0.90),
 near AS (SELECT b, list(a) AS near FROM l GROUP BY b),
 s(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT s.k + 1, CASE WHEN len(list_intersect(kept, near)) > 0 THEN kept ELSE list_append(kept, s.k + 1) END FROM s LEFT JOIN near ON near.b = s.k + 1 WHERE s.k < (SELECT count(*) FROM o)),
 kept AS (SELECT unnest(kept) AS k FROM s WHERE k = (SELECT count(*) FROM o)),
 g AS (SELECT o.*, coalesce((SELECT min(l.a) FROM l JOIN kept ON kept.k = l.a WHERE l.b = o.k AND o.k NOT IN (SELECT k FROM kept)), o.k) AS leader FROM o)
 SELECT arg_min(id, k) AS id, arg_min(title, k) AS title, arg_min(artist, k) AS artist, arg_min(album, k) FILTER (WHERE album IS NOT NULL) AS album, string_agg(DISTINCT CAST(source AS VARCHAR), ',' ORDER BY CAST(source AS VARCHAR)) AS sources, max(score) AS score, count(*) AS members FROM g GROUP BY leader"""
QUERIES["dedupe_best"] = lambda spark, d: keyed(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("score"), "id"))).where("r = 1").select("id", "identity")
ORACLES["dedupe_best"] = f"SELECT arg_max(p_partkey, (p_size, -p_partkey)) AS id, {IDENT} AS identity FROM part GROUP BY 2"
QUERIES["variant_union"] = lambda spark, d: s.top(records(spark, d).dropDuplicates(["title", "artist"]).groupBy("artist", "title").agg(F.lit(1).alias("x")), "artist", [F.col("title")], 4).select("artist", "title", "rank")
ORACLES["variant_union"] = "SELECT artist, title, CAST(rank AS INTEGER) AS rank FROM (SELECT p_brand AS artist, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS rank FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE rank <= 4"


def route_queries(spark, d):
    """Sources in the order in which each query goes to them."""
    plan = F.when(t.is_excerpt(F.col("query")), F.array(F.lit("B"), F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    return read(spark, d, "documents").select("doc_id", F.col("text").alias("query")).select("doc_id", F.posexplode(plan).alias("step", "provider"))


QUERIES["route_queries"] = route_queries
XN = duck.norm("text")
XE = f"(len({duck.words(XN)}) >= 5 OR len({duck.distinct_terms('text')}) >= 5 OR (len({duck.words(XN)}) >= 4 AND length({XN}) >= 26))"
ORACLES["route_queries"] = f"SELECT doc_id, CAST(step AS INTEGER) AS step, CASE WHEN x = (step = 0) THEN 'B' ELSE 'A' END AS provider FROM (SELECT doc_id, {XE} AS x FROM documents), (VALUES (0), (1)) v(step)"


def adaptive_search(spark, d):
    """Second source only for queries whose first one gave no strong hit or too few; then both united."""
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("hit"), (F.col("l_quantity") * 2).alias("score"), (F.col("l_linenumber") % 2).alias("source"))
    first = lines.where("source = 1")
    strong = first.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("n")).where("best >= 78 and n >= 2").select("query_id")
    second = lines.where("source = 0").join(strong, "query_id", "left_anti")
    return s.top(first.unionByName(second), "query_id", [F.desc("score"), F.col("hit")], 3).select("query_id", "hit", "source", "rank")


QUERIES["adaptive_search"] = adaptive_search
ORACLES["adaptive_search"] = """WITH l AS (SELECT l_orderkey AS query_id, l_linenumber AS hit, l_quantity * 2 AS score, l_linenumber % 2 AS source FROM lineitem), s AS (SELECT query_id FROM l WHERE source = 1 GROUP BY query_id HAVING max(score) >= 78 AND count(*) >= 2)
 SELECT query_id, hit, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit) AS rank FROM l WHERE source = 1 OR query_id NOT IN (SELECT query_id FROM s)) WHERE rank <= 3"""
QUERIES["fallback_unmet"] = lambda spark, d: read(spark, d, "customer").select(F.col("c_custkey").alias("request")).join(read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("request")), "request", "left_anti")
ORACLES["fallback_unmet"] = "SELECT c_custkey AS request FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"


def line_windows(spark, d):
    """Windows of one to four lines of each text."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(q.lines(F.col("text"))).alias("pos", "line"))
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, 3)
    return rows.withColumn("next", F.collect_list("line").over(ahead)).select("doc_id", "pos", F.explode(F.sequence(F.lit(1), F.size("next"))).alias("size"), "next").select("doc_id", "pos", "size", F.array_join(F.slice(F.col("next"), F.lit(1), F.col("size")), " ").alias("window"))


QUERIES["line_windows"] = lambda spark, d: line_windows(spark, d).groupBy("doc_id").agg(F.count("*").alias("windows"), F.max(F.length("window")).alias("longest"))
ORACLES["line_windows"] = f"""WITH l AS (SELECT doc_id, {duck.lines('text')} AS ls FROM documents), w AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM l), x AS (SELECT doc_id, ls, p, unnest(range(1, 5)) AS s FROM w)
 SELECT doc_id, count(*) AS windows, CAST(max(length(array_to_string(list_slice(ls, p, p + s - 1), ' '))) AS INTEGER) AS longest FROM x WHERE p + s - 1 <= len(ls) GROUP BY doc_id"""


QUERIES["excerpt_match"] = lambda spark, d: s.excerpt_matches(read(spark, d, "benchmark"), read(spark, d, "documents")).select("item_id", "doc_id", "start", "size", "exact", F.round("score", 4).alias("score"))


def excerpt_filter(spark, d):
    """Texts that hold a passage, whose preview for it makes them candidates."""
    b, docs = read(spark, d, "benchmark"), read(spark, d, "documents")
    pairs = s.phrase_matches(b, docs).select("item_id", "doc_id").join(b.select("item_id", F.col("text").alias("query")), "item_id").join(docs.select("doc_id", "text"), "doc_id")
    shown = pairs.select("item_id", "doc_id", "query", F.lit("").alias("title"), t.preview(F.col("text"), F.col("query"), 240).alias("preview"))
    return s.excerpt_candidates(shown).select("item_id", "doc_id", F.lit(True).alias("verified"))


QUERIES["excerpt_filter"] = excerpt_filter


def lookup_song(spark, d):
    """Exact record for each order line, else the first record of the same brand number."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"))
    r = read(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    first = read(spark, d, "part").groupBy("p_size").agg(F.min_by("p_name", "p_partkey").alias("fallback"))
    out = lines.join(r, "id", "left").withColumn("p_size", (F.col("id") % 50 + 1).cast("int")).join(first, "p_size", "left")
    return out.groupBy("l_orderkey").agg(F.count("title").alias("exact"), F.min(F.coalesce("title", "fallback")).alias("first_title"))


QUERIES["lookup_song"] = lookup_song
ORACLES["lookup_song"] = """SELECT l_orderkey, count(r.p_name) AS exact, min(coalesce(r.p_name, f.fallback)) AS first_title FROM lineitem LEFT JOIN part r ON r.p_partkey = l_partkey AND r.p_partkey % 2 = 0
 LEFT JOIN (SELECT p_size, arg_min(p_name, p_partkey) AS fallback FROM part GROUP BY p_size) f ON f.p_size = l_partkey % 50 + 1 GROUP BY l_orderkey"""


def resolve_song(spark, d):
    """Best two candidates of each request above the least confidence."""
    p = pairs(spark, d).withColumn("confidence", sim.dice(F.col("ta"), F.col("tb")) * 0.72 + 0.28)
    return s.top(p.where("confidence >= 0.54"), "a", [F.desc("confidence"), F.col("b")], 2).select("a", "b", "rank", F.round("confidence", 6).alias("confidence"))


QUERIES["resolve_song"] = resolve_song
ORACLES["resolve_song"] = f"""SELECT a, b, CAST(rank AS INTEGER) AS rank, round(confidence, 6)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY confidence DESC, b) AS rank FROM (SELECT a, b, {duck.dice('na', 'nb')} * 0.72 + 0.28 AS confidence FROM {PAIRS}) WHERE confidence >= 0.54) WHERE rank <= 2"""
QUERIES["union_sources"] = lambda spark, d: read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")).unionByName(read(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)
ORACLES["union_sources"] = "SELECT s_name AS name, s_nationkey AS nation, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer"


def ordered_distinct(spark, d):
    """The flag that each part was first seen with, and how many it has; of lines that are equal in order and number the first of the table counts.

    As its SQL has it, lines without a flag are not seen, and those without an order or a number come last.
    """
    lines = read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = [x for c in ("l_orderkey", "l_linenumber") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = F.min(F.when(F.col("l_returnflag").isNotNull(), F.struct(*order, "file", "row", "l_returnflag")))
    return lines.groupBy("l_partkey").agg(first.alias("f"), F.count_distinct("l_returnflag").alias("n")).select("l_partkey", F.col("f.l_returnflag").alias("first_seen"), "n")


QUERIES["ordered_distinct"] = ordered_distinct
ORACLES["ordered_distinct"] = "SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS first_seen, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_partkey"

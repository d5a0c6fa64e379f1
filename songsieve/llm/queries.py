"""Registered queries of this subpackage: thin digests over the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songsieve.llm import ann, bwt_dedup, collocations, html_text, jaccard, mixing, neardup, periodic, pieces, pii, rans, secrets, toxicity
from songsieve.llm.common import read

#: Ids of the byte-level vocabulary.
BYTE_BPE_IDS = 50_257


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; never a copy of our own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles have a Jaccard of 0.9 or more."""
    got = jaccard.classes(read(spark, sf_dir, "documents"), n=3, percent=90)
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every row whose id is divisible by 100."""
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from a written file of token ids."""
    back = rans.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), BYTE_BPE_IDS)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of embeddings of the same label by a cosine of 0.93 or more."""
    return neardup.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.93)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets per document: counts of the base kinds, a digest of their spans, all spans."""
    found = secrets.spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *[count(r.name).alias(f"n_{r.name}") for r in secrets.BASE],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document by a model fitted on the labels."""
    docs = read(spark, sf_dir, "documents")
    got = toxicity.scored(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    held_out = toxicity.remainder(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 2
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, with its source's target."""
    return mixing.planned(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document left when 100-byte strings that also start earlier are removed."""
    return bwt_dedup.without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as unigram pieces, and a digest of the text decoded from them."""
    got = pieces.with_pieces(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return got.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data per document: counts of the base kinds, a digest of their spans, all spans."""
    found = pii.spans(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["rank"] < len(pii.BASE))
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in pii.BASE],
        F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
        secrets.listed(F.col("found")).alias("spans"),
    )


def _repeating(docs: DataFrame) -> DataFrame:
    """Documents whose id's crc32 ends in 0 repeat a part of their words from a place on, both given by that number."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")

    of_words = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, of_words).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, digests of them and of the text with one copy of each period."""
    found = periodic.with_runs(_repeating(read(spark, sf_dir, "documents")))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -first["length"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        first["start"].alias("start"),
        length.alias("length"),
        first["period"].alias("period"),
        F.floor(length * 1000 / first["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two to five words of each language."""
    return collocations.collocations(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source
), w AS (
  SELECT *, CASE (pos - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s
), r AS (
  SELECT *, row_number() OVER o AS rank, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget,
    sum(cap) OVER (ORDER BY cap / weight, pos ROWS UNBOUNDED PRECEDING) - cap AS before,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, pos ROWS UNBOUNDED PRECEDING) + weight AS left_
  FROM w WINDOW o AS (ORDER BY cap / weight, pos)
), l AS (SELECT *, (budget - before) / left_ AS level FROM r),
f AS (SELECT min(rank) AS first_open FROM l WHERE cap > level * weight),
t AS (
  SELECT l.source, l.source_size, CASE WHEN first_open IS NULL OR rank < first_open THEN cap
    ELSE (SELECT level FROM l l2, f f2 WHERE l2.rank = f2.first_open) * weight END AS target
  FROM l, f
), j AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM j
"""


def _reach(links: str, nodes: str) -> str:
    """Common tables ``reach`` (a, b) and ``comp`` (id, component) over symmetric links (a, b)."""
    return f"""reach AS (SELECT id AS a, id AS b FROM {nodes} UNION SELECT reach.a, l.b FROM reach JOIN {links} l ON reach.b = l.a), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)"""


OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
r AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s),
l AS (SELECT p.id AS a, q.id AS b FROM r p JOIN r q ON p.x = q.x AND p.id <> q.id GROUP BY p.id, q.id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
{_reach('l', 's')}
SELECT s.id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component AS component_id FROM s JOIN comp USING (id)
"""

OP5_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND len(p.x) = len(q.x) AND p.id <> q.id WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a), e AS (SELECT vec_id AS id FROM embeddings), {_reach('l', 'e')}
SELECT e.id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, component = e.id AS kept FROM e JOIN comp USING (id) LEFT JOIN n USING (id)
"""


def _spans_sql(rank: int, rule: secrets.Rule) -> str:
    rx = rule.regex.replace("'", "''")
    m, g, p = f"regexp_extract_all(t, '{rx}')", f"regexp_extract_all(t, '{rx}', {rule.group})", f"string_split_regex(t, '{rx}')"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
    start = f"CAST({total(f'list_slice({p}, 1, i)')} + {total(f'list_slice({m}, 1, i - 1)')} AS BIGINT)"
    made = f"list_transform(range(1, len({m}) + 1), lambda i: {{'start': {start}, 'rank': {rank}, 'kind': '{rule.name}', 'stop': {start} + length({m}[i]), 'checked': length({g}[i])}})"
    return f"list_filter({made}, lambda z: z.checked >= {rule.least})"


_LISTED = "array_to_string(list_transform(list_sort({0}), lambda z: z.kind || ':' || z.start || ':' || z.stop), ',')"
_BASE = [f"s_{r.name}" for r in secrets.BASE]
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, {', '.join(f'{_spans_sql(k, r)} AS s_{r.name}' for k, r in enumerate(secrets.RULES))} FROM d)
SELECT doc_id, {', '.join(f'CAST(len(s_{r.name}) AS BIGINT) AS n_{r.name}' for r in secrets.BASE)}, sha256({_LISTED.format(' || '.join(_BASE))}) AS base_sha256, {_LISTED.format(' || '.join(f's_{r.name}' for r in secrets.RULES))} AS spans FROM s
"""


_DIGITS = "regexp_replace(m[i], '[^0-9]', '', 'g')"
_TURNED = "substr(replace(m[i], ' ', ''), 5) || left(replace(m[i], ' ', ''), 4)"
#: Checks of a match m[i]: a digit doubled for Luhn is looked up at an offset, IBANs are taken sign by sign.
_SQL_VALID = {
    "ip": rf"regexp_matches(m[i], '^{pii.IP_PART}(?:\.{pii.IP_PART}){{3}}$')",
    "card": f"(length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j: CAST(substr('01234567890246813579', CAST(substr(reverse({_DIGITS}), j, 1) AS INT) + CASE WHEN j % 2 = 0 THEN 11 ELSE 1 END, 1) AS INT))) % 10 = 0)",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": f"list_reduce(list_prepend(0, list_transform(string_split({_TURNED}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
    "ssn": f"NOT regexp_matches(m[i], '{pii.SSN_WRONG}')",
    "routing": "list_sum(list_transform(range(1, 10), lambda j: CAST(substr(m[i], j, 1) AS INT) * CASE j % 3 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 1 END)) % 10 = 0",
}


def _personal_sql(rank: int, kind: pii.Kind) -> str:
    """Confirmed spans of a kind: its matches with the text before and after each."""
    m, p = f"regexp_extract_all(t, '{kind.plain}')", f"string_split_regex(t, '{kind.plain}')"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
    start = f"CAST({total('list_slice(p, 1, i)')} + {total('list_slice(m, 1, i - 1)')} AS BIGINT)"
    near = f"translate(right(p[i], {pii.NEAR}) || ' ' || left(p[i + 1], {pii.NEAR}), '{pii.UPPER}', '{pii.LOWER}')"
    ok = _SQL_VALID.get(kind.name, "true")
    if kind.apart:
        ok = f"NOT regexp_matches(right(p[i], 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(p[i + 1], 1), '[A-Za-z0-9]') AND {ok}"
    score = f"{kind.prior} + CASE WHEN regexp_matches({near}, '{pii.word_regex(kind.context)}') THEN {pii.RAISED} ELSE 0 END - CASE WHEN regexp_matches({near}, '{pii.word_regex(pii.MADE_UP)}') THEN {pii.LOWERED} ELSE 0 END"
    made = f"list_transform(range(1, len(m) + 1), lambda i: {{'start': {start}, 'rank': {rank}, 'kind': '{kind.name}', 'stop': {start} + length(m[i]), 'score': CASE WHEN {ok} THEN {score} ELSE 0 END}})"
    return f"SELECT k, list_filter({made}, lambda z: z.score >= {pii.LEAST}) AS s FROM (SELECT k, {m} AS m, {p} AS p FROM d)"


_OP11_EACH = ", ".join(f"s{n} AS ({_personal_sql(n, k)})" for n, k in enumerate(pii.KINDS))
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), {_OP11_EACH},
a AS (SELECT doc_id, {', '.join(f's{n}.s AS v{n}' for n in range(len(pii.KINDS)))} FROM d {' '.join(f'JOIN s{n} USING (k)' for n in range(len(pii.KINDS)))})
SELECT doc_id, {', '.join(f'CAST(len(v{n}) AS BIGINT) AS n_{k.name}' for n, k in enumerate(pii.BASE))}, sha256({_LISTED.format(' || '.join(f'v{n}' for n in range(len(pii.BASE))))}) AS base_sha256, {_LISTED.format(' || '.join(f'v{n}' for n in range(len(pii.KINDS))))} AS spans FROM a
"""

# crc32 of the id's digits bit by bit; runs from pairs of equal words, as islands of each distance
OP12_SQL = r"""
WITH c AS (
  SELECT row_number() OVER () AS k, doc_id, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(x AS BIGINT) FOR x IN range(8)]), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS h FROM documents
), o AS (
  SELECT k, doc_id, h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM c
), p AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, (h // 10) % nullif(len(w), 0) AS a, 1 + (len(w) - (h // 10) % nullif(len(w), 0)) // (3 + (h // 10) % 8) AS p FROM o
), d AS (
  SELECT k, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p
), x AS (SELECT k, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
e AS (SELECT p.k, q.i - p.i AS q, p.i FROM x p JOIN x q ON p.k = q.k AND p.word = q.word AND p.i < q.i AND 2 * (q.i - p.i) <= p.n),
g AS (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS island FROM e),
s AS (SELECT k, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY k, q, island HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT k, start, length, min(q) AS period FROM s GROUP BY k, start, length),
t AS (SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, min({'l': -length, 's': start, 'p': period}) AS best FROM r GROUP BY k),
v AS (SELECT x.k, string_agg(word, ' ' ORDER BY i) AS left_ FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = x.k AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY x.k)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(-best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period, CAST(-best.l * 1000 // best.p AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (k) LEFT JOIN v USING (k)
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= 100),
s AS (SELECT lang, a AS around, unnest(flatten(list_transform(range(2, k), lambda j: list_transform(range(1, k - j + 2), lambda i: array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' '))))) AS phrase FROM c),
i AS (SELECT lang, phrase, max(around) AS around FROM s GROUP BY ALL),
u AS (SELECT lang, phrase, k, a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM c),
b AS (
  SELECT u.lang, u.phrase, u.a, n.n, min({'score': CAST(1000::HUGEINT * u.a * n.n // (l.a::HUGEINT * r.a) AS BIGINT), 'cut': cut, 'l': l.a, 'r': r.a}) AS best
  FROM u JOIN n USING (lang) JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') GROUP BY ALL
), k AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank, phrase, a, best.l AS l, best.r AS r, n, best.score AS score FROM k)
SELECT * FROM t WHERE rank <= 2000
"""


def queries() -> dict:
    return {
        "op1_html_text": op1_html_text,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_nearest": op3_nearest,
        "op4_token_ids": op4_token_ids,
        "op5_embedding_dups": op5_embedding_dups,
        "op6_secret_scans": op6_secret_scans,
        "op7_toxicity": op7_toxicity,
        "op8_mixing": op8_mixing,
        "op9_repeated_bytes": op9_repeated_bytes,
        "op10_pieces": op10_pieces,
        "op11_pii": op11_pii,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict:
    return {"op2_ngram_jaccard": OP2_SQL, "op5_embedding_dups": OP5_SQL, "op6_secret_scans": OP6_SQL, "op8_mixing": OP8_SQL, "op11_pii": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_collocations": OP13_SQL}

"""Personal data against a plain version, SQL, and the defined cases."""

import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from songsieve.llm import pii, queries, secrets


def plain(text):
    """Base spans by the contract, one kind at a time."""
    found = []
    for rank, kind in enumerate(pii.BASE):
        for m in re.finditer(kind.plain, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            ok = True
            if kind.name == "ip":
                ok = all(int(x) <= 255 for x in m.group().split("."))
            elif kind.name == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                ok = 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
            elif kind.name == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                found.append((m.start(), rank, kind.name, m.end()))
    return sorted(found)


def found_in(spark, texts):
    got = pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id")
    return [[(s.start, s.rank, s.kind, s.stop) for s in r.found] for r in got.collect()]


def test_base_spans_equal_a_plain_version(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "x.y+z@d-e.f_g@h.i", "@", ".", "1.2.3.4", "255.255.0.256", "0007.1.2.3", "4111 1111 1111 1111", "5500-0000-0000-0004", "+49 (30) 123-4567", "+", "-", " ", "é", "\n", "9" * 15, "12", "AB", "DE89370400440532013000"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    for text, got in zip(texts, found_in(spark, texts), strict=True):
        assert [s for s in got if s[1] < len(pii.BASE)] == plain(text), text


def test_checksums_and_context_decide_the_other_kinds(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 THEN", "pay DE88370400440532013000", "XDE89370400440532013000", "my SSN: 123-45-6789", "code 123-45-6789", "ssn 666-45-6789", "born 01/02/1980.", "on 01/02/1980.", "routing 021000021", "routing 021000022", "the sample bank account DE89370400440532013000, an example", "example DE89370400440532013000"]
    kinds = [[s[2] for s in x if s[1] >= len(pii.BASE)] for x in found_in(spark, texts)]
    assert kinds == [["iban"], [], [], ["ssn"], [], [], ["birth"], [], ["routing"], [], ["iban"], []]


def test_long_runs_and_many_matches_take_linear_time(spark):
    began = time.perf_counter()
    got = found_in(spark, ["1" * 300_000, "a" * 300_000, "+" + "1" * 300_000, "1." * 100_000, "a@" * 100_000, "x@y.z " * 100_000])
    assert [len(x) for x in got[:5]] == [0, 0, 0, 25_000, 0]
    assert [s[0] for s in got[5]] == list(range(0, 600_000, 6))
    assert time.perf_counter() - began < 60


def test_odd_rows(spark, odd):
    got = {(r.doc_id, r.rank): r.found for r in pii.spans(odd, keep=("rank",)).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (None, 1), (5, 1), (6, 1), (7, 1)} and not any(got.values())
    assert pii.spans(odd).count() == odd.count() and pii.spans(odd.limit(0)).count() == 0


def test_the_query_equals_its_sql(spark, frame, tmp_path):
    texts = [None, "", "a@b.c and 4111 1111 1111 1111, ssn 123-45-6789", "é 1.2.3.4 born 1980-02-01 iban DE89 3704 0044 0532 0130 00", "routing 021000021 or 021000021", "write to x@y.zz, +1 (555) 010-9999", "GB82 WEST 1234 5698 7654 32"]
    frame([(i, t, "a") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_pii(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.OP11_SQL).fetchall())
    assert got[2][6] == "email:0:5,card:10:29,ssn:35:46" and got[3][6] == "ip:2:9,birth:15:25,iban:31:58"


def test_redaction_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "to a@b.c or +49 30 1234567 now")], "doc_id long, text string")
    assert pii.spans(df).select(secrets.redacted(F.col("text"), F.col("found"), "[PII]")).first()[0] == "to [PII] or [PII] now"

"""A training corpus from ``documents``, in five stages that each apply one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and reread as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songsieve.llm import jaccard, mixing, pieces, secrets, toxicity
from songsieve.llm.common import read, shared_dir, small_batches
from songsieve.llm.queries import tokenizer_file


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts stay; rows that repeat an id are judged each on its own text; without
    labels of both kinds, and in an empty table, all rows stay; other columns pass unread.
    """
    small_batches(spark)
    return toxicity.kept(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word-shingle sets of Jaccard 0.8 or more stays, that of the smallest id.

    Texts without words and rows without an id stay; of rows that repeat an id one stays, of the
    longest text; an empty table stays empty; other columns pass unread.
    """
    small_batches(spark)
    return jaccard.representatives(docs, n=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become marks; documents all stay.

    Null and empty texts stay as they are; each row is searched on its own text, whatever its id;
    other columns pass unread, whatever their names; ``n_chars`` follows a changed text.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secrets.spans(docs.withColumn("__null", F.col("text").isNull()), keep=(*rest, "__null"), out="__found")
    hit = F.size("__found") > 0
    clean = found.withColumn("__text", F.when(hit, secrets.redacted(F.col("text"), F.col("__found"))).when(~F.col("__null"), F.col("text")))
    values = {"text": F.col("__text"), "n_chars": F.when(hit, F.length("__text").cast("long")).otherwise(F.col("n_chars"))}
    return clean.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source's words come near its target.

    A null source is one of its own, the last; texts without words have size 0 and follow their
    source's rate; rows that repeat an id share its draw; an empty table stays empty.
    """
    return mixing.mixed(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as unigram pieces, with a digest of the text decoded from them.

    Null and empty texts have no pieces; rows that repeat an id are separate; an empty table gives
    no rows; other columns are not read.
    """
    small_batches(spark)
    got = pieces.with_pieces(docs, tokenizer_file("piece_bpe_32k.model"))
    return got.select("doc_id", "ids", "n_pieces", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_duplicates),
    ("secret_scans", without_secrets),
    ("mixing", mixed_sources),
    ("pieces", as_pieces),
]

#: The fitted model, exact shingle classes and the pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, sizes and digests of the corpus that the stages make."""
    return run(spark, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def queries() -> dict:
    return {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

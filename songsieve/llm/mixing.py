"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, water-filled targets give each source a repetition
rate, and each document is emitted floor(rate) times plus one more copy drawn from
a hash of its id with the rate's fraction as probability.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; a null id is hashed like the empty id; rows that repeat an id share its draw;
an empty table gives no rows; other columns of the input pass through unchanged,
except those named like an output column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.llm.common import small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all words; a target stops at ``limit`` times its source and the
    excess is shared anew. In order of limit/weight the stopped sources are a prefix,
    so cumulative sums find the common level without iterating.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = by_source.withColumn("pos", n).withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[(F.col("pos") - 1) % len(weights)])
    weighed = weighed.withColumn("cap", F.lit(limit) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    everything = Window.partitionBy(F.lit(0))
    levels = (
        weighed.withColumn("rank", F.row_number().over(order))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("stopped_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("level", (F.col("budget") - F.col("stopped_before")) / F.col("weight_left"))
        .withColumn("is_open", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("first_open", F.min(F.when(F.col("is_open"), F.col("rank"))).over(everything))
        .withColumn("common", F.max(F.when(F.col("rank") == F.col("first_open"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("first_open").isNull() | (F.col("rank") < F.col("first_open")), F.col("cap")).otherwise(F.col("common") * F.col("weight"))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the key and the seed."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def planned(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix", **targets) -> DataFrame:
    """One row per document: (key, source, size, source_size, target, copies, taken)."""
    sizes = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    per_source = written(source_targets(sizes, **targets), "targets")
    t = small(per_source).withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(unit_hash(F.col("key"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return (
        sizes.join(t, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("copies", copies.cast("long"))
        .select(F.col("key").alias(key), "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = "mix", **targets) -> DataFrame:
    """The documents themselves, each repeated as often as the plan says; columns unchanged."""
    sizes = written(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    per_source = written(source_targets(sizes, **targets), "targets")
    rates = per_source.select(F.col("source").alias("__source"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("__rate"))
    rate = F.col("__rate")
    copies = (F.floor(rate) + F.when(unit_hash(F.col(key), seed) < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return (
        docs.join(small(written(rates, "rates")), F.col(source).eqNullSafe(F.col("__source")))
        .withColumn("__copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))
        .drop("__source", "__rate", "__copy")
    )

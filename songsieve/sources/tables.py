"""The library's input tables, and the song-like views of them that the queries use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records: title, artist, album and a base score from the parts."""
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"), F.col("p_size").alias("score"), (F.col("p_partkey") % 3).alias("source")
    )


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The rows dealt by their key to as many tasks as there may be, for work that is heavy a row: a file of few parts makes few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *key)


def staged(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder named in spark.checkpoint.dir and read from there by all that follows.

    Written by columns, so that a reader takes those it needs, and packed, as texts are most of it. A local session may leave the setting out
    and gets a temporary folder; a cluster may not.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="songsieve-"))
    path = f"{sc.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

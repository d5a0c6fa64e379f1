"""Shared helpers: tables written to the shared folder, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import suppress
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in bytes, that may be broadcast; beyond it the plain join is used.
BROADCAST_BYTES = 16 << 20

def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which driver and executors share.

    A local session, whose driver and executors are one process, may leave it unset and gets a
    temporary folder; a cluster may not.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="songsieve-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage: later stages reread files that outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written`, once nothing needs them."""
    path = getattr(df, "_written_path", None)
    if path is None:
        return
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table of numbers for broadcast if its counted rows are within the bound.

    A row is taken to need 16 bytes and 16 a column in the hashed table; beyond the bound the
    plain join is used.
    """
    if any(f.dataType.typeName() in ("string", "binary", "array", "map", "struct") for f in df.schema):
        return df
    return F.broadcast(df) if df.count() * 16 * (1 + len(df.columns)) <= most else df


def slices(batches, rows: int = 256):
    """Arrow batches cut small, so that a task holds few texts as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def trimmed(run):
    """A ``mapInArrow`` function that hands freed memory back to the system when its task ends.

    Workers are kept between tasks; what they hold idle counts against their executor.
    """

    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


#: Rows of an Arrow batch where texts are long: a batch is held by the executor and by its worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows of an Arrow batch to ``BATCH_ROWS``."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: (node, component), smallest node as label.

    Alternates the large-star and the small-star step, each an aggregation and an
    equi-join, until the edges stay as they are. Every round's edges are a written
    table. Nodes without an edge have no row; an empty input gives no rows.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    seen = state(now)
    for _ in range(rounds):
        if not seen["n"]:
            break
        pairs = both(now)
        least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = pairs.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points from the larger node a to the smaller node b
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(step.union(lowest.select("a", "m")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        forget(now)
        now, before, seen = after, seen, state(after)
        if before == seen:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Unit vectors are projected on many random directions and sorted along each. Around every
query's projection a window is laid; a pair is a candidate if it meets in the windows of at
least a calibrated number of directions, and only candidates are verified by cosine. The
count is the largest at which a pair right at the threshold is missed with a probability
of at most ``MISS``.

Equal vectors of a label are one member with a multiplicity. The members of a label are
dealt to tiles of bounded size, and each pair of tiles is one unit of work, so a label
that holds a third of all rows spreads over many tasks. A unit returns, for each vector,
the number of its links and one link of a spanning forest, never the pairs themselves.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows with a null label, link with nothing; vectors of different lengths never link; rows
that repeat an id are separate vectors of that id; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.llm.common import components, small, written

DIRECTIONS = 64
WIDTH = 1.0  # half width of a window, in standard deviations of a pair at the threshold
MISS = 1e-4  # probability of missing a pair at the threshold
TILE = 2048  # vectors in a tile, about
CHUNK = 256  # queries counted at once
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def calibrated(directions: int = DIRECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Number of collisions that a pair at the threshold reaches but for probability ``miss``."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for count in range(directions + 1):
        below += math.comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > miss:
            return count
    return directions


def candidates(a: np.ndarray, b: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors (rows of a, rows of b) with enough window collisions."""
    directions = np.random.default_rng(SEED).normal(size=(a.shape[1], DIRECTIONS))
    pa_, pb_, least = a @ directions, b @ directions, calibrated()
    order = np.argsort(pb_, axis=0)
    rank = np.empty_like(order, dtype=np.uint16 if len(b) < 1 << 16 else np.uint32)
    np.put_along_axis(rank, order, np.arange(len(b), dtype=rank.dtype)[:, None], axis=0)
    rank = np.ascontiguousarray(rank.T)
    ordered = np.take_along_axis(pb_, order, axis=0)
    low = np.stack([np.searchsorted(ordered[:, j], pa_[:, j] - WIDTH * radius, "left") for j in range(DIRECTIONS)])
    high = np.stack([np.searchsorted(ordered[:, j], pa_[:, j] + WIDTH * radius, "right") for j in range(DIRECTIONS)])
    rows, cols = [], []
    for at in range(0, len(a), CHUNK):
        count = np.zeros((min(CHUNK, len(a) - at), len(b)), np.uint8)
        for j in range(DIRECTIONS):
            start = low[j, at : at + CHUNK, None].astype(rank.dtype)
            wide = (high[j, at : at + CHUNK, None] - low[j, at : at + CHUNK, None]).astype(rank.dtype)
            count += rank[j][None, :] - start < wide  # unsigned: ranks before the window wrap around
        r, c = np.nonzero(count >= least)
        rows.append(r + at)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def members(rows: DataFrame) -> DataFrame:
    """(label, vector, rep, copies): equal usable vectors of a label as one member."""
    return rows.where(F.col("label").isNotNull() & usable(F.col("vector"))).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))


def linked_members(of: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root): links to other members, copies counted, and one link of a forest."""
    sized = of.groupBy("label", F.size("vector").alias("dim")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    sized = small(written(sized, "labels")).select(F.col("label").alias("l"), F.col("dim").alias("d"), "tiles")
    dealt = of.join(sized, (F.col("label") == F.col("l")) & (F.size("vector") == F.col("d"))).withColumn("tile", F.pmod(F.xxhash64("rep", "vector"), "tiles").cast("int"))
    tiles = written(dealt.groupBy("label", "d", "tiles", "tile").agg(F.collect_list(F.struct("rep", "copies", "vector")).alias("m")), "tiles")
    units = lambda lo, hi, which, m: tiles.select("label", "d", F.col("tile").alias(lo), F.explode(F.sequence(*which)).alias(hi), F.col("m").alias(m))
    one = units("lo", "hi", (F.col("tile"), F.col("tiles") - 1), "ma")
    two = units("hi", "lo", (F.lit(0), F.col("tile")), "mb")
    work = one.join(two, ["label", "d", "lo", "hi"]).select("d", (F.col("lo") == F.col("hi")).alias("same"), "ma", "mb")
    radius = math.sqrt(2 - 2 * cosine)

    def parts(cell, d: int):
        flat = cell.values
        ids, copies = flat.field("rep").to_numpy(zero_copy_only=False), flat.field("copies").to_numpy(zero_copy_only=False)
        v = np.array(flat.field("vector").to_pylist(), np.float64).reshape(-1, d)
        return ids, copies, v, np.sqrt((v * v).sum(axis=1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                d, same = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ia, ca, a, la = parts(batch.column(2)[i], d)
                ib, cb, b, lb = (ia, ca, a, la) if same else parts(batch.column(3)[i], d)
                x, y = candidates(a / la[:, None], b / lb[:, None], radius)
                sure = (a[x] * b[y]).sum(axis=1) / (la[x] * lb[y]) >= cosine
                x, y = x[sure], y[sure]
                if same:
                    x, y = x[x != y], y[x != y]
                    links = np.bincount(x, weights=ca[y], minlength=len(ia)).astype(np.int64)
                    ids, root = ia, forest(len(ia), x, y)
                else:
                    links = np.concatenate([np.bincount(x, weights=cb[y], minlength=len(ia)), np.bincount(y, weights=ca[x], minlength=len(ib))]).astype(np.int64)
                    ids, root = np.concatenate([ia, ib]), forest(len(ia) + len(ib), x, y + len(ia))
                has = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[has], pa.int64()), pa.array(links[has], pa.int64()), pa.array(ids[root][has], pa.int64())], names=["rep", "links", "root"])

    return work.mapInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: (key, n_links, component_id, kept)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    of = written(members(rows), "members")
    found = written(linked_members(of, cosine), "links")
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = of.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    out = rows.join(written(known, "known"), (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))

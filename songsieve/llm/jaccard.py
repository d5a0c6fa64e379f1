"""N-gram Jaccard join over parity sketches.

A document is the set of its distinct n-word shingles. Shingle hashes are dealt to the
blocks of a sketch, each block the XOR of the 64-bit hashes in it, so the number of blocks
in which two sketches differ never exceeds the size of the sets' symmetric difference. For
two sets of a size band that are similar enough that difference is at most D; with D + 1 + e
blocks at least e + 1 agree. Empty blocks, which unlike texts share by chance, are left out
of the join where a document has at most e of them (one of the agreeing blocks is then a
fuller one); a document with more of them joins on all its blocks.

The same bound says how many blocks a set shares with any similar one at least; sets that
share fewer with all others together are dropped. The members that stay get a compact parity
sketch, in which every shingle flips one bit; the Hamming distance of two of them never
exceeds the symmetric difference either, so a pair beyond the bound is dropped unseen. The
others are verified on the whole sets.

Pairs are not formed within whole groups. Each block's first member meets the others, links
make components, and in blocks that still hold several components a few members of the
largest meet all members outside it, round after round, while that merges components. The
pairs of different components left are then compared by their parity sketches, in the rarer
blocks of each set, one of which similar sets share as well. So the classes are exact: no link
between different texts is lost, none is added.

Defined cases: null and empty texts, and texts without words, have an empty set and link
with nothing; a text of fewer than n words has one shingle, the whole sequence; equal sets
form one class whatever their number; rows that repeat an id are one document with the
longest of their texts; null ids are one row that links with nothing; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songsieve.llm.common import components, forget, slices, small, trimmed, written

BAND = 1.5  # ratio of the sizes at the ends of a band
SPARE = 0.2  # spare blocks for each needed one
MEMO = 150_000  # words whose hashes a worker keeps
LEAST_BITS = 256  # of a parity sketch
WIDE = 512  # partners of a set, or members of a block, that a task takes at once
HEADS = 4  # new heads of a block in a round
ROUNDS = 8
EASE = 8  # pairs a row of the groups that are few enough to be formed
EMPTY = np.uint64(0x9E3779B97F4A7C15)  # stands for an empty block where such blocks take part


class Shingles:
    """Sets of 64-bit shingle hashes; hashes of words are remembered."""

    def __init__(self, n: int):
        self.n, self.memo = n, {}

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of a text's shingles."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.array([], np.uint64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : k + len(out)]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ out >> np.uint64(32))


def bound(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of sets of sizes a and b whose Jaccard is percent/100 or more."""
    return (100 - percent) * (a + b) // (100 + percent)


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


@lru_cache(maxsize=64)
def floors(most: int) -> tuple[int, ...]:
    """Least sizes of the bands, up to one beyond ``most``."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return tuple(out)


@lru_cache(maxsize=4096)
def bands(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, blocks, spare blocks) of the bands that a set of a size takes part in.

    These are its own band and those above in which a larger set may be similar to it.
    The largest pair of a band sets the number of its blocks.
    """
    least = floors(2 * size * 100 // percent)
    i = max(k for k, f in enumerate(least) if f <= size)
    out = []
    for k in range(i, len(least) - 1):
        if k > i and size * 100 < percent * least[k]:
            break
        needed = bound(least[k + 1] - 1, least[k + 1] - 1, percent) + 1
        spare = int(SPARE * needed)
        out.append((k, needed + spare, spare))
    return tuple(out)


def sketch(hashes: np.ndarray, band: int, blocks: int, spare: int) -> tuple[np.ndarray, int]:
    """Keys of the blocks that take part, the same only for the same content of the same block; how many are not empty."""
    at = ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    content = np.zeros(blocks, np.uint64)
    np.bitwise_xor.at(content, at, hashes)
    full = np.bincount(at, minlength=blocks) > 0
    some = int(full.sum())
    use = full if blocks - some <= spare else np.ones(blocks, bool)
    content[~full] = EMPTY
    place = (np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)) * np.uint64(0xD6E8FEB86659FD93)
    key = (content ^ place ^ place >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    # the last bit tells a set's own band from the one above
    return (key & ~np.uint64(1) | np.uint64(band & 1))[use], some


NEVER = 1 << 30


def needs(hashes: np.ndarray, percent: int) -> list[int]:
    """How many blocks, in its even and in its odd band, a set shares with any similar one at least."""
    out, size = [NEVER, NEVER], len(hashes)
    for band, blocks, _ in bands(size, percent) if size else ():
        at = ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
        full = np.count_nonzero(np.bincount(at, minlength=blocks))
        largest = min(size * 100 // percent, floors(2 * size * 100 // percent)[band + 1] - 1)
        out[band & 1] = max(1, full - bound(size, largest, percent))
    return out


def parity(hashes: np.ndarray, bits: int) -> bytes:
    """Parity sketch: every shingle flips one of the bits."""
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def width(size: int) -> int:
    """Bits of a set's parity sketch: a power of two, twice its size at least."""
    return max(LEAST_BITS, 1 << (2 * size - 1).bit_length())


def documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))


def sizes(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Each row's set: its size, two hashes of the whole set, and how many blocks it must share."""

    def run(batches):
        shingles = Shingles(n)
        for part in slices(batches, 512):
            sets = [shingles.of(t) for t in part.column(1).to_pylist()]
            whole = [pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=k) for s in sets], np.uint64).view(np.int64)) for k in (0, 1)]
            least = np.array([needs(s, percent) for s in sets], np.int64).reshape(-1, 2)
            columns = [part.column(0), part.column(2), part.column(3), pa.array([len(s) for s in sets], pa.int64()), *whole, *map(pa.array, least.T)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "chars", "text_hash", "n", "h1", "h2", "need0", "need1"])

    rows = documents(docs, key, text).withColumns({"chars": F.length("text").cast("long"), "text_hash": F.xxhash64("text")})
    return rows.mapInArrow(trimmed(run), "id long, chars long, text_hash long, n long, h1 long, h2 long, need0 long, need1 long")


def blocks(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(id, block): the keys of every row's blocks that take part in the join."""

    def run(batches):
        shingles = Shingles(n)
        for part in slices(batches, 512):
            ids, keys = part.column(0).to_pylist(), []
            for t in part.column(1).to_pylist():
                s = shingles.of(t)
                made = [sketch(s, *band)[0] for band in bands(len(s), percent)] if len(s) else []
                keys.append(np.concatenate(made).view(np.int64) if made else np.array([], np.int64))
            lengths = np.fromiter(map(len, keys), np.int64, len(keys))
            at = pa.array(np.repeat(np.arange(len(ids)), lengths))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.concatenate(keys) if keys else np.array([], np.int64))], names=["id", "block"])

    return documents(docs, key, text).where("id is not null").mapInArrow(trimmed(run), "id long, block long")


def profiles(docs: DataFrame, key: str, text: str, ids: DataFrame, n: int) -> DataFrame:
    """Parity sketches and sorted hashes of the sets of the written table ``ids``.

    Of rows that repeat an id the longest text counts.
    """

    def run(batches):
        shingles = Shingles(n)
        for part in slices(batches):
            sets = [shingles.of(t) for t in part.column(1).to_pylist()]
            bits = pa.array([np.frombuffer(parity(s, width(len(s))), np.int64) for s in sets], pa.list_(pa.int64()))
            columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), bits, pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "bits", "hashes"])

    rows = documents(docs, key, text).join(small(ids), "id", "left_semi")
    rows = rows.groupBy("id").agg(F.max(F.struct(F.length("text"), F.xxhash64("text"), "text")).alias("t")).select("id", "t.text")
    return rows.mapInArrow(trimmed(run), "id long, n long, bits array<long>, hashes binary")


def folded(bits: Column) -> Column:
    """The sketch of half as many bits."""
    half = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def apart() -> Column:
    """Hamming distance of the sketches bits_a and bits_b; the longer is folded where sizes lie on both sides of a power of two."""
    a, b = F.col("bits_a"), F.col("bits_b")
    one, other = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def sized(a: Column, b: Column, percent: int) -> Column:
    """Whether two set sizes are close enough for similar sets."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def allowed(percent: int) -> Column:
    """Largest symmetric difference of two similar sets of n_a and n_b shingles."""
    return F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))


def near(percent: int) -> Column:
    """Whether the sizes and the parity sketches of sets a and b allow that they are similar."""
    return sized(F.col("n_a"), F.col("n_b"), percent) & (apart() <= allowed(percent))


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity sketches differ in no more bits than similar sets may."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(near(percent)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    A task holds the set of one ``a`` and streams those of at most ``WIDE`` partners past it on average.
    """
    pairs = written(possible(pairs, sets, percent), "possible")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / WIDE).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    lead = dealt.select("a", "part", F.col("a").alias("id"), F.lit(False).alias("partner")).distinct()
    rows = lead.union(dealt.select("a", "part", F.col("b").alias("id"), F.lit(True).alias("partner")))
    rows = rows.join(sets.select("id", "hashes"), "id").repartition("a", "part").sortWithinPartitions("a", "part", "partner")

    def run(batches):
        held = None
        for batch in slices(batches, 1024):
            keep = []
            for i, (other, raw) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3), strict=True)):
                s = np.frombuffer(raw.as_buffer(), np.uint64)
                if not other:
                    held = s.copy()
                elif linked(len(held), len(s), len(np.intersect1d(held, s, assume_unique=True)), percent):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    return rows.select("a", "id", "partner", "hashes").mapInArrow(trimmed(run), "a long, b long")


def grouped(rows: DataFrame) -> DataFrame:
    """(block, id) rows with the first and the number of each block's members, two at least."""
    over = "over (partition by block)"
    return rows.select("id", "block").withColumns({"head": F.expr(f"min(id) {over}"), "members": F.expr(f"count(*) {over}")}).where("members > 1")


def pruned(groups: DataFrame, least: DataFrame) -> DataFrame:
    """The groups without sets that share too few blocks to be similar to any other."""
    marked = groups.withColumn("odd", F.col("block").bitwiseAND(F.lit(1)))
    enough = F.when(F.col("odd") == 0, F.col("need0")).otherwise(F.col("need1"))
    ok = marked.groupBy("id", "odd").agg(F.count("*").alias("shared")).join(least, "id").where(F.col("shared") >= enough).select("id", "odd")
    return written(grouped(marked.join(small(written(ok, "able")), ["id", "odd"], "left_semi").select("id", "block").distinct()), "groups")


def mixed(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """(block, id, c) rows, c the component, of the blocks that hold several components."""
    rows = groups.join(small(comp), F.col("id") == F.col("node"), "left").select("block", "id", F.coalesce("component", "id").alias("c"))
    several = rows.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("block")
    return written(rows.join(several, "block", "left_semi"), "mixed")


def open_pairs(rows: DataFrame) -> tuple[int, int]:
    """How many rows there are, and how many pairs of different components the blocks hold."""
    per = rows.groupBy("block", "c").count().groupBy("block").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("q"))
    got = per.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")).first()
    return int(got["rows"] or 0), int(got["pairs"] or 0)


def next_stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of the members outside each block's largest component with a few members of it.

    Those are chosen by a hash, so that the many blocks of the same sets choose the same ones.
    """
    per = rows.groupBy("block", "c").agg(F.count("*").alias("k"), *[F.min(F.struct(F.xxhash64("id", F.lit(turn * HEADS + h)), "id")).alias(f"h{h}") for h in range(HEADS)])
    largest = per.groupBy("block").agg(F.max_by(F.struct(F.col("c").alias("main"), F.array(*[F.col(f"h{h}.id") for h in range(HEADS)]).alias("heads")), F.struct("k", -F.col("c"))).alias("l"))
    out = rows.join(largest.select("block", "l.*"), "block").where("c <> main").select("id", F.explode("heads").alias("head"))
    return out.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()


def remaining(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that may be similar.

    Similar sets share ``need`` blocks at least, so they also share one of those that are left of
    each when its ``need - 1`` most frequent blocks are taken away. Blocks of many members are cut
    into parts, each joined with the whole block; the parity sketches are compared inside the join.
    """
    per = rows.groupBy("block").agg(F.count("*").alias("members"))
    of = Window.partitionBy("id", "odd")
    ranked = rows.join(per, "block").withColumn("odd", F.col("block").bitwiseAND(F.lit(1)))
    ranked = ranked.withColumns({"turn": F.row_number().over(of.orderBy("members", "block")), "all": F.count("*").over(of)})
    need = F.when(F.col("odd") == 0, F.col("need0")).otherwise(F.col("need1"))
    rare = ranked.join(sets.select("id", "need0", "need1"), "id").where(F.col("turn") <= F.col("all") - need + 1).select("block", "id", "c")
    rare = written(rare, "rare")
    parts = rare.groupBy("block").agg(F.ceil(F.count("*") / WIDE).cast("int").alias("parts"))
    full = rare.join(parts, "block").join(sets.select("id", "n", "bits"), "id")
    named = lambda x, part: full.select("block", part.alias("part"), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "c", "n", "bits")])
    left = named("a", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = named("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = left.join(right, ["block", "part"]).where((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & near(percent))
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per id: (id, n, component), the set's size and the smallest id reachable by links."""
    sets = sizes(docs, key, text, n, percent)
    sets = sets.groupBy("id").agg(F.max_by(F.struct("n", "h1", "h2", "need0", "need1"), F.struct("chars", "text_hash")).alias("s")).select("id", "s.*")
    sets = written(sets, "sets")
    # equal sets, however many documents have them, are one member from here on
    reps = sets.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    member = sets.select("id", F.col("n").alias("m"), F.col("h1").alias("m1"), F.col("h2").alias("m2"))
    same = (F.col("m") == F.col("n")) & (F.col("m1") == F.col("h1")) & (F.col("m2") == F.col("h2"))
    copies = written(member.join(reps, same).where("id <> rep").select("id", "rep"), "copies")
    made = blocks(docs, key, text, n, percent).join(small(copies.select("id")), "id", "left_anti")
    groups, used = written(grouped(made), "groups"), []
    for _ in range(2):
        used.append(groups)
        groups = pruned(groups, sets.select("id", "need0", "need1"))
    members = written(groups.select("id").distinct(), "members")
    known = written(profiles(docs, key, text, members, n).join(sets.select("id", "need0", "need1"), "id"), "profiles")

    links = verified(groups.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct(), known, percent)
    comp = written(components(written(links, "links")), "components")
    rest, before = mixed(groups, comp), None
    used += [members, groups, rest]
    for turn in range(ROUNDS):
        rows, pairs = open_pairs(rest)
        if pairs <= EASE * rows or before is not None and pairs > 0.9 * before:
            break
        more = verified(next_stars(rest, turn), known, percent)
        comp = written(components(written(more.union(comp.select("node", "component")), "links")), "components")
        rest, before = mixed(rest.select("block", "id"), comp), pairs
        used.append(rest)
    more = verified(remaining(rest, known, percent), known, percent)
    comp = written(components(written(more.union(comp.select("node", "component")), "links")), "components")
    for t in (*used, known):
        forget(t)

    of = sets.select("id", "n").join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    return of.join(comp, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of one document of each class, the one with the smallest id; columns unchanged.

    Rows with a null id stay; of rows that repeat an id one with the longest text stays.
    """
    away = written(classes(docs, key, text, n, percent).where("id <> component").select(F.col("id").alias("__id")), "away")
    stay = docs.join(small(away), docs[key] == F.col("__id"), "left_anti")
    repeated = written(docs.groupBy(key).count().where("count > 1").where(F.col(key).isNotNull()).select(F.col(key).alias("__id")), "repeated")
    if repeated.isEmpty():
        return stay
    once = stay.join(repeated, F.col(key) == F.col("__id"), "left_anti")
    many = stay.join(repeated, F.col(key) == F.col("__id"), "left_semi").withColumn("__row", F.struct(*[F.col(c) for c in docs.columns]))
    picked = many.groupBy(key).agg(F.max_by("__row", F.struct(F.coalesce(F.length(text), F.lit(0)), F.xxhash64(text))).alias("r")).select("r.*")
    return once.unionByName(picked)

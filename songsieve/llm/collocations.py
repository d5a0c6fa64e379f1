r"""Phrase collocations by dynamic itemset counting.

Texts are lowered in A-Z, cut into pieces at ``[.,;:!?\x0A-\x0D]`` and those into words ``[^\x20\x09]+``;
phrases lie within a piece. The documents are dealt to shards, which are scanned one after the other and then
from the start again. Words are counted from the first scan on. A longer phrase becomes active as soon as the
running counts of both its parts, without its last and without its first word, have reached the threshold; it is
counted in the scans that follow until it has seen every shard once. So scans of several lengths interleave, and
the work ends when nothing is active. Phrases of k words are all known after k cycles; from then on only the
stretches of text that may hold longer ones are scanned.

Which phrases have reached the threshold is kept per length as a bitmap of ``FILTER_BITS`` bits, whatever their
number. Bits are only ever added, and a phrase is counted while its parts are in the present bitmap and were not
all in the one a cycle before: every counted phrase, also one let in by chance, is counted over one whole cycle,
so counts are exact. A fuller bitmap costs work, not correctness. The running counts are a written table.

Scores are exact: products are decimals of 38 digits.

Defined cases: a null text is an empty one and has no words; a null language is ``und``; rows that repeat an id,
and null ids, are rows of their own; empty tables give no rows; other columns do not take part.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from songsieve.llm.common import forget, shared_dir, trimmed, written

#: Scans of a full cycle.
SHARDS = 2
#: Longest phrase, in words.
LONGEST = 5
#: Bits of the bitmap of each length, a power of two.
FILTER_BITS = 1 << 24
#: Bytes of text that a task looks at together, and phrases that it counts before it hands them on.
CHUNK_BYTES, COUNTED = 1 << 20, 300_000
#: Parts of a language's phrases that are ranked apart before the last ranking.
SALTS = 64

COUNTS = "lang string, k int, phrase string, n long"
#: A-Z lowered, ends of pieces as line ends, tabs as spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: An odd number whose powers weigh the bytes of a word.
_WEIGHT = 0x9E3779B97F4A7C15


class _Words:
    """The words of texts by their places in one string of bytes: one space between words, line ends around pieces."""

    def __init__(self, texts: list[bytes | None]):
        data = b"\n" + b"\n".join(t or b"" for t in texts).translate(_PLAIN) + b"\n"
        self.data = re.sub(rb" {2,}", b" ", data) if b"  " in data else data
        at = np.frombuffer(self.data, np.uint8)
        gap = (at == 32) | (at == 10)
        edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.piece = np.cumsum(at == 10, dtype=np.int32)[self.starts]

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, made of their bytes."""
        at, n = np.frombuffer(self.data, np.uint8), len(self.starts)
        powers = np.cumprod(np.full(int((self.ends - self.starts).max(initial=1)), _WEIGHT, np.uint64))
        out = np.zeros(n, np.uint64)
        for cut in range(0, n, 1 << 17):  # so that a long text needs no more memory
            starts, sizes = self.starts[cut : cut + (1 << 17)], (self.ends - self.starts)[cut : cut + (1 << 17)]
            first = np.cumsum(sizes) - sizes
            inside = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            values = at[np.repeat(starts, sizes) + inside]
            out[cut : cut + (1 << 17)] = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[inside], first)
        return (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        return [self.data[i:j] for i, j in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist(), strict=True)]


def _longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that one more word makes of shorter ones."""
    return (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the bitmap for each phrase."""
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mask = np.uint64(bits - 1)
    return ((mixed >> np.uint64(8)) & mask).astype(np.int64), ((mixed >> np.uint64(36)) & mask).astype(np.int64)


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for at in _places(hashes, 8 * len(bitmap)):
        out &= (bitmap[at >> 3] >> (at & 7)) & 1 != 0
    return out


def _start(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(lang.encode(), seed=1)], np.uint64)


class _Phrases:
    """Where phrases whose parts have reached the threshold stand in a list of words."""

    def __init__(self, now: np.ndarray, old: np.ndarray):
        self.now, self.old = now, old

    def places(self, lang: str, words: _Words, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, let in) for k up to ``top``: where both parts of a phrase of k words are in the bitmap, and whether they were a cycle ago."""
        each = words.hashes()
        at = np.arange(len(each))
        phrase = _longer(_start(lang), each)
        before = np.ones(len(at), bool)
        for k in range(2, top + 1):
            reached = _holds(self.now[k - 2], phrase)
            at, phrase, before = at[reached], phrase[reached], before[reached]
            before &= _holds(self.old[k - 2], phrase)
            # both parts: a reached phrase at this place and at the next, in one piece
            pair = np.flatnonzero((at[1:] == at[:-1] + 1) & (words.piece[at[1:]] == words.piece[at[:-1]]))
            before = before[pair] & before[pair + 1]
            at, phrase = at[pair], phrase[pair]
            yield k, at, before
            phrase = _longer(phrase, each[at + k - 1])


class _Count:
    """Counts of phrases of a task, by language and length."""

    def __init__(self, phrases: _Phrases, levels: list[int]):
        self.phrases, self.levels = phrases, levels
        self.found: dict[tuple[str, int], Counter] = {}

    def add(self, lang: str, texts: list[bytes | None]) -> None:
        words = _Words(texts)
        if 1 in self.levels:
            self._of(lang, 1).update(words.data.split())
            self._of(lang, 0)[b""] += len(words.starts)
        if max(self.levels) < 2:
            return
        for k, at, before in self.phrases.places(lang, words, max(self.levels)):
            if k in self.levels:
                self._of(lang, k).update(words.phrases(at[~before], k))

    def _of(self, lang: str, k: int) -> Counter:
        return self.found.setdefault((lang, k), Counter())

    def full(self) -> bool:
        return sum(map(len, self.found.values())) >= COUNTED

    def drained(self) -> Iterator[pa.RecordBatch]:
        for (lang, k), counter in self.found.items():
            m = len(counter)
            phrases = pa.array(list(counter), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array([k] * m, pa.int32()), phrases, pa.array(list(counter.values()), pa.int64())], names=["lang", "k", "phrase", "n"])
        self.found = {}


def _unpacked(filters) -> _Phrases:
    return _Phrases(*[np.frombuffer(zlib.decompress(x), np.uint8).reshape(rows, -1) for rows, x in filters.value])


def _chunks(batches, fields: int) -> Iterator[tuple[tuple, list[bytes | None]]]:
    """The texts of a task by language and further fields, about ``CHUNK_BYTES`` at once, one text at least."""
    held: dict[tuple, list] = {}
    size = 0
    for batch in batches:
        keys = zip(*[batch.column(i).to_pylist() for i in range(fields)], strict=True)
        for key, text in zip(keys, batch.column(fields).cast(pa.binary()), strict=True):
            text = text.as_py()
            held.setdefault(key, []).append(text)
            size += len(text or b"")
            if size >= CHUNK_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _scan(shard: DataFrame, filters, levels: list[int]) -> DataFrame:
    """Counts of the active phrases of the given lengths in a shard; length 0 counts all words."""

    def run(batches):
        count = _Count(_unpacked(filters), levels)
        for (lang,), texts in _chunks(batches, 1):
            count.add(lang, texts)
            if count.full():
                yield from count.drained()
        yield from count.drained()

    return shard.select("lang", "text").mapInArrow(trimmed(run), COUNTS)


def _pruned(table: DataFrame, filters, k: int) -> DataFrame:
    """The shards with only the stretches of words that may hold phrases of more than k words, once all of k words are known.

    Which document a stretch is from does not matter any more; texts are put together.
    """

    def run(batches):
        phrases = _unpacked(filters)
        for (lang, shard), texts in _chunks(batches, 2):
            words = _Words(texts)
            *_, (_, at, _) = phrases.places(lang, words, k + 1)
            if len(at):
                n = len(words.starts) + 1
                kept = np.flatnonzero(np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + k + 1, minlength=n))[:-1] > 0)
                cuts = np.flatnonzero((np.diff(kept) > 1) | (np.diff(words.piece[kept]) != 0))
                first, last = kept[np.append(0, cuts + 1)], kept[np.append(cuts, len(kept) - 1)]
                text = b"\n".join([words.data[i:j] for i, j in zip(words.starts[first].tolist(), words.ends[last].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([text.decode()], pa.string()), pa.array([shard], pa.int32())], names=["lang", "text", "shard"])

    return _dealt(table.select("lang", "shard", "text").mapInArrow(trimmed(run), "lang string, text string, shard int"))


def _bits(reached: DataFrame, filter_bits: int) -> DataFrame:
    """(k, word, bits): 64-bit words of the bitmaps that hold the phrases."""

    def run(batches):
        for batch in batches:
            df = batch.to_pandas()
            parts = []
            for (lang, k), group in df.groupby(["lang", "k"]):
                words = _Words([p.encode() for p in group["phrase"]]).hashes().reshape(-1, k)
                h = np.repeat(_start(lang), len(words))
                for j in range(k):
                    h = _longer(h, words[:, j])
                at = np.unique(np.concatenate(_places(h, filter_bits)))
                word, first = np.unique(at >> 6, return_index=True)
                parts.append((np.full(len(word), k, np.int32), word, np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)), first).view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["k", "word", "bits"])

    each = reached.select("lang", "k", "phrase").mapInArrow(run, "k int, word long, bits long")
    return each.groupBy("k", "word").agg(F.bit_or("bits").alias("bits"))


def _dealt(rows: DataFrame) -> DataFrame:
    """(lang, text, shard), written in one folder a shard."""
    path = f"{shared_dir(rows.sparkSession)}/shards-{uuid.uuid4().hex}"
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    out = rows.sparkSession.read.schema("lang string, text string, shard int").parquet(path)
    out._written_path = path
    return out


def counts(docs: DataFrame, lang: str = "lang", text: str = "text", threshold: int = 100, longest: int = LONGEST, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, k, phrase, n): all phrases of up to ``longest`` words that occur ``threshold`` times, and all words as k = 0."""
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    table = _dealt(docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"), shard.alias("shard")))
    now = np.zeros((longest - 1, filter_bits // 8), np.uint8)
    past, grown, step = [], {}, 0
    state = docs.sparkSession.createDataFrame([], f"{COUNTS}, first int, reached int")
    while True:
        past.append(now.copy())
        levels = [1] * (step < shards) + [k for k in range(2, longest + 1) if grown.get(k - 1, -shards - 1) >= step - shards]
        if not levels:
            break
        old = past.pop(0) if step >= shards else np.zeros_like(now)
        # of fixed size, and packed: most bits are unset
        filters = docs.sparkSession.sparkContext.broadcast([(len(x), zlib.compress(x.tobytes(), 1)) for x in (now, old)])
        if step % shards == 0 and 2 <= step // shards < longest:  # phrases of that many words are all known
            fewer = _pruned(table, filters, step // shards)
            forget(table)
            table = fewer
        new = _scan(table.where(F.col("shard") == step % shards), filters, levels)
        both = state.unionByName(new.withColumns({"first": F.lit(step), "reached": F.lit(None).cast("int")}))
        summed = both.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("reached").alias("reached"))
        often = F.col("n") >= threshold
        summed = summed.withColumn("reached", F.coalesce("reached", F.when(often, F.lit(step))))
        # what has seen every shard and is rare is done with
        after = written(summed.where(often | (F.col("k") == 0) | (F.col("first") + shards - 1 > step)), "counts")
        forget(state)
        filters.destroy()
        state = after
        for k, word, bits in _bits(state.where((F.col("reached") == step) & F.col("k").between(1, longest - 1)), filter_bits).toPandas().itertuples(index=False):
            now[k - 1].view(np.int64)[word] |= bits
            grown[k] = step
        step += 1
    forget(table)
    return state.where((F.col("n") >= threshold) | (F.col("k") == 0)).select("lang", "k", "phrase", "n")


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, F.lit(first) if isinstance(first, int) else first, n), " ")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", threshold: int = 100, top: int = 2000, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at its lowest-scoring cut, ``n`` the
    language's words; ``score`` is floor(1000 * a * n / (l * r)). Phrases inside a longer one as frequent as
    they are dropped; ties go to the higher count, then to the smaller phrase.
    """
    return ranked(written(counts(docs, lang, text, threshold, longest, shards), "phrases"), top)


def ranked(known: DataFrame, top: int) -> DataFrame:
    """The best phrases of a table made by :func:`counts`."""
    words = known.where("k = 0").select("lang", F.col("n").alias("words"))
    phrases = known.where("k >= 2").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("w"), 1, F.col("cut")).alias("left"), _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda part, name: known.where("k >= 1").select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    exact = lambda *xs: " * ".join(f"cast({x} as decimal(38,0))" for x in xs)
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(words, "lang")
    score = F.expr(f"cast(({exact(1000, 'a', 'words')}) div ({exact('l', 'r')}) as bigint)")
    lowest = scored.groupBy("lang", "phrase", "a", F.col("words").alias("n")).agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    # a phrase as frequent as a longer one around it is as frequent as one that is one word longer
    inside = phrases.where("k >= 3").select("lang", F.col("a").alias("around"), F.explode(F.array(_part(F.col("w"), 1, F.col("k") - 1), _part(F.col("w"), 2, F.col("k") - 1))).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where("around is null or around < a").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = kept.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

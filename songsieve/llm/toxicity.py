"""Toxicity by maximum-scoring segments of token log-odds.

Token log-odds between toxic and clean labelled texts are shrunk by a Dirichlet prior
that follows the counts of the whole corpus, and by their own standard errors; those of
all tokens count, negative ones too, less a constant cost a token. A linear-time scan finds every maximal
segment of positive score in a text; extreme-value statistics of the best segments of
clean texts turn segment scores into expected counts, whose sum over a text's passages
is mapped to the probability of label 1.

Counting uses a hashed vocabulary of ``BUCKETS`` entries for words and as many for word
beginnings, so that an unseen form of a known word is still recognised. The model is
fitted on at most ``SAMPLE`` labelled rows (chosen by a hash of the id); corpus counts
and scores cover all rows and whole texts.

Defined cases: null and empty texts hold no passage and get the score of none; without
labelled rows of both kinds every score is that of no passage; rows that repeat an id
are scored each on its own text; columns other than id and text are never inputs of a
score, and clashing names in the labels table are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.llm.common import slices, trimmed, written

BUCKETS = 1 << 18
SAMPLE = 60_000  # labelled rows that fit the model at most
PREFIX = 4  # characters of a word's beginning
STRENGTH = 0.05  # tokens that the prior counts for, as a share of each kind's own
DOUBT = 4.0  # squared standard errors from 0 at which log-odds are halved
DRIFT = 0.7  # what every token costs
NEAR = 20  # tokens after a gain in which the same feature is a repeat and gains nothing
PASSAGE = 0.1  # expected count below which a segment is a passage
STRIP = ".,;:!?\"'()[]{}<>*_-…«»“”‘’"
MEMO = 100_000


class Features:
    """Bucket numbers of words, remembered: (word, beginning), the latter past BUCKETS."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int]] = {}

    def of(self, raw: str) -> tuple[int, int]:
        w = raw.strip(STRIP)
        if not w:
            return -1, -1
        beginning = xxhash.xxh3_64_intdigest(w[:PREFIX]) % BUCKETS + BUCKETS if len(w) >= PREFIX else -1
        return xxhash.xxh3_64_intdigest(w) % BUCKETS, beginning

    def counts(self, texts, into: np.ndarray) -> None:
        """Add, for each feature, the number of texts that hold it."""
        memo, found = self.memo, []
        for t in texts:
            words = set(t.lower().split()) if t else set()
            if len(memo) > MEMO:
                memo.clear()
            for w in words.difference(memo):
                memo[w] = self.of(w)
            found += {f for w in words for f in memo[w]}
        f = np.array(found, np.int64)
        into += np.bincount(f[f >= 0], minlength=2 * BUCKETS)


def segments(at: np.ndarray, gain: np.ndarray, drift: float = DRIFT, before: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token), in linear time.

    ``at`` holds the positions of the tokens that gain, ``gain`` their amounts, ``before``
    the sum of all scores before each; without it every token between costs ``drift``.
    """
    out: list[tuple[float, float, int, int]] = []  # (sum before, sum after, first, last)
    if before is None:
        before = np.cumsum(gain) - gain - drift * (at - np.arange(len(at)))
    for p, left, right in zip(at.tolist(), before.tolist(), (before + gain).tolist(), strict=True):
        first, last = p, p
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][0] >= left:
                j -= 1
            if j < 0 or out[j][1] >= right:
                out.append((left, right, first, last))
                break
            left, first = out[j][0], out[j][2]
            del out[j:]
    return [(r - x, f, z) for x, r, f, z in out]


@dataclass
class Model:
    """Feature log-odds, the extreme-value law of clean texts, and the map to a probability."""

    odds: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -4.0

    def __post_init__(self):
        self.memo: dict[str, int] = {}

    def feature(self, raw: str) -> int:
        """The stronger feature of a word, -1 if it has none."""
        return max(Features.of(None, raw), key=lambda f: abs(self.odds[f]) if f >= 0 else -1.0)

    def passages(self, text: str | None) -> tuple[int, list[tuple[float, int, int]]]:
        """Number of tokens, and the maximal segments."""
        words = text.lower().split() if text else []
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = self.feature(w)
        of = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        score = np.where(of >= 0, self.odds[of], 0.0) - DRIFT
        gained: dict[int, int] = {}
        for p in np.flatnonzero(score > 0).tolist():
            if p - gained.get(f := int(of[p]), -NEAR) < NEAR:
                score[p] = -DRIFT
            else:
                gained[f] = p
        at = np.flatnonzero(score > 0)
        return len(words), segments(at, score[at], before=(np.cumsum(score) - score)[at])

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Sum of -log10 expected counts over the passages; passages as (first, last, expected)."""
        n, found = self.passages(text)
        kept, total = [], 0.0
        for score, first, last in found:
            expected = self.scale * n * math.exp(-self.rate * score)
            if expected < PASSAGE:
                kept.append((first, last, expected))
                total += -math.log10(max(expected, 1e-30))
        return total, kept

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.offset + self.slope * evidence))))


def gumbel(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Rate and scale of the law P(best < s) = exp(-scale n exp(-rate s)), by moments.

    ``best`` are the best segments of clean texts of ``lengths`` tokens. Where these hold
    next to none, one text beyond them is taken to have held one.
    """
    best = np.minimum(best, np.quantile(best, 0.99)) if len(best) else best
    if len(best) < 20:
        return 1.0, 1.0
    if best.std() < 1e-9:
        return 1.0, float(1 / (lengths.mean() * (len(best) + 1)))
    rate = math.pi / (best.std() * math.sqrt(6))
    scale = 1 / np.mean(lengths * np.exp(-rate * best))
    return float(rate), float(max(scale, 1e-12))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic regression with a small ridge, by Newton steps."""
    a, b = 0.5, -2.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, r = p * (1 - p) + 1e-6, y - p
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, np.array([(r * x).sum() - a, r.sum() - 0.1 * b]))
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


# ---------------------------------------------------------------- jobs


def remainder(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """(text, toxic, fold) of at most ``sample`` labelled rows that may be learned from."""
    usable = labels.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic")).where("key is not null and toxic in (0, 1)").where(remainder(F.col("key")) != 2)
    chosen = F.broadcast(usable.orderBy(F.xxhash64("key"), "toxic").limit(sample))  # bounded by the limit
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    return rows.select("text", "toxic", (remainder(F.col("key")) == 3).alias("second"))


def count_tables(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(feature, corpus, toxic, clean): in how many texts of each kind a feature occurs."""

    def run(batches):
        names, counts, features = ("corpus", "toxic", "clean"), np.zeros((3, 2 * BUCKETS), np.int64), Features()
        for b in slices(batches):
            kinds = np.array(b.column(1).to_pylist())
            texts = b.column(0).to_pylist()
            for k in range(3):
                features.counts([t for t, of in zip(texts, kinds, strict=True) if of == k], counts[k])
        for k, _ in enumerate(names):
            used = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(used + k * 2 * BUCKETS), pa.array(counts[k][used])], names=["id", "n"])

    both = docs.select(F.col(text).alias("text"), F.lit(0).alias("kind")).union(rows.where("not second").select("text", F.when(F.col("toxic") == 1, 1).otherwise(2).alias("kind")))
    got = both.mapInArrow(trimmed(run), "id long, n long")
    size = 2 * BUCKETS
    of = lambda k: F.sum(F.when(F.floor(F.col("id") / size) == k, F.col("n")).otherwise(0)).cast("double")
    return got.groupBy((F.col("id") % size).alias("feature")).agg(of(0).alias("corpus"), of(1).alias("toxic"), of(2).alias("clean"))


def log_odds(counts: DataFrame) -> np.ndarray:
    """Shrunken log-odds of each feature; 0 for those that no labelled text holds.

    Words and beginnings are two vocabularies, each with a prior of its own. It counts for
    the same share of either kind's tokens, so that a feature as frequent in both has
    log-odds of 0 however unlike the numbers of toxic and clean texts are. At most one row
    for each bucket comes to the driver.
    """
    table = written(counts.withColumn("part", (F.col("feature") >= BUCKETS).cast("int")), "counts")
    total = {r["part"]: r for r in table.groupBy("part").agg(F.sum("corpus").alias("w"), F.sum("toxic").alias("t"), F.sum("clean").alias("c")).collect()}
    out = np.zeros(2 * BUCKETS)
    for part, r in total.items():
        if not r["t"] or not r["c"]:
            continue
        prior = (F.col("corpus") + 0.01) * (STRENGTH / (r["w"] + 0.01 * BUCKETS))
        a, b = F.col("toxic") + prior * r["t"], F.col("clean") + prior * r["c"]
        value = F.log(a / r["t"]) - F.log(b / r["c"])
        square = value * value / (1 / a + 1 / b)
        got = table.where((F.col("part") == part) & (F.col("toxic") + F.col("clean") > 0)).select("feature", (value * square / (square + DOUBT)).alias("v")).toPandas()
        out[got["feature"].to_numpy()] = got["v"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """The model: counts from two of the three usable remainders, calibration on the third."""
    rows = labelled(docs, labels, key, text, sample)
    model = Model(log_odds(count_tables(docs, rows, text)))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.odds)

    def run(batches):  # the passages of the calibration rows are found where the rows are
        own = Model(shared.value)
        for b in slices(batches):
            found = [own.passages(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([[s for s, *_ in f] for _, f in found], pa.list_(pa.float64())), b.column(1)], names=["n", "scores", "toxic"])

    got = rows.where("second").select("text", "toxic").mapInArrow(trimmed(run), "n long, scores array<double>, toxic int").toPandas()  # bounded by the sample
    y = got["toxic"].to_numpy(np.int64)
    if not len(y):
        return model
    best = np.array([max(s, default=0.0) for s in got["scores"]])
    n = np.maximum(1, got["n"].to_numpy(float))
    model.rate, model.scale = gumbel(n[y == 0], best[y == 0])
    if 0 < y.sum() < len(y):
        expected = [model.scale * k * np.exp(-model.rate * np.asarray(s, float)) for k, s in zip(n, got["scores"], strict=True)]
        model.slope, model.offset = logistic(np.array([-np.log10(np.maximum(e[e < PASSAGE], 1e-30)).sum() for e in expected]), y.astype(float))
    return model


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its score and its passages (first and last token, expected count)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("expected", pa.float64())])

    def run(batches):
        own = shared.value
        for b in slices(batches):
            found = [own.evidence(t) for t in b.column(1).to_pylist()]
            passages = pa.array([[{"first": f, "last": z, "expected": e} for f, z, e in p] for _, p in found], pa.list_(schema))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([own.probability(v) for v, _ in found], pa.float64()), passages], names=["key", "score", "passages"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), "key long, score double, passages array<struct<first:int,last:int,expected:double>>").withColumnRenamed("key", key)


def kept(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        own = shared.value
        for b in slices(batches):
            ok = [own.probability(own.evidence(t)[0]) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(ok))

    return docs.mapInArrow(trimmed(run), docs.schema)

"""Repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every window of ``LENGTH`` bytes belongs to one anchor: the leftmost of its ``GRAM``-byte
strings with the least hash. Equal windows have equal anchors at the same place, so windows
need comparing only among the occurrences of an anchor's string. A run of consecutive
windows of one anchor is a segment; an anchor that occurs once holds no repeated window and
is dropped, and of equal segments all but the earliest are repeats as a whole.

What is left, the unlike segments around recurring anchors, is sorted: the segments of a
bucket of anchors are split into shards, each shard's suffixes are sorted and its
Burrows-Wheeler transform is taken, and the transforms are merged by refining the
interleave of their rows, two symbols at a step. The refinement also keeps the blocks of
rows that agree so far: after ``LENGTH`` symbols the blocks are the repeated intervals, whose
common prefix is at least ``LENGTH``. No suffix is compared again.

An anchor with more than ``CROWD`` unlike segments would make a large bucket; its windows
are compared by an aggregation over two hashes of the window instead.

Defined cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` keep all;
of rows that repeat an id the longest text is the document; a null id comes first in order;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from songsieve.llm.common import forget, small, trimmed, written

LENGTH = 100
GRAM = 32
CHUNK = 1 << 20  # bytes whose anchors are found at once
SHARDS = 4
BUCKET = 1 << 20  # bytes in a bucket, about
CROWD = 2000  # unlike segments of an anchor that a bucket may hold
FIRST = -(1 << 63)  # stands for a null id
_rng = np.random.default_rng(97)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE, BASE2 = (int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2))
MIX = np.uint64(0x9FB21C651E98DF25)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * MIX
    return x ^ x >> np.uint64(29)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all strings of ``size`` (a power of two) bytes, by doubling."""
    h, width = BYTE[data], 1
    while width < size:
        h = mixed(h[:-width] * np.uint64(BASE) + h[width:])
        width *= 2
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


INVERSE = pow(BASE2, -1, 1 << 64)


class Sums:
    """Hashes of any substrings of a byte array, from sums of powers."""

    def __init__(self, data: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE2, len(data)), dtype=np.uint64)])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def segments(data: np.ndarray, doc_start: np.ndarray, doc_stop: np.ndarray):
    """Segments of documents laid end to end: (document, first window, windows, anchor's place in it, anchor hash, segment hash)."""
    if len(data) < LENGTH:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    h = gram_hashes(data)
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    anchor = (least(key, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(doc_start, np.arange(len(anchor)), "right") - 1
    ok = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= doc_stop[doc])
    if not len(ok):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    q, d = anchor[ok], doc[ok]
    fresh = np.concatenate([[True], (q[1:] != q[:-1]) | (d[1:] != d[:-1])])
    at = np.flatnonzero(fresh)
    start, count = ok[at], np.diff(np.concatenate([at, [len(ok)]]))
    place = q[at] - start
    whole = Sums(data).of(start, start + count + LENGTH - 1)
    shape = (place * 256 + count).astype(np.uint64)
    return d[at], start - doc_start[d[at]], count, place, h[q[at]], mixed(whole + shape * MIX)


def runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray):
    """Windows as (document, start, count), touching ones joined; sorted.

    The windows given are of distinct starts, so a run ends where the next does not touch it.
    """
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], (start + count)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (stop[last] - start[at]) if len(at) else start[at]


ROW = "kind byte, h long, ctx long, doc long, start long, count int"
SPAN = "doc long, start long, count long"


def anchored(docs: DataFrame) -> DataFrame:
    """Segments of (doc, text) rows. Kind 0: candidates; kind 1: repeats already seen, joined runs."""

    def flush(ids, texts):
        sizes = np.array([len(t) for t in texts])
        stop = np.cumsum(sizes)
        d, start, count, place, h, ctx = segments(np.frombuffer(b"".join(texts), np.uint8), stop - sizes, stop)
        doc = np.array(ids, np.int64)[d] if len(d) else np.zeros(0, np.int64)
        order = np.lexsort((start, doc, ctx, h))
        again = np.zeros(len(d), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (ctx[order[1:]] == ctx[order[:-1]])
        rd, rs, rc = runs(doc[again], start[again], count[again])
        one, n, m = ~again, int((~again).sum()), len(rd)
        zero = np.zeros(m, np.int64)
        own = mixed((rd.astype(np.uint64) ^ rs.astype(np.uint64) * MIX) * MIX)  # spreads rows of kind 1 over the shuffle
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(n, np.int8), np.ones(m, np.int8)])),
                pa.array(np.concatenate([h[one], own]).view(np.int64)),
                pa.array(np.concatenate([ctx[one].view(np.int64), zero])),
                pa.array(np.concatenate([doc[one], rd])),
                pa.array(np.concatenate([start[one], rs])),
                pa.array(np.concatenate([count[one], rc]).astype(np.int32)),
            ],
            names=["kind", "h", "ctx", "doc", "start", "count"],
        )

    def run(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                if len(raw) >= LENGTH:
                    ids.append(i)
                    texts.append(raw)
                    held += len(raw)
                if held >= CHUNK:
                    yield from flush(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield from flush(ids, texts)

    return docs.select("doc", "text").mapInArrow(trimmed(run), ROW)


# ---------------------------------------------------------------- transforms


DEPTH = 128  # symbols by which a shard's suffixes are sorted; more than LENGTH, so ties do not matter


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of strings that each end in 0 in the order of their first ``DEPTH`` symbols."""
    n, ends = len(text), np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the string's end
    wide = np.concatenate([text, np.zeros(7, np.uint8)])
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)).view(">u8").ravel().astype(np.uint64)
    drop = (8 * (8 - np.clip(left, 1, 8))).astype(np.uint64)
    key = np.where(left > 0, key >> drop << drop, 0)  # nothing counts after a string's end
    width = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, np.int64)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.zeros(n + width, np.int64)
        rank[order] = np.cumsum(new)
        if width >= DEPTH or rank[order[-1]] == n:
            return order
        # a suffix that has ended is told apart from longer ones already; what follows it is not read
        key = rank[:n] * np.int64(n + 1) + np.where(left >= width, rank[width:], 0)
        width *= 2


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: the symbol before each suffix, 0 before a string's first."""
    before = text[order - 1]
    before[order == 0] = 0
    return before


def preceding(bwt: np.ndarray) -> np.ndarray:
    """For each row the row of the suffix one symbol longer: equal symbols keep their order."""
    out = np.empty(len(bwt), np.int64)
    out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    return out


def merge(transforms: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, row, block) of the suffixes that agree with another in their first ``steps`` symbols.

    Only the transforms are read. The rows of all shards start interleaved in one block. A
    step extends each by the two symbols before it and puts them in the order of these,
    keeping it otherwise: the interleave is then sorted by two symbols more, and rows stay
    in one block if they agree in all symbols so far. Rows at a string's start cannot be
    extended, and rows alone in their block stay alone; both are dropped. ``steps`` is even.
    """
    base = np.cumsum([0, *map(len, transforms)])
    symbol = np.concatenate(transforms)
    back = np.concatenate([preceding(t) + b for t, b in zip(transforms, base, strict=False)])
    pair = symbol.astype(np.uint16) << np.uint16(8) | symbol[back]
    ends = (symbol == 0) | (symbol[back] == 0)
    twice = back[back].astype(np.int32)
    row = np.arange(len(symbol), dtype=np.int32)
    block = np.zeros(len(symbol), np.int32)
    for _ in range(steps // 2):
        alive = ~ends[row]
        row, block = row[alive], block[alive]
        order = np.argsort(pair[row], kind="stable")
        row, block = row[order], block[order]
        symbols = pair[row]
        new = np.ones(len(row), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
        alone = new.copy()
        alone[:-1] &= new[1:]
        block = np.cumsum(new, dtype=np.int32)
        row, block = twice[row[~alone]], block[~alone]
    shard = np.searchsorted(base, row, "right") - 1
    return shard, row - base[shard], block


def repeated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, text number, offset) of all windows of ``LENGTH`` bytes that occur more than once in the texts."""
    shards = [list(range(j, len(texts), SHARDS)) for j in range(min(SHARDS, len(texts)))]
    orders, transforms, owner, offset = [], [], [], []
    for members in shards:
        sizes = np.array([len(texts[i]) + 1 for i in members])
        raw = np.frombuffer(b"".join(texts[i] + b"\xff" for i in members), np.uint8) + np.uint8(1)  # UTF-8 has no 255, which becomes the end 0
        order = suffix_array(raw)
        orders.append(order)
        transforms.append(transform(raw, order))
        begin = np.cumsum(sizes) - sizes
        at = np.searchsorted(begin, order, "right") - 1
        owner.append(np.array(members)[at])
        offset.append(order - begin[at])
    shard, row, block = merge(transforms, LENGTH)
    text, place = np.empty(len(shard), np.int64), np.empty(len(shard), np.int64)
    for j in range(len(shards)):
        mine = shard == j
        text[mine], place[mine] = owner[j][row[mine]], offset[j][row[mine]]
    return block, text, place


# ---------------------------------------------------------------- jobs


def later_windows(group: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Of equal windows (same group) all but the earliest, as joined runs."""
    order = np.lexsort((start, doc, group))
    later = np.concatenate([[False], group[order][1:] == group[order][:-1]]) if len(order) else np.zeros(0, bool)
    at = order[later]
    return runs(doc[at], start[at], np.ones(len(at), np.int64))


def compared(pieces: DataFrame, buckets: int) -> DataFrame:
    """Windows of the pieces (h, doc, start, bytes) that occur earlier in another of the same anchor."""

    def run(table: pa.Table) -> pa.Table:
        doc, start = np.asarray(table.column("doc")), np.asarray(table.column("start"))
        block, text, place = repeated(table.column("bytes").to_pylist())
        d, s, c = later_windows(block, doc[text], start[text] + place)
        return pa.table({"doc": pa.array(d, pa.int64()), "start": pa.array(s, pa.int64()), "count": pa.array(c, pa.int64())})

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).select("bucket", "doc", "start", "bytes")
    return dealt.groupBy("bucket").applyInArrow(run, SPAN)


def aggregated(pieces: DataFrame) -> DataFrame:
    """The same for crowded anchors, by an aggregation over window hashes."""

    def run(batches):
        for b in batches:
            for doc, start, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - LENGTH + 1)
                grams = gram_hashes(data)
                one, two = Sums(data).of(at, at + LENGTH), mixed(grams[at] + mixed(grams[at + LENGTH // 2] + grams[at + LENGTH - GRAM] * MIX))
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(at), doc, np.int64)), pa.array(at + start)], names=["w1", "w2", "doc", "start"])

    windows = written(pieces.select("doc", "start", "bytes").mapInArrow(trimmed(run), "w1 long, w2 long, doc long, start long"), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(first, ["w1", "w2"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start"))).select("doc", "start", F.lit(1).cast("long").alias("count"))


def one_each(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, text), one row for each id."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("doc"), F.col(text).alias("text"))
    if rows.groupBy("doc").count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy("doc").agg(F.max(F.struct(F.length("text"), "text")).alias("t")).select("doc", "t.text")


def repeats(rows: DataFrame) -> DataFrame:
    """(doc, start, count): runs of windows of (doc, text) rows that also start earlier."""
    spark = rows.sparkSession
    found = anchored(rows)
    n = F.expr("count(*) over (partition by h)")
    turn = F.expr("row_number() over (partition by h, ctx order by doc, start)")
    unlike = F.expr("sum(if(turn = 1, 1, 0)) over (partition by h)")
    again = found.withColumn("n", n).where("n > 1 or kind = 1").withColumn("turn", turn).withColumn("unlike", unlike)
    grouped = written(again.where("turn > 1 or unlike > 1 or kind = 1").select("h", "doc", "start", "count", (F.expr("turn > 1 or kind = 1")).alias("later"), "unlike"), "segments")
    wanted = grouped.where("not later and unlike > 1")
    size = wanted.agg(F.sum(F.col("count") + LENGTH).alias("bytes")).first()["bytes"] or 0
    per_doc = written(wanted.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "count", "unlike")).alias("parts")), "wanted")
    texts = rows.join(small(per_doc.select("doc"), 1_000_000), "doc", "left_semi").join(per_doc, "doc")

    def cut(batches):
        for b in batches:
            h, doc, start, crowded, raw = [], [], [], [], []
            for d, text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for p in parts:
                    h.append(p["h"])
                    doc.append(d)
                    start.append(p["start"])
                    crowded.append(p["unlike"] > CROWD)
                    raw.append(data[p["start"] : p["start"] + p["count"] + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(crowded, pa.bool_()), pa.array(raw, pa.binary())], names=["h", "doc", "start", "crowded", "bytes"])

    pieces = written(texts.select("doc", "text", "parts").mapInArrow(trimmed(cut), "h long, doc long, start long, crowded boolean, bytes binary"), "pieces")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    spans = [
        grouped.where("later").select("doc", "start", F.col("count").cast("long").alias("count")),
        compared(pieces.where("not crowded"), buckets),
        aggregated(pieces.where("crowded")),
    ]
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    out = written(out, "spans")
    forget(pieces)
    forget(per_doc)
    forget(grouped)
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per id: n_bytes, n_removed, n_spans and the sha256 of the bytes that stay, with ``kept``, those bytes."""
    rows = one_each(docs, key, text)
    spans = repeats(rows).groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("spans"))

    def run(batches):
        for b in batches:
            size, removed, n_spans, digest, kept = [], [], [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                left, at, gone, n = [], 0, 0, 0
                for start, stop in sorted((s["start"], s["start"] + s["count"] + LENGTH - 1) for s in spans or []):
                    if start > at or not n:
                        left.append(raw[at:start])
                        n += 1
                        at = start
                    if stop > at:
                        gone += stop - at
                        at = stop
                left.append(raw[at:])
                whole = b"".join(left)
                size.append(len(raw))
                removed.append(gone)
                n_spans.append(n)
                digest.append(hashlib.sha256(whole).hexdigest())
                kept.append(whole)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.join(spans, "doc", "left").select("doc", "text", "spans").mapInArrow(trimmed(run), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn(key, F.when(F.col("doc") != FIRST, F.col("doc"))).drop("doc")

"""Token ids in a binary file: static range asymmetric numeral system in interleaved blocks.

One frequency table, counted over all tokens of the corpus, is shared by all blocks.
A block holds whole documents; its tokens are dealt to lanes that share one stream of
32-bit words. Checkpoints (lane states and a word offset) every ``EVERY`` steps let a
block be decoded from several places at once, and a checksum guards each block.

The file is a folder: ``table`` (id, freq) and ``blocks`` (shard, block, n_docs, n_tokens,
data), Parquet files whose ``data`` cells are the blocks laid out by :func:`pack`.
Shards follow each other in ascending document id, null first.

Defined cases: null and empty texts are the end id alone; rows that repeat an id are
separate documents of that id; an empty table gives an empty file and no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import codecs
import struct
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songsieve.llm.common import shared_dir, small, trimmed, written

PRECISION = 18  # bits of the frequency table's total
LOW = np.uint64(1 << 31)  # a state stays in [LOW, LOW << 32)
LANES = 2048
EVERY = 64  # steps between checkpoints
BLOCK_TOKENS = 1 << 18
SHARD_TOKENS = 1 << 22
MAGIC = b"RANS0001"
HEAD = struct.Struct("<8sIIIIQI")  # magic, docs, tokens, lanes, words, tokens before it in its shard, crc
MEMO_WORDS = 1_500_000  # words whose ids a worker keeps
SEPARATOR = "\0"  # between the words of a text that is cut
LETTERS_END = "\u0250"  # letters before it are letters by any version of Unicode
#: The character by which byte-level BPE shows each byte; a line feed stays, to tell words apart.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = "".join("\n" if b == 10 else chr(b if b in SHOWN else 256 + sum(x not in SHOWN for x in range(b))) for b in range(256))


# ---------------------------------------------------------------- tokenizer


class Tokens:
    """Encodes texts with a tokenizers file, remembering the ids of space-separated words.

    By byte-level BPE's splitting rule a space between two other characters always begins
    a new piece, a line feed between two others is one, and so is a mark after letters: the
    words of a text can be encoded apart. Texts are cut nowhere else, and those that spell out
    one of the file's added tokens, or hold the separator of words, are encoded whole.

    A word is known by itself after a space, by a line feed and itself at the start of a line, by
    two and itself at the start of a text; the empty word is a text's end.
    """

    def __init__(self, path: str, dtype: str, end: int):
        import json
        import re

        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        steps = json.loads(self.lib.to_str())
        cut = steps["pre_tokenizer"] or {}
        # letters and a space before them are one piece, which the model takes as its bytes' characters
        self.letters = self.lib.model.tokenize if steps["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"] else None
        self.dtype, self.end = dtype, np.array([end], dtype).tobytes()
        self.rare = re.compile("[%s]" % "".join(c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n")).search
        self.cut = re.compile(r"(?<=\S) (?=\S)").sub
        self.whole = [SEPARATOR, *[t.content for t in self.lib.get_added_tokens_decoder().values()]]
        self.feed = self.ids(["\n"])[0]
        self.marks = dict(zip(",.;:!?", self.ids([*",.;:!?"]), strict=True))
        self.memo: dict[str, bytes] = {"": self.end}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def separated(self, t: str | None) -> str:
        """The text's words, cut at its single inner line feeds and spaces, or at single inner spaces alone."""
        if not t:
            return ""
        level = t.replace("\n", " ")
        if "  " in level or level[0] == " " or level[-1] == " " or not level.isprintable() and self.rare(t):
            return f"\n\n{self.cut(SEPARATOR, t)}{SEPARATOR}"
        if level is not t and "\n" in t:
            level = t.replace("\n", " \n")
        return f"\n\n{level.replace(' ', SEPARATOR)}{SEPARATOR}"

    def learn(self, words: list[str], place: str) -> None:
        """Remember the ids of distinct words at a ``place``: what stands before a word there, by which it is known."""
        memo, lead, marks = self.memo, "" if place else " ", self.marks
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()] if len(letters) < len(words) else []
        marked = [w for w in others if w[-1] in marks and w[:-1].isalpha()]
        if marked:
            bare = {w[:-1] for w in marked}
            letters += [w for w in bare.difference(letters) if place + w not in memo]
            others = list(set(others).difference(marked))
        if not self.letters:
            others, letters = others + letters, []
        elif not "".join(letters).isascii():
            alone = [w for w in letters if w.isascii() or max(w) < LETTERS_END]
            if len(alone) < len(letters):
                others, letters = [*others, *set(letters).difference(alone)], alone
        if letters:
            ids, ends, tokenize = [], [0], self.letters
            for w in codecs.charmap_decode((lead + f"\n{lead}".join(letters)).encode(), "strict", BYTE_CHARS)[0].split("\n"):
                ids += [t.id for t in tokenize(w)]
                ends.append(len(ids))
            self.keep(letters, place, np.array(ids, self.dtype), ends[:-1], ends[1:])
        # most other words are encoded many at once, apart by line feeds, whose id then marks the ends
        plain = [w for w in others if "\n" not in w and not w[0].isspace() and not w[-1].isspace()]
        feed = np.frombuffer(self.feed, self.dtype)[0]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.lib.encode_batch_fast([lead + f"\n{lead}".join(some) + "\n"], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(ids == feed)
            self.keep(some, place, ids, [0, *(ends[:-1] + 1)], ends)
        rest = list(set(others).difference(plain))
        for w, x in zip(rest, self.ids([lead + w for w in rest]), strict=True):
            memo[place + w] = (self.feed if place == "\n" else b"") + x
        for w in marked:
            memo[place + w] = memo[place + w[:-1]] + marks[w[-1]]

    def keep(self, words: list[str], place: str, ids: np.ndarray, starts, ends) -> None:
        raw, wide = ids.tobytes(), ids.itemsize
        cells = map(raw.__getitem__, map(slice, (np.array(starts) * wide).tolist(), (np.array(ends) * wide).tolist()))
        if place:
            before = self.feed if place == "\n" else b""
            words, cells = [place + w for w in words], [before + x for x in cells]
        self.memo.update(zip(words, cells, strict=True))

    def cells(self, texts: list[str | None]) -> pa.Array:
        """Each text's ids and the end id, as bytes."""
        if not texts:
            return pa.array([], pa.large_binary())
        whole = [i for i, t in enumerate(texts) if t and any(a in t for a in self.whole)]
        known = dict.fromkeys(whole, "")
        docs = pc.split_pattern(pa.array([known[i] if i in known else self.separated(t) for i, t in enumerate(texts)], pa.large_string()), SEPARATOR)
        words = docs.values.dictionary_encode()
        distinct = words.dictionary  # made Python texts by one split, as single cells are slow to read
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(SEPARATOR, pa.large_string()))[0].as_py().split(SEPARATOR)
        if len(self.memo) > MEMO_WORDS:
            self.memo = {"": self.end}
        got = list(map(self.memo.get, names))
        fresh = [w for w, x in zip(names, got, strict=True) if x is None]
        if fresh:
            self.learn([w for w in fresh if w[0] != "\n"], "")
            heads = [w for w in fresh if w[0] == "\n"]
            self.learn([w[1:] for w in heads if w[1] != "\n"], "\n")
            self.learn([w[2:] for w in heads if w[1] == "\n"], "\n\n")
            got = list(map(self.memo.__getitem__, names))
        # the words' ids lie one after the other, so a text's are those from its first word's start to its last one's end
        laid = pa.array(got, pa.large_binary()).take(words.indices)
        _, starts, raw = laid.buffers()
        ends = np.frombuffer(starts, np.int64, len(laid) + 1)[docs.offsets.to_numpy()]
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.tobytes()), raw])
        if not whole:
            return out
        cells = out.to_pylist()
        for i, ids in zip(whole, self.ids([texts[i] for i in whole]), strict=True):
            cells[i] = ids + self.end
        return pa.array(cells, pa.large_binary())

    def batch(self, texts: list[str | None]) -> list[bytes]:
        return self.cells(texts).to_pylist()


_tokens: dict[tuple, Tokens] = {}


def worker_tokens(*args) -> Tokens:
    """This Python worker's encoder, kept from task to task with what it remembers."""
    if args not in _tokens:
        _tokens[args] = Tokens(*args)
    return _tokens[args]


def tokenized(docs: DataFrame, path: str, vocabulary: int, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, counts): each text's ids and the end id, as little-endian integers of the least width.

    Every task adds one row, of null key and ids, with how often it wrote each id.
    """
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, counts, names = worker_tokens(path, dtype, end), np.zeros(vocabulary, np.int64), ["key", "ids", "counts"]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cells = tok.cells(part.column(1).to_pylist())
                _, ends, raw = cells.buffers()
                written_ids = int(np.frombuffer(ends, np.int64)[len(cells)]) // np.dtype(dtype).itemsize
                counts += np.bincount(np.frombuffer(raw, dtype, written_ids), minlength=vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), cells.cast(pa.binary()), pa.nulls(len(cells), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=names)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(trimmed(run), "key long, ids binary, counts binary")


# ---------------------------------------------------------------- coder


def normalised(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Counts scaled to a total of 2**precision, every counted symbol at least 1."""
    total, full = int(counts.sum()), 1 << precision
    if not total:
        return counts.astype(np.uint64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * full / total).astype(np.int64), 0)
    order = np.argsort(-freq, kind="stable")
    off = full - int(freq.sum())
    while off:  # the largest symbols take what rounding left over
        for i in order:
            step = off if off > 0 else -min(-off, int(freq[i]) - max(1, int(freq[i]) // 2))
            freq[i] += step
            off -= step
            if not off:
                break
    return freq.astype(np.uint64)


class Table:
    """Frequencies with their running sums and the slot lookup of the decoder."""

    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        self.freq, self.precision = freq.astype(np.uint64), np.uint64(precision)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.most = (LOW >> self.precision << np.uint64(32)) * self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq.astype(np.int64))
        self.filler = int(np.argmax(freq))


def encode(ids: np.ndarray, table: Table, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states at the checkpoints, word offsets of the checkpoints, words)."""
    steps = -(-len(ids) // lanes)
    grid = np.full(steps * lanes, table.filler, np.int64)
    grid[: len(ids)] = ids
    grid = grid.reshape(steps, lanes)
    x = np.full(lanes, LOW, np.uint64)
    shift, word = np.uint64(32), np.uint64(0xFFFFFFFF)
    out, states = [None] * steps, []
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        f = table.freq.take(s)
        full = x >= table.most.take(s)
        out[t] = (x[full] & word).astype("<u4")
        x = np.where(full, x >> shift, x)
        q = x // f
        x = (q << table.precision) + (x - q * f) + table.first.take(s)
        if t % EVERY == 0:
            states.append(x)
    before = np.concatenate([[0], np.cumsum([len(w) for w in out])]).astype("<u4")
    return np.array(states[::-1], "<u8"), before[0:steps:EVERY], np.concatenate(out)


def decode(states: np.ndarray, offsets: np.ndarray, words: np.ndarray, n: int, lanes: int, table: Table) -> np.ndarray:
    """The ids again, all segments between checkpoints side by side."""
    steps = -(-n // lanes)
    grid = np.empty((len(states), EVERY, lanes), table.symbol.dtype)
    mask, shift = np.uint64((1 << int(table.precision)) - 1), np.uint64(32)
    x, at = states.astype(np.uint64), offsets.astype(np.int64)
    stream = words.astype(np.uint64)
    for t in range(min(EVERY, steps)):
        live = np.arange(len(x)) * EVERY + t < steps
        slot = x & mask
        s = table.symbol.take(slot.view(np.int64))
        grid[:, t] = s
        x = table.freq.take(s) * (x >> table.precision) + slot - table.first.take(s)
        need = (x < LOW) & live[:, None]
        short, took = np.flatnonzero(need), np.count_nonzero(need, axis=1)
        # a segment's lanes take the words that follow each other from its place
        place = np.arange(len(short)) + np.repeat(at - np.cumsum(took) + took, took)
        flat = x.reshape(-1)
        flat[short] = (flat[short] << shift) | stream[place]
        at += took
    return grid.reshape(-1, lanes)[:steps].reshape(-1)[:n]


def pack(keys: list, sizes: list[int], ids: np.ndarray, before: int, table: Table) -> bytes:
    """One block: header, document ids and sizes, checkpoints, words."""
    lanes = max(1, min(LANES, 1 << max(0, (len(ids) // 64).bit_length() - 1)))
    states, offsets, words = encode(ids, table, lanes)
    null = np.array([k is None for k in keys], np.uint8).tobytes()
    body = b"".join([null, np.array([k or 0 for k in keys], "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), states.tobytes(), offsets.astype("<u4").tobytes(), words.tobytes()])
    return HEAD.pack(MAGIC, len(keys), len(ids), lanes, len(words), before, zlib.crc32(body)) + body


def unpack(data: bytes, table: Table):
    """(keys, sizes, ids, tokens before it) of a block; an error if it was damaged."""
    magic, docs, n, lanes, n_words, before, crc = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    at = 0

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(body, dtype, count, at)
        at += out.nbytes
        return out

    marks = -(-(-(-n // lanes)) // EVERY)
    null, keys, sizes = take("u1", docs), take("<i8", docs), take("<u4", docs)
    states, offsets, words = take("<u8", marks * lanes).reshape(marks, lanes), take("<u4", marks), take("<u4", n_words)
    return [None if z else int(k) for z, k in zip(null, keys, strict=True)], sizes, decode(states, offsets, words, n, lanes, table), before


# ---------------------------------------------------------------- jobs


def frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """Counts of every id over the whole corpus; the result is bounded by the vocabulary."""

    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                counts += np.frombuffer(x.as_buffer(), np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    rows = tokens.where("counts is not null").select("counts").mapInArrow(trimmed(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_tokens(tokens: DataFrame, path: str, vocabulary: int, shards: int | None = None) -> None:
    """Write a (key, ids, counts) table as one block file in ascending key order; the shards follow from the tokens counted."""
    spark = tokens.sparkSession
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    counts = frequencies(tokens, vocabulary)
    freq, shards = normalised(counts), shards or 1 + int(counts.sum()) // SHARD_TOKENS
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq) if f], "id int, freq long").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)  # bounded by the vocabulary

    def run(batches):
        table, shard, block, before = Table(shared.value), TaskContext.get().partitionId(), 0, 0
        keys, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal keys, sizes, parts, held, block, before
            data = pack(keys, sizes, np.concatenate(parts), before, table)
            row = pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "n_docs": [len(keys)], "n_tokens": [held], "data": [data]}, schema=SCHEMA)
            block, before = block + 1, before + held
            keys, sizes, parts, held = [], [], [], 0
            return row

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.frombuffer(x.as_py(), dtype)
                keys.append(k)
                sizes.append(len(ids))
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if keys:
            yield flush()

    dealt = tokens.where("counts is null").select("key", "ids").repartitionByRange(shards, "key").sortWithinPartitions("key", "ids")
    dealt.mapInArrow(trimmed(run), "shard int, block int, n_docs int, n_tokens long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())])


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of a block file: key, start, n_tokens, ids_crc32 (and the ids themselves)."""
    rows = spark.read.parquet(f"{path}/table").toPandas()  # bounded by the vocabulary
    freq = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.uint64)
    freq[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.uint64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches):
        table = None
        for b in batches:
            for shard, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table = table or Table(shared.value)
                keys, sizes, ids, before = unpack(data.as_py(), table)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                cells = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array([shard] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(before + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(c) for c in cells], pa.int64())]
                names = ["shard", "key", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(cells, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    sums = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # one row for each shard
    starts = [(r["shard"], s) for r, s in zip(sums, accumulate([0, *[r["n"] for r in sums]]), strict=False)]
    begin = spark.createDataFrame(starts, "shard int, shard_start long")
    docs = blocks.select("shard", "data").mapInArrow(trimmed(run), "shard int, key long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return docs.join(small(begin), "shard").withColumn("start", F.col("shard_start") + F.col("within")).drop("shard", "shard_start", "within")


def round_trip(docs: DataFrame, path: str, vocabulary: int, end: int = 0) -> DataFrame:
    """Tokenize, write the file, and read its documents back."""
    spark = docs.sparkSession
    import uuid

    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(written(tokenized(docs, path, vocabulary, end), "ids"), out, vocabulary)
    return read_tokens(spark, out)

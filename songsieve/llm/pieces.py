"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces are read from a public model file. That file ranks its pieces by merges and holds
no log probabilities, so a piece of rank r gets the Zipf log score -log(r) - log(H); a
file whose scores are log probabilities can be used as it is (``scores="file"``).

A text gets a leading white-space marker and its spaces become markers. Since no piece
has a marker after another character, the best path breaks before each marker run, so
words are remembered; those not yet known are solved side by side in arrays. A character that no piece covers is written as the
byte pieces of its UTF-8 form, and so is a literal marker character, which makes decoding
exact for every text.

Defined cases: null and empty texts have no pieces and decode to the empty text; very long
words are solved like all others; rows that repeat an id are separate; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from songsieve.llm.common import trimmed

MARK = "▁"
BAR = MARK.encode()
UNKNOWN_PENALTY = 10.0
MEMO = 120_000
MEMO_LENGTH = 64  # longer words are not remembered
SOLVED = 1 << 17  # characters of the words that are solved side by side
SIZES = np.array([1 if b < 0xC0 or b > 0xF7 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.int32)  # bytes of a character, by its first
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types of the model format


class DoubleArray:
    """A trie over bytes in two arrays: the child of ``s`` by byte ``c`` is base[s] + c, if check says so."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys:
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = value
        room = len(tree) * 4 + 1024
        base, check, value = [0] * room, [-1] * room, [-1] * room  # a leaf's base is of no use: no check names it
        used, place = bytearray(room), {0: 0}
        used[0] = 1
        begin = [1] * 257  # by number of children: places before it were seen to be taken
        for node, children in enumerate(tree):  # parents come before children
            at = place[node]
            value[at] = ends.get(node, -1)
            if not children:
                continue
            codes = sorted(children)
            b, first = begin[len(codes)], codes[0]
            while used[b + first] or any(used[b + c] for c in codes):
                b = max(b + 1, used.find(0, b + 1 + first) - first)
                if b + 512 > len(used):
                    grow = len(used)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                    used += bytearray(grow)
            begin[len(codes)] = b
            base[at] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = at
                place[children[c]] = b + c
        last = max((i for i in range(len(used)) if used[i]), default=0) + 512  # a child's place is never beyond
        self.base, self.check, self.value = (np.array(x[:last] + [y] * max(0, last - len(x)), np.int32) for x, y in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A model: its trie, log scores and byte pieces."""

    def __init__(self, path: str, scores: str = "zipf"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        harmonic = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
        if scores == "zipf":
            self.score = {i: -math.log(r) - harmonic for r, (i, _) in enumerate(normal, 1)}
        else:
            self.score = {i: float(p.score) for i, p in normal}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArray([(p.piece.encode(), i) for i, p in normal])
        self.gain = np.full(len(model.pieces) + 1, self.unknown)  # the last is that of no piece, -1
        self.gain[list(self.score)] = list(self.score.values())
        self.byte_ids = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)
        shown = {i: p.piece.replace(MARK, " ").encode() for i, p in normal} | {i: bytes([b]) for b, i in self.byte.items()}
        self.shown = [shown.get(i, b"") for i in range(len(model.pieces))]
        self.runs = re.compile(" +[^ ]*").findall
        self.memo: dict[str, bytes] = {}

    def matches(self, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces (start, end, id) in the bytes, id -1 for characters that are none, and how far a piece from each place reaches."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        reach, single = np.zeros(len(raw), np.int32), np.zeros(len(raw), bool)
        found = []
        begin, at, node = starts, starts, np.zeros(len(starts), np.int32)
        while len(begin):
            step = base[node] + raw[at]
            ok = check[step] == node
            begin, node, at = begin[ok], step[ok], at[ok] + np.int32(1)
            ids = value[node]
            hit = ids >= 0
            b, e = begin[hit], at[hit]
            found.append((b, e, ids[hit]))
            reach[b] = e  # ends grow from step to step
            single[b[e - b == size[b]]] = True
        none = starts[~single[starts]]
        ends = none + size[none]
        found.append((none, ends, np.full(len(none), -1, np.int32)))
        reach[none] = np.maximum(reach[none], ends)
        return *(np.concatenate(x) for x in zip(*found, strict=True)), reach

    def solve(self, words: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids and best scores of non-empty words whose spaces stand for markers, all words side by side.

        The words' bytes lie one after the other, each closed by a byte that UTF-8 has not; another
        such byte stands for a literal marker, which no piece covers. Where no piece reaches across
        a place every path breaks, so the parts between such places are solved apart: a step
        extends the best paths to the k-th byte of every part by all pieces that start there. Of
        equal scores the path whose last piece starts first is taken.
        """
        text = b"".join(w.encode("utf-8", "surrogatepass").replace(BAR, b"\xff").replace(b" ", BAR) + b"\xfe" for w in words)
        raw = np.frombuffer(text, np.uint8)
        stop = raw == 0xFE
        places = np.arange(len(raw), dtype=np.int32)
        starts = places[(raw & 0xC0 != 0x80) & ~stop]
        start, end, piece, reach = self.matches(raw, starts, SIZES[raw])
        across = np.maximum.accumulate(reach)
        fresh = np.zeros(len(raw), bool)  # starts of parts
        fresh[starts] = starts >= np.concatenate([[0], across])[starts]
        k = start - np.maximum.accumulate(np.where(fresh, places, 0))[start]
        order = np.argsort(k.astype(np.uint16) if not len(k) or k.max() < 1 << 16 else k, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        gain = self.gain[piece]
        best, back, last = np.full(len(raw), -np.inf), np.zeros(len(raw), np.int32), np.zeros(len(raw), np.int32)
        bounds = np.flatnonzero(np.diff(k[order], prepend=-1, append=-1))
        for n, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            s, e = start[lo:hi], end[lo:hi]
            score = gain[lo:hi] + best[s] if n else gain[lo:hi]
            better = score > best[e]
            e = e[better]
            best[e], back[e], last[e] = score[better], s[better], piece[lo:hi][better]
        ends = np.flatnonzero(fresh | stop)
        ends = ends[(ends > 0) & ~stop[ends - 1]]
        on, at = np.zeros(len(raw), bool), ends
        while len(at):
            on[at] = True
            at = back[at]
            at = at[~fresh[at]]
        owner = np.flatnonzero(stop)
        scores = np.bincount(np.searchsorted(owner, ends), best[ends], len(words))
        at = np.flatnonzero(on)
        ids, begin = last[at], back[at]
        bar = raw[begin] == 0xFF
        count = np.where(ids >= 0, 1, np.where(bar, len(BAR), at - begin))
        out = np.repeat(ids, count)
        loose = np.flatnonzero(out < 0)
        if len(loose):  # the byte pieces of what no piece covers
            of = np.repeat(np.arange(len(ids)), count)[loose]
            nth = loose - (np.cumsum(count) - count)[of]
            out[loose] = self.byte_ids[np.where(bar[of], np.frombuffer(BAR, np.uint8)[np.where(bar[of], nth, 0)], raw[np.where(bar[of], 0, begin[of] + nth)])]
        cells = out.astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(np.searchsorted(owner, at), count, len(words)))).astype(np.int64).tolist()
        return [cells[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)], scores

    def path(self, word: str) -> tuple[float, list[int]]:
        """Best score and ids of a word whose spaces stand for markers."""
        if not word:
            return 0.0, []
        ids, scores = self.solve([word])
        return float(scores[0]), np.frombuffer(ids[0], "<u4").tolist()

    def words(self, text: str | None) -> list[str]:
        """The text's words, each without the first of the spaces before it."""
        if not text:
            return []
        return [r[1:] for r in self.runs(" " + text)] if "  " in text or text[0] == " " or text[-1] == " " else text.split(" ")

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        memo, docs = self.memo, [self.words(t) for t in texts]
        wanted = set().union(*docs)
        new = wanted.difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = wanted
        some, held = [], 0
        for n, w in enumerate(new := list(new), 1):
            some.append(w)
            held += len(w)
            if held >= SOLVED or n == len(new):
                memo.update(zip(some, self.solve([" " + x for x in some])[0], strict=True))
                some, held = [], 0
        out = [b"".join(map(memo.__getitem__, d)) for d in docs]
        for w in new:
            if len(w) > MEMO_LENGTH:
                del memo[w]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids written by :meth:`encode`, or of any others as far as they are valid."""
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_models: dict[tuple, Pieces] = {}


def worker_pieces(path: str, scores: str) -> Pieces:
    """This Python worker's model, kept from task to task with the words it has solved."""
    if (path, scores) not in _models:
        _models[path, scores] = Pieces(path, scores)
    return _models[path, scores]


def encoded(text: Column, path: str, scores: str = "zipf") -> Column:
    """Piece ids of a text column, as binary little-endian 32-bit integers."""

    @F.pandas_udf("binary")
    def run(texts):
        model = worker_pieces(path, scores)
        return pd.Series(model.encode_all(texts.tolist()), dtype=object)

    return run(text)


def with_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", scores: str = "zipf") -> DataFrame:
    """Per row: key, ids (binary), n_pieces, and the text decoded from the ids."""

    def run(batches):
        model = worker_pieces(path, scores)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = model.encode_all(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([model.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "n_pieces", "decoded"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(run), "key long, ids binary, n_pieces long, decoded string").withColumnRenamed("key", key)

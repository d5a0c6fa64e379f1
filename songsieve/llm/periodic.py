r"""Periodic runs: stretches of words that repeat with a period, and texts collapsed to one copy of each.

A run is a stretch of consecutive words with smallest period q and a length of at least ``max(least, 2 * q)``
that no neighbouring word extends keeping that period.

Block convolution finds them. At scale b, a power of two, the words are cut into blocks of b; a run whose
period lies between 2b - 1 and 4b - 2 (from 1 at b = 2) holds a whole block and, a period later, its copy.
A block's distance to every place of the window that follows is the sum of squared differences of word numbers,
that is its own squares and the window's less twice their correlation; the correlation is made by an exact
integer number-theoretic transform of length 4b, for many blocks at once. Zero distances are seeds (place,
period), which are extended in both directions word by word, so a sum that is zero only modulo the prime does
no harm. Blocks with a word that does not occur again within the window are not transformed: they have no copy.

The transform works modulo a prime of 23 bits by products of 64 x 64 matrices in double precision, whose sums
stay below 2^53 and are exact. Blocks above ``LARGEST`` do not grow; longer periods are found by more windows.

Documents are independent rows: no shuffle, and the documents of a batch are searched as one sequence with a
separator of its own between any two, so no run crosses documents. Memory follows the longest document.

Defined cases: words are ``[^\x20\x09-\x0D]+``; a null text is an empty one, which has no words, no runs and
an empty collapsed text; rows that repeat an id, and null ids, are rows of their own; an empty table gives no
rows; other columns do not take part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from songsieve.llm.common import trimmed

#: A prime, 7 * 2^20 + 1, and a generator of its units.
PRIME, GENERATOR = 7_340_033, 3
#: Side of the matrices that make a transform; longer transforms are split into such factors.
RADIX = 64
#: Largest block, so that four blocks fit the longest transform modulo the prime.
LARGEST = 1 << 18
#: Cells of the blocks transformed at once, and words of the documents searched as one sequence.
CELLS, WORDS = 1 << 19, 1 << 17

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mod(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^53, in place, modulo the prime."""
    x -= np.floor(x * (1.0 / PRIME)) * PRIME
    x[x < 0] += PRIME
    x[x >= PRIME] -= PRIME
    return x


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base^e modulo the prime for every e."""
    e = exponents.astype(np.int64)
    out, square = np.ones(e.shape, np.int64), base
    for bit in range(int(e.max()).bit_length()):
        out = np.where(e >> bit & 1, out * square % PRIME, out)
        square = square * square % PRIME
    return out.astype(np.float64)


@cache
def _factors(n: int, inverse: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The transform matrix of the first factor of n and the twiddles between it and the rest."""
    a = min(n, RADIX)
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    grid = np.outer(np.arange(a), np.arange(a)) % a
    matrix = _powers(pow(root, n // a, PRIME), grid)
    if inverse:
        matrix = _mod(matrix * pow(a, -1, PRIME))
    return matrix, None if a == n else _powers(root, np.outer(np.arange(a), np.arange(n // a)))


def transformed(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row; its order is digit-reversed and undone by the inverse."""
    rows, n = x.shape
    matrix, twiddles = _factors(n, inverse)
    if twiddles is None:
        return _mod(x @ matrix)
    rest = n // RADIX
    if inverse:
        x = transformed(x.reshape(-1, rest), True).reshape(rows, RADIX, rest)
        return _mod(matrix @ _mod(x * twiddles)).reshape(rows, n)
    x = _mod(_mod(matrix @ x.reshape(rows, RADIX, rest)) * twiddles)
    return transformed(x.reshape(-1, rest)).reshape(rows, n)


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(block, least period, greatest period) so that every period up to half the longest document is met."""
    block, least = 2, 1
    while 2 * least <= longest:
        most = 4 * block - 2 if least < 2 * block else least + 2 * block - 1
        yield block, least, most
        least = most + 1
        block = min(2 * block, LARGEST)


def _again(words: np.ndarray) -> np.ndarray:
    """Distance from each word to its next occurrence; beyond the sequence where there is none."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), len(words), np.int64)
    same = words[order[1:]] == words[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def seeds(words: np.ndarray, again: np.ndarray, block: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, periods): blocks that occur again at a distance within the window, modulo the prime."""
    whole = len(words) // block * block
    starts = np.flatnonzero((again[:whole] <= most).reshape(-1, block).all(axis=1)) * block
    width = most - least + 1
    # numbers past the end belong to no word
    value = np.concatenate([words % PRIME, np.full(most + block, PRIME - 1)])
    squares = np.concatenate([[0], np.cumsum(value * value % PRIME)])
    at, periods = [], []
    for cut in range(0, len(starts), max(1, CELLS // (4 * block))):
        s = starts[cut : cut + max(1, CELLS // (4 * block)), None]
        own, window = np.zeros((2, len(s), 4 * block))
        own[:, :block] = value[s + np.arange(block - 1, -1, -1)]
        window[:, : width + block - 1] = value[s + least + np.arange(width + block - 1)]
        product = transformed(_mod(transformed(own) * transformed(window)), inverse=True)
        cross = product[:, block - 1 : block - 1 + width].astype(np.int64)
        places = s + least + np.arange(width)
        distance = (squares[s + block] - squares[s] + squares[places + block] - squares[places] - 2 * cross) % PRIME
        row, shift = np.nonzero(distance == 0)
        at.append(s[row, 0])
        periods.append(least + shift)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *periods])


def _extended(words: np.ndarray, place: int, period: int) -> tuple[int, int]:
    """First and last+1 word of the stretch around ``place`` that keeps the period."""
    top, step, stop = len(words) - period, 32, place
    while stop < top:
        end = min(stop + step, top)
        unlike = np.flatnonzero(words[stop:end] != words[stop + period : end + period])
        if len(unlike):
            stop += int(unlike[0])
            break
        stop, step = end, 2 * step
    start, step = place, 32
    while start > 0:
        end = max(start - step, 0)
        unlike = np.flatnonzero(words[end:start] != words[end + period : start + period])
        if len(unlike):
            start = end + int(unlike[-1]) + 1
            break
        start, step = end, 2 * step
    return start, stop + period


def runs_of(words: np.ndarray, longest: int, least: int = 12) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence of word numbers, by start, then period."""
    again = _again(words)
    cover_end, cover_period = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
    found: dict[tuple[int, int], int] = {}
    for block, low, high in scales(longest):
        at, periods = seeds(words, again, block, low, high)
        # a seed inside a run whose period divides its own leads to that run again
        new = (periods % cover_period[at] != 0) | (at + block + periods > cover_end[at])
        at, periods = at[new], periods[new]
        order = np.lexsort((at, periods))
        at, periods = at[order], periods[order]
        bounds = np.flatnonzero(np.diff(periods, prepend=0, append=0))
        made = []
        for left, right in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            period, i = int(periods[left]), left
            while i < right:
                start, end = _extended(words, int(at[i]), period)
                if end - start >= max(least, 2 * period) and found.get((start, end), period) >= period:
                    found[start, end] = period
                    made.append((end - start, start, end, period))
                # later seeds of the period inside the stretch lead to it again
                i = max(i + 1, left + int(np.searchsorted(at[left:right], end - period - block, "right")))
        for _, start, end, period in sorted(made, reverse=True):
            longer = end > cover_end[start:end]
            cover_end[start:end][longer], cover_period[start:end][longer] = end, period
    rows = np.array([(s, e, q) for (s, e), q in found.items()], np.int64).reshape(-1, 3)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


class _Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def searched(texts: list[str | None], least: int = 12) -> tuple[list[list[dict]], list[str], list[int]]:
    """Runs, collapsed text and number of words of each text."""
    # bytes split at exactly 0x20 and 0x09 to 0x0D
    split = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    numbers = _Numbers()
    words = np.empty(first[-1], np.int64)
    for begin, w in zip(first[:-1].tolist(), split, strict=True):
        words[begin : begin + len(w)] = np.fromiter(map(numbers.__getitem__, w), np.int64, len(w))
    words[first[1:] - 1] = len(numbers) + np.arange(len(split))  # separators, each unlike all else
    rows = runs_of(words, int(sizes.max(initial=0)), least)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    owner = np.searchsorted(first, rows[:, 0], "right") - 1
    runs: list[list[dict]] = [[] for _ in texts]
    for doc, (start, end, period) in zip(owner.tolist(), (rows - first[owner][:, None] * np.array([1, 1, 0])).tolist(), strict=True):
        runs[doc].append({"start": start, "length": end - start, "period": period})
    collapsed = []
    for doc, (begin, w) in enumerate(zip(first[:-1].tolist(), split, strict=True)):
        left = [x for x, k in zip(w, kept[begin : begin + len(w)].tolist(), strict=True) if k] if runs[doc] else w
        collapsed.append(b" ".join(left).decode())
    return runs, collapsed, sizes.tolist()


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Slices of about ``WORDS`` words (taken from sizes in characters), one document at least."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") // 5 + 1
        if i > begin and held + n > WORDS:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: runs as structs (start, length, period) by start, then period.

    ``collapsed`` joins the words by one space, without those that any run holds after its first period.
    """
    source = docs.select(F.col(key).alias(key), F.col(text).alias("__text"))
    run_type = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
    out = StructType([StructField(key, docs.schema[key].dataType)]).add("n_words", "long").add("runs", ArrayType(run_type)).add("collapsed", "string")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _groups(texts):
                runs, collapsed, sizes = searched(texts[begin:end], least)
                columns = [batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(runs, RUNS), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_words", "runs", "collapsed"])

    return source.mapInArrow(trimmed(run), out)

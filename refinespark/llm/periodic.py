"""Periodic runs of words by online dyadic square catching.

Words are appended; the text so far is cut, for every level k, into completed blocks of 2 ** k words.  Each
completed block has a catcher: it watches the words from 2 ** k to 2 ** (k + 1) places after the block's begin for
the block's next occurrence there.  For any window of 2 ** k words that an appended word completes there is exactly
one catcher of level k on watch, so an appended word costs one comparison of window names a level.  An occurrence
q words on begins a square of period q; the comparison of words q apart is then taken back to where it
begins and on with every appended word until two differ (suffix comparison).  Catches with one period that touch are
one comparison, and what it covers is a maximal stretch of period q: the squares merged into a run.

No run is missed: in a run of period q with 2 ** k <= q < 2 ** (k + 1) and at least four periods, words q
apart are equal over 3 * 2 ** k places or more, so two whole neighbouring blocks of level k lie in there and both are caught.
Names are hashes; every stretch is compared word by word before it counts, so a collision costs time only.
A stretch whose least period is smaller has that run's borders too (Fine and Wilf), so of equal borders the least period is kept.

Words are longest sequences of bytes outside white space, numbered exactly (a dictionary per step).
Null and empty texts: no words, no runs.  Rows are judged by their text alone: repeated rows, null ids, empty tables and
extra columns change nothing.  Many texts are appended to one sequence with a word of its own between them;
a task holds ``STEP_BYTES`` of text, or one longer text, with about 60 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import append_columns, flat, mix, prepare, steps, word_spans

#: A run has at least ``PERIODS`` periods and ``LEAST`` words.
PERIODS, LEAST = 4, 6
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _grown(old: np.ndarray, size: int) -> np.ndarray:
    """``old`` with room for ``size`` values at least."""
    if len(old) >= size:
        return old
    new = np.zeros(max(size, 2 * len(old), 1024), old.dtype)
    new[: len(old)] = old
    return new


class Catchers:
    """All catchers over the words appended so far.

    ``most``: words of the longest text in the sequence; no run is longer, so no period exceeds a ``PERIODS``-th of it.
    """

    def __init__(self, most: int | None = None):
        self.most, self.n = most, 0
        self.words = np.zeros(0, np.int64)
        self.total, self.power, self.inverse = (np.zeros(0, np.uint64) for _ in range(3))
        self.open: dict[int, int] = {}  # period: where the stretch that reaches the last word begins
        self.found: set[tuple[int, int, int]] = set()  # (start, end, period)

    def _names(self, at: np.ndarray, width: int) -> np.ndarray:
        """Names of the windows of ``width`` words at the places ``at``."""
        return (self.total[at + width] - self.total[at]) * self.power[at]

    def _extend(self, words: np.ndarray) -> None:
        old, new = self.n, self.n + len(words)
        self.words = _grown(self.words, new)
        self.words[old:new] = words
        self.total = _grown(self.total, new + 1)
        if len(self.power) < new + 1:
            self.power, self.inverse = (_grown(x, new + 1) for x in (self.power, self.inverse))
            for table, base in ((self.power, _BASE), (self.inverse, _INVERSE)):
                table[:] = np.uint64(base)
                table[0] = 1
                np.multiply.accumulate(table, out=table)
        np.cumsum(mix(words.astype(np.uint64)) * self.inverse[old:new], out=self.total[old + 1 : new + 1])
        self.total[old + 1 : new + 1] += self.total[old]
        self.n = new

    def append(self, words: np.ndarray) -> None:
        old = self.n
        self._extend(words)
        new = self.n
        for period, start in list(self.open.items()):  # suffix comparisons go on
            end = self._forward(old - period, period)
            if end < new:
                del self.open[period]
                self.found.add((start, end, period))
        level = 0
        longest = min(new, self.most or new)
        while PERIODS << level <= longest:
            self._catch(level, old)
            level += 1

    def _catch(self, level: int, old: int) -> None:
        """Windows of 2 ** level words that end in the appended part, each against the block on watch."""
        width = 1 << level
        at = np.arange(max(width, old - 2 * width + 1), self.n - width + 1)
        if not len(at):
            return
        block = (at >> level << level) - width
        heads = np.arange(block[0], block[-1] + 1, width)
        name = self._names(heads, width)
        hit = np.flatnonzero(self._names(at, width) == name[(block - block[0]) >> level])
        if len(hit) < 2:
            return
        block, period = block[hit], (at - block)[hit]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        joins = (np.diff(block) == width) & (np.diff(period) == 0)  # neighbouring blocks with one period
        first = np.flatnonzero(np.append(True, ~joins) & np.append(joins, False))
        last = np.flatnonzero(np.append(~joins, True) & np.append(False, joins))
        begin, end, period = block[first], block[last] + width, period[first]
        new = ~self._inside(begin, end + period, period)
        for a, b, q in zip(begin[new].tolist(), end[new].tolist(), period[new].tolist(), strict=True):
            if q not in self.open:
                self._follow(a, b, q)

    def _inside(self, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Whether each stretch lies in a known run whose period divides its own: then it has that run's borders."""
        runs = sorted((s, e, q) for s, e, q in [*self.found, *((s, self.n, q) for q, s in self.open.items())] if e - s >= PERIODS * q)
        if not runs or not len(begin):
            return np.zeros(len(begin), bool)
        start, stop, q = np.array(runs, np.int64).T
        at = np.maximum(np.searchsorted(start, begin, side="right") - 1, 0)
        return (start[at] <= begin) & (end <= stop[at]) & (period % q[at] == 0)

    def _follow(self, begin: int, end: int, period: int) -> None:
        """The maximal stretches of ``period`` that meet the caught places ``begin`` to ``end``."""
        same = self.words[begin:end] == self.words[begin + period : end + period]
        if same.all():
            pieces = [(begin, end)]
        else:  # a collision of names: what is equal by words counts
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            pieces = [(begin + int(x), begin + int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
        for a, b in pieces:
            stop = self._forward(b, period) if b == end else b + period
            start = self._backward(a, period) if a == begin else a
            if stop == self.n:
                self.open[period] = start
            else:
                self.found.add((start, stop, period))

    def _forward(self, place: int, period: int) -> int:
        """End of the stretch: words ``period`` apart are equal from ``place`` on."""
        size = 32
        while place + period < self.n:
            stop = min(place + size, self.n - period)
            differ = self.words[place:stop] != self.words[place + period : stop + period]
            if differ.any():
                return place + int(differ.argmax()) + period
            place, size = stop, size * 4
        return self.n

    def _backward(self, place: int, period: int) -> int:
        """Begin of the stretch: words ``period`` apart are equal before ``place``."""
        size = 32
        while place > 0:
            start = max(0, place - size)
            differ = (self.words[start:place] != self.words[start + period : place + period])[::-1]
            if differ.any():
                return place - int(differ.argmax())
            place, size = start, size * 4
        return 0

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs in the words so far, by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for start, end, period in [*self.found, *((s, self.n, q) for q, s in self.open.items())]:
            least[start, end] = min(period, least.get((start, end), period))
        return sorted((s, e - s, q) for (s, e), q in least.items() if e - s >= max(LEAST, PERIODS * q))


#: Words that one call appends; a longer sequence is appended in parts.
APPEND = 1 << 20


def find_runs(words: np.ndarray, most: int | None = None, part: int = APPEND) -> list[tuple[int, int, int]]:
    catchers = Catchers(most)
    for at in range(0, len(words), part):
        catchers.append(words[at : at + part])
    return catchers.runs()


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; equal numbers are equal bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = ends - starts
    own_end = np.cumsum(size)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    raw = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], own_end])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def text_runs(texts: pa.Array) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each text (in words of its own), the bytes, word starts and ends, and n + 1 offsets of the texts' words."""
    data, offs = flat(texts)
    starts, ends, first = word_spans(data, offs)
    n_texts = len(offs) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(n_texts)]
    count = np.diff(first)
    if not len(starts) or count.max() < LEAST:
        return found, data, starts, ends, first
    # one word of its own after each text: no stretch crosses it
    text = np.repeat(np.arange(n_texts), count)
    row = np.full(len(starts) + n_texts, -1, np.int64)
    row[np.arange(len(starts)) + text] = word_numbers(data, starts, ends)
    gaps = first[1:] + np.arange(n_texts)
    row[gaps] = -1 - np.arange(n_texts)
    begin = first[:-1] + np.arange(n_texts)
    for start, length, period in find_runs(row, int(count.max())):
        t = int(np.searchsorted(begin, start, side="right")) - 1
        found[t].append((start - int(begin[t]), length, period))
    return found, data, starts, ends, first


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that stay when every run keeps its first period."""
    drop = np.zeros(n, bool)
    for start, length, period in runs:
        drop[start + period : start + length] = True
    return np.flatnonzero(~drop)


def collapse(texts: pa.Array) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs of each text, and its words joined by one space without the repeats."""
    found, data, starts, ends, first = text_runs(texts)
    raw, out = data.tobytes(), []
    for t, runs in enumerate(found):
        a, b = int(first[t]), int(first[t + 1])
        keep = (kept_words(b - a, runs) + a) if runs else None
        if a == b:
            out.append(b"")
        elif keep is None:
            out.append(b" ".join(raw[starts[a] : ends[b - 1]].split()))
        else:
            out.append(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
    return found, out


RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
_ARROW_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def periodic_runs(df: DataFrame, text_col: str = "text", out: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``df`` plus the runs of each text and the text without their repeats (null text: no runs, empty)."""
    def compute(texts: pa.Array) -> list[pa.Array]:
        found, rest = collapse(texts)
        return [pa.array([[{"start": s, "length": m, "period": q} for s, m, q in runs] for runs in found], _ARROW_RUNS),
                pa.array(rest, pa.binary()).cast(pa.string())]

    return append_columns(df, text_col, [T.StructField(out, RUNS), T.StructField(collapsed, T.StringType())], compute)


def planted(doc_id: int | None, text: bytes) -> bytes:
    """The words of the text with the repeats that the query's contract plants by ``doc_id`` (fixed rule)."""
    if doc_id is None:
        return text
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return text
    words = text.split()
    n, g = len(words), h // 10
    if not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)])


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, its strongest one, and digests of all runs and of the text without repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prepare(spark)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                texts = part.column(1).cast(pa.binary()) if not pa.types.is_large_string(part.column(1).type) else part.column(1).cast(pa.large_binary())
                ids = part.column(0).to_pylist()
                found, rest = collapse(pa.array([planted(i, t or b"") for i, t in zip(ids, texts.to_pylist(), strict=True)], pa.large_binary()))
                best = [strongest(x) or (None, None, None) for x in found]
                lines = ["".join(f"{s},{m},{q}\n" for s, m, q in x) for x in found]
                longs = [[len(x) for x in found], [b[0] for b in best], [b[1] for b in best], [b[2] for b in best],
                         [None if b[0] is None else 1000 * b[1] // b[2] for b in best]]
                digests = [[hashlib.sha256(x.encode()).hexdigest() for x in lines], [hashlib.sha256(x).hexdigest() for x in rest]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in longs), *(pa.array(x, pa.string()) for x in digests)], names=names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_runs bigint, start bigint, length bigint, period bigint, "
                                "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string")

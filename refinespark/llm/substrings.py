"""Substring deduplication with fixed-block anchors.

Every text is cut in non-overlapping blocks of ``window // 2`` words.  If two texts share ``window`` words in a
row, one block of the first lies wholly in the shared passage, so a rolling window of that block's width in the
second equals it.  The steps, all in one plan over one shuffle of the texts:

1. Texts are dealt in chunks.  A chunk hashes its blocks and all its rolling windows, and sends one entry per
   different hash (is it a block, is it in two texts), sorted and delta-coded, to the bucket of the hash.
2. A bucket keeps the hashes that are a block somewhere and lie in two texts at least: the hits.  Each chunk
   gets back its own.
3. A chunk extends its hits: the ``window``-word windows around a hit are candidates.  Of equal windows only those
   with the smallest id of the chunk are sent on, the others are removed at once.
4. A bucket compares equal windows of all chunks; those with an id above the smallest are removed.  Runs of
   removed windows are the maximal exact repeats.
5. The chunk joins what is left of each text.

A group of copies costs one entry per chunk and window, whatever its size; nothing is collected, broadcast or
paired.  Chunks grow with the square root of the corpus beyond ``CHUNK_BYTES``, so entries stay dense.
Windows are compared by 80 bits (64 + 16) of two independent hashes over 64-bit word hashes; anchor hashes are
cut to a length that grows with the corpus and only choose candidates.

Ids are integers.  Null texts have no words.  A null id is neither smaller nor larger than any id: such a text
stays whole and removes nothing.  Rows with one id remove nothing from each other; repeated rows get equal
results.  Extra columns are not carried.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinespark.llm.common import as_binary, flat, prepare, steps, window_hashes, word_hashes, word_spans

WINDOW = 50
CHUNK_BYTES = 8 << 20


# --- sorted integers as bytes ------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, compressed: count, width and the planes that are not all zero."""
    values = np.ascontiguousarray(values, np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(8, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[9:], max_output_size=max(1, n * width)), np.uint8)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    values = np.asarray(values, np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# --- steps -------------------------------------------------------------------------------------


def _windows(words: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Whether a window of ``width`` words of one text begins at each word."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.arange(n) + width <= first[text + 1]


def _buckets(hashes: np.ndarray, bits: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes; a bucket is a range of hashes."""
    size = -(-(1 << bits) // n)
    bounds = np.searchsorted(hashes, np.array([min(size * k, (1 << bits) - 1) for k in range(n)] , np.uint64))
    bounds = [*bounds.tolist(), len(hashes)]
    yield from ((k, bounds[k], bounds[k + 1]) for k in range(n) if bounds[k] < bounds[k + 1])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Places where a group of equal values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _anchor_entries(window: int, bits: int, buckets: int):
    width = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
        texts = 0
        for batch in batches:
            for part in steps(batch, 1):
                data, offs = flat(part.column(1))
                starts, ends, first = word_spans(data, offs)
                words = word_hashes(data, starts, ends)
                size = np.diff(first)
                with_id = part.column(0).is_valid().to_numpy(zero_copy_only=False) & (size >= window)
                text = np.repeat(np.arange(len(size)), size)
                at = np.flatnonzero(_windows(words, first, width) & with_id[text])
                if not len(at):
                    continue
                hashes = window_hashes(words, width)[at] >> np.uint64(64 - bits)
                is_block = (at - first[text[at]]) % width == 0
                chunk = part.column(2).to_numpy()[text[at]]
                for c in np.unique(chunk).tolist():
                    own = chunk == c
                    held[c].append((hashes[own], is_block[own], (text[at[own]] + texts).astype(np.int32)))
                texts += len(size)
        for c, found in held.items():
            hashes, is_block, text = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, is_block, text = hashes[order], is_block[order], text[order]
            heads = _heads(hashes)
            flags = np.logical_or.reduceat(is_block, heads).astype(np.uint64) * np.uint64(2)
            flags += (np.minimum.reduceat(text, heads) != np.maximum.reduceat(text, heads)).astype(np.uint64)
            hashes = hashes[heads]
            rows = [(k, pack((np.diff(hashes[a:b], prepend=np.uint64(0)) << np.uint64(2)) | flags[a:b])) for k, a, b in _buckets(hashes, bits, buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([c] * len(rows), pa.int32()),
                                              pa.array([x for _, x in rows], pa.binary())], names=["bucket", "chunk", "entries"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    held: dict[int, list[tuple]] = defaultdict(list)
    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[k].append(tuple(row))
    return held


def _by_chunk(chunk: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(chunk, its sorted values)."""
    order = np.lexsort((values, chunk))
    chunk, values = chunk[order], values[order]
    heads = _heads(chunk) if len(chunk) else np.zeros(0, np.int64)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(chunk)], strict=True) if len(chunk) else ():
        yield int(chunk[a]), values[a:b]


def _chunk_rows(rows: list[tuple[int, bytes]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", name])


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches).values():
        entries = [unpack(x) for _, x in rows]
        chunk = np.repeat(np.array([c for c, _ in rows], np.int32), [len(x) for x in entries])
        hashes = np.concatenate([np.cumsum(x >> np.uint64(2), dtype=np.uint64) for x in entries])
        flags = np.concatenate(entries) & np.uint64(3)
        order = np.argsort(hashes, kind="stable")
        hashes, flags, chunk = hashes[order], flags[order], chunk[order]
        heads = _heads(hashes)
        count = np.diff(np.append(heads, len(hashes)))
        flags = np.bitwise_or.reduceat(flags, heads)
        hit = (flags >= 2) & ((count > 1) | (flags & np.uint64(1) == 1))
        hit = np.repeat(hit, count)
        yield _chunk_rows([(c, pack_sorted(x)) for c, x in _by_chunk(chunk[hit], hashes[hit])], "hits")


class Chunk:
    """The different texts of a chunk in order of (id, text); the words of all of them are numbered through."""

    def __init__(self, table: pa.Table):
        ids = table.column(0).to_pylist()
        texts = as_binary(table.column(1).combine_chunks()).to_pylist()
        self.rows = sorted(zip(ids, (x or b"" for x in texts), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.different = [r for i, r in enumerate(self.rows) if not i or r != self.rows[i - 1]]

    def slices(self) -> Iterator[tuple[int, list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the first word, rows, bytes, word starts, word ends, first word of each row)."""
        batch = pa.RecordBatch.from_arrays([pa.array([x for _, x in self.different], pa.binary())], names=["text"])
        before = at = 0
        for part in steps(batch, 0) if len(self.different) else ():
            data, offs = flat(part.column(0))
            starts, ends, first = word_spans(data, offs)
            yield before, self.different[at : at + part.num_rows], data, starts, ends, first
            before, at = before + len(starts), at + part.num_rows


def _candidates(window: int, bits: int, buckets: int):
    width = window // 2

    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, hits: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        rows: list[tuple] = []
        known = np.unique(np.concatenate([unpack_sorted(x) for x in hits.column(1).to_pylist()])) if hits.num_rows else np.zeros(0, np.uint64)
        parts = []
        for before, texts, data, starts, ends, first in Chunk(docs).slices() if len(known) else ():
            words = word_hashes(data, starts, ends)
            n = len(words)
            if n < window:
                continue
            size = np.diff(first)
            text = np.repeat(np.arange(len(size)), size)
            ids = np.array([0 if i is None else i for i, _ in texts], np.int64)
            usable = (np.array([i is not None for i, _ in texts]) & (size >= window))[text]
            found = window_hashes(words, width) >> np.uint64(64 - bits)
            hit = np.zeros(n + 1, np.int64)
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit[1 : len(found) + 1] = known[place] == found
            hit[1:] &= _windows(words, first, width) & usable
            np.cumsum(hit, out=hit)
            at = np.flatnonzero(_windows(words, first, window) & usable)
            at = at[hit[at + window - width + 1] > hit[at]]
            if len(at):
                parts.append((window_hashes(words, window)[at], window_hashes(words, window, seed=1)[at] & np.uint64(0xFFFF), ids[text[at]], at + before))
        if parts:
            h1, h2, ids, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, ids, h2, h1))
            h1, h2, ids, at = h1[order], h2[order], ids[order], at[order]
            heads = _heads(h1, h2)
            least = np.repeat(ids[heads], np.diff(np.append(heads, len(h1))))
            later = ids > least
            if later.any():
                rows.append((chunk % buckets, pack_sorted(np.sort(at[later])), *[b""] * 5))
            h1, h2, ids, at = (x[~later] for x in (h1, h2, ids, at))
            for k, a, b in _buckets(h1, 64, buckets):
                names, which = np.unique(ids[a:b], return_inverse=True)
                rows.append((k, b"", pack_sorted(h1[a:b]), pack(h2[a:b]), pack(at[a:b].astype(np.uint64)), names.tobytes(), pack(which)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return pa.table([pa.array(columns[0], pa.int32()), pa.array([chunk] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])],
                        names=["bucket", "chunk", "removed", "h1", "h2", "at", "ids", "which"])

    return run


def _later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches).values():
        done = [(c, removed) for c, removed, *_ in rows if removed]
        if done:
            yield _chunk_rows(done, "removed")
        rows = [r for r in rows if not r[1]]
        if not rows:
            continue
        h1, h2, at = (np.concatenate([read(r[k]) for r in rows]) for k, read in ((2, unpack_sorted), (3, unpack), (4, unpack)))
        sizes = [int.from_bytes(r[2][:8], "little") for r in rows]
        ids = np.concatenate([np.frombuffer(r[5], np.int64)[unpack(r[6]).astype(np.int64)] for r in rows])
        chunk = np.repeat(np.array([r[0] for r in rows], np.int32), sizes)
        order = np.lexsort((ids, h2, h1))
        h1, h2, ids = h1[order], h2[order], ids[order]
        heads = _heads(h1, h2)
        later = ids > np.repeat(ids[heads], np.diff(np.append(heads, len(h1))))
        yield _chunk_rows([(c, pack_sorted(x)) for c, x in _by_chunk(chunk[order][later], at[order][later])], "removed")


def _rest(window: int):
    def run(key: tuple[pa.Scalar, ...], docs: pa.Table, removed: pa.Table) -> pa.Table:
        chunk = Chunk(docs)
        gone = np.unique(np.concatenate([unpack_sorted(x) for x in removed.column(1).to_pylist()])).astype(np.int64) if removed.num_rows else np.zeros(0, np.int64)
        found: dict[tuple, tuple[int, int, bytes]] = {}
        for before, texts, data, starts, ends, first in chunk.slices():
            n = len(starts)
            own = gone[np.searchsorted(gone, before) : np.searchsorted(gone, before + n)] - before
            edge = np.zeros(n + window + 1, np.int64)
            np.add.at(edge, own, 1)
            np.add.at(edge, own + window, -1)
            kept = np.cumsum(edge)[:n] == 0
            left = np.concatenate([[0], np.cumsum(kept)])[first]
            for i, row in enumerate(texts):
                a, b = int(first[i]), int(first[i + 1])
                words = row[1].split()
                if left[i + 1] - left[i] < b - a:
                    words = [w for w, k in zip(words, kept[a:b].tolist(), strict=True) if k]
                found[row] = (b - a, b - a - len(words), b" ".join(words))
        rows = [found[r] for r in chunk.rows]
        return pa.table([pa.array([i for i, _ in chunk.rows], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                         pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, n_words, n_removed, kept) of every row; ``kept``: the words that stay, joined by one space.

    A word goes if a window of ``window`` words of its text covers it that is also in a text with a smaller id.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk_bytes = max(chunk_bytes, int(20 * math.sqrt(size)))
    chunks = max(-(-size // chunk_bytes), at_least)
    buckets = max(1, min(chunks, chunk_bytes // 1536))  # 256 entries of a chunk in each, about
    bits = min(60, max(40, size.bit_length() + 10))
    texts = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
             .withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk"))
    anchors = texts.mapInArrow(_anchor_entries(window, bits, buckets), "bucket int, chunk int, entries binary")
    hits = anchors.repartition(buckets, "bucket").mapInArrow(_shared_anchors, "chunk int, hits binary")
    candidates = texts.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        _candidates(window, bits, buckets), "bucket int, chunk int, removed binary, h1 binary, h2 binary, at binary, ids binary, which binary")
    removed = candidates.repartition(buckets, "bucket").mapInArrow(_later_windows, "chunk int, removed binary")
    return texts.groupBy("chunk").cogroup(removed.groupBy("chunk")).applyInArrow(
        _rest(window), "id bigint, n_words bigint, n_removed bigint, kept string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of every document that are left without its exact repeats of earlier documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeats(docs).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

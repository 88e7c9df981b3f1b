"""Token ids in binary files: bit-plane or byte-plane shuffling with a chunk index.

A file holds the ids of consecutive documents, in order of their ids, as chunks of ``CHUNK_IDS`` ids.  A chunk is
transposed into planes (the first bytes, or bits, of all its ids, then the second ones, ...), and each plane is
compressed with zstandard by itself.  The footer has the chunk index (place, number of ids and plane sizes of
each chunk) and the id and number of tokens of each document, so any range of ids is read by a few range reads.

Layout: ``MAGIC``, planes of all chunks, compressed footer, its length (8 bytes), ``MAGIC``.

A task writes files of its own and returns their rows; the table of these rows is written to the shared folder and
names the files that count, so a repeated attempt leaves an unread file at most.  A task holds one chunk and
the document list of one file (``FILE_IDS`` ids or ``FILE_DOCS`` documents at most, one longer text apart).

Null texts count as empty: only the end id.  Documents are in ascending order of their id, null ids first; rows with
one id follow each other, by a hash of their text.  Repeated rows are kept.  Empty table: no files, no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refinespark.llm.common import file_system, flat, new_folder, prepare, steps, written

#: The id that ends a document; the file's magic.
END_ID, MAGIC = 2, b"IDPLANES"
CHUNK_IDS = 1 << 16
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
#: Pieces of text whose ids a worker keeps, in two generations of so many; longer pieces are not kept.
KEPT_PIECES, KEPT_BYTES = 150_000, 48
#: Bytes of pieces that one call of the tokenizer gets.
CALL_BYTES = 1 << 10

_BLANK = np.zeros(256, bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_IS_BLANK = _BLANK.tolist()
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def blank_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to white space, that of Unicode included (fixed set of code points)."""
    blank = _BLANK[data]
    if len(data) > 1 and (data >= 0xC2).any():
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        for k in (0, 1):
            blank[k : len(data) - 1 + k] |= two
    if len(data) > 2 and (data >= 0xE1).any():
        x, y, z = data[:-2], data[1:-1], data[2:]
        three = ((x == 0xE1) & (y == 0x9A) & (z == 0x80)) | ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F)) | (
            (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)))
        for k in (0, 1, 2):
            blank[k : len(data) - 2 + k] |= three
    return blank


def piece_starts(data: np.ndarray, offs: np.ndarray, marks: bool = True) -> np.ndarray:
    """Where pieces begin: at each text, and where the pre-tokenizer never joins two characters.

    A space or a newline with no white space on either side of it begins a token, and such a newline is a token of its own.
    With ``marks`` also an ASCII mark after a letter (ASCII, or U+00C0 to U+00FF but the two signs there).
    """
    n = len(data)
    begins = np.zeros(n + 1, bool)
    begins[offs] = True
    if n > 2:
        blank = blank_bytes(data)
        inner = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~blank[:-2] & ~blank[2:] & ~begins[1:n - 1] & ~begins[2:n]
        begins[1 : n - 1] |= inner
        begins[2:n] |= inner & (data[1:-1] == 10)
        if marks:
            letter = _LETTER[data[1:-1]] | ((data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7))
            begins[2:n] |= letter & _MARK[data[2:]]
    return np.flatnonzero(begins[:n])


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    Texts are cut in pieces that the pre-tokenizer never joins (``piece_starts``); each different piece of a slice is looked
    up once.  Unknown pieces are encoded many in a call, end to end, and told apart by the bytes of their ids.  Pieces with white
    space at an end, or with a special token's text, are encoded each by itself.  Of two generations of known pieces the older one goes
    when the younger is full; what is met again stays.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        known = json.loads(self.model.to_str())
        before = known["pre_tokenizer"] or {}
        if known["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("the tokenizer must be a byte-level BPE with the usual pattern, without a normaliser or a prefix space")
        self.special = [x["content"].encode() for x in known["added_tokens"]]
        self.size = np.zeros(self.model.get_vocab_size(), np.int64)  # a byte-level token has one character a byte
        for token, i in self.model.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)
        self.kept: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def alone(self, pieces: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def together(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces without white space at their ends, but for one space in front: end to end, a newline before those without a space."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        gap = np.fromiter((p[0] != 32 for p in pieces), bool, len(pieces))
        stop = np.cumsum(size + gap)
        cuts = np.flatnonzero(np.diff(stop // CALL_BYTES, prepend=-1)).tolist()
        calls = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(pieces)], strict=True)]
        whole = [b"".join([b"\n" + p if p[0] != 32 else p for p in pieces[c]]).decode() for c in calls]
        out: list[bytes] = []
        for c, found in zip(calls, self.model.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            place = np.concatenate([[0], np.cumsum(self.size[ids])])
            end = stop[c] - (stop[c.start] - size[c.start] - gap[c.start])
            cut = np.stack([end - size[c], end], axis=1)
            where = np.searchsorted(place, cut)
            if place[-1] != end[-1] or not np.array_equal(place[np.minimum(where, len(ids))], cut):
                out += self.alone(pieces[c])
                continue
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * b] for a, b in where.tolist()]
        return out

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of different pieces."""
        found: list[bytes | None] = list(map(self.kept.get, pieces))
        unknown = []
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = ids = self.older.get(pieces[k])
                if ids is None:
                    unknown.append(k)
                else:
                    self.kept[pieces[k]] = ids
        plain, odd = [], []
        for k in unknown:
            p = pieces[k]
            if p[0] < 128 and p[-1] < 128:
                is_odd = _IS_BLANK[p[-1]] or (_IS_BLANK[p[0]] and (p[0] != 32 or len(p) == 1))
            else:
                ends = blank_bytes(np.frombuffer(p[:4] + p[-4:], np.uint8))
                is_odd = ends[-1] or (ends[0] and p[0] != 32)
            if is_odd or any(map(p.__contains__, self.special)):
                odd.append(k)
            else:
                plain.append(k)
        for group, way in ((plain, self.together), (odd, self.alone)):
            for k, ids in zip(group, way([pieces[k] for k in group]), strict=True):
                found[k] = ids
                if len(pieces[k]) <= KEPT_BYTES:
                    self.kept[pieces[k]] = ids
        if len(self.kept) > KEPT_PIECES:
            self.kept, self.older = {}, self.kept
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the n + 1 offsets of the texts in them (null: empty)."""
        data, offs = flat(texts)
        starts = piece_starts(data, offs, not any(map(data.tobytes().__contains__, self.special)))
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        cuts = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, cuts, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        known = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, count = np.cumsum(size) - size, size[which]
        end = np.cumsum(count)
        out = known[np.arange(end[-1]) + np.repeat(first[which] - end + count, count)]
        return out, np.concatenate([[0], end])[np.searchsorted(starts, offs)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# --- planes ------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    spread = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(spread, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    """One file, written from front to back."""

    def __init__(self, path: str, bits: bool):
        system, at = file_system(path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.path, self.bits, self.out = path, bits, system.open_output_stream(at, compression=None)
        self.out.write(MAGIC)
        self.place, self.held, self.held_ids = len(MAGIC), [], 0
        self.chunks: list[tuple[int, ...]] = []
        self.docs: list[tuple[int | None, int]] = []
        self.ids = 0
        self.squeeze = zstandard.ZstdCompressor(level=3).compress

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.squeeze(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.place, len(ids), *map(len, planes)))
        self.out.write(b"".join(planes))
        self.place += sum(map(len, planes))

    def add(self, doc: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((doc, n))
        self.ids += n
        self.held.append(ids)
        self.held_ids += n
        if self.held_ids >= CHUNK_IDS:
            whole = np.frombuffer(b"".join(self.held), "<u4")
            full = len(whole) // CHUNK_IDS * CHUNK_IDS
            for at in range(0, full, CHUNK_IDS):
                self._chunk(whole[at : at + CHUNK_IDS])
            self.held, self.held_ids = [whole[full:].tobytes()], len(whole) - full

    def close(self) -> dict:
        if self.held_ids:
            self._chunk(np.frombuffer(b"".join(self.held), "<u4"))
        chunks = np.array(self.chunks, "<i8").reshape(len(self.chunks), -1)
        known = np.array([d is not None for d, _ in self.docs], np.uint8)
        docs = np.array([(d or 0, n) for d, n in self.docs], "<i8").reshape(-1, 2)
        footer = self.squeeze(struct.pack("<qqq", *chunks.shape, len(docs)) + chunks.tobytes() + docs.tobytes() + known.tobytes())
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)
        self.out.close()
        return {"path": self.path, "n_docs": len(self.docs), "n_ids": self.ids}


class Reader:
    """Range reads of one file."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self.file = system.open_input_file(at)
        end = self.file.size()
        size, = struct.unpack("<q", self._read(end - 16, 8))
        if self._read(end - 8, 8) != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError(f"{path} is no file of ids")
        footer = zstandard.ZstdDecompressor().decompress(self._read(end - 16 - size, size))
        rows, width, docs = struct.unpack_from("<qqq", footer)
        place = 24 + 8 * rows * width
        self.chunks = np.frombuffer(footer, "<i8", rows * width, 24).reshape(rows, -1) if rows else np.zeros((0, 6), np.int64)
        table = np.frombuffer(footer, "<i8", 2 * docs, place).reshape(-1, 2)
        known = np.frombuffer(footer, np.uint8, docs, place + 16 * docs)
        self.doc_ids, self.lengths = [int(d) if k else None for d, k in zip(table[:, 0], known, strict=True)], table[:, 1]
        self.first = np.concatenate([[0], np.cumsum(self.chunks[:, 1])]) if rows else np.zeros(1, np.int64)

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(size))

    def chunk(self, k: int) -> np.ndarray:
        place, n, *sizes = self.chunks[k].tolist()
        raw, planes, at = self._read(place, sum(sizes)), [], 0
        for size in sizes:
            planes.append(zstandard.ZstdDecompressor().decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, n)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file, from the chunks that hold them."""
        found = [np.zeros(0, "<u4")]
        for k in range(max(0, int(np.searchsorted(self.first, start, side="right")) - 1), len(self.chunks)):
            if self.first[k] >= stop:
                break
            found.append(self.chunk(k)[max(0, start - int(self.first[k])) : stop - int(self.first[k])])
        return np.concatenate(found)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(id, number of ids, crc32 of the ids) of each document, one chunk in memory at a time."""
        k = at = 0
        ids = self.chunk(0) if len(self.chunks) else np.zeros(0, "<u4")
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            left, crc = n, 0
            while left:
                if at == len(ids):
                    k, at = k + 1, 0
                    ids = self.chunk(k)
                take = min(left, len(ids) - at)
                crc = zlib.crc32(ids[at : at + take].tobytes(), crc)
                at, left = at + take, left - take
            yield doc, n, crc


# --- Spark ---------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, bits: bool = False) -> DataFrame:
    """Encode and write all texts; the files in order: (path, n_docs, n_ids, start), ``start``: ids in files before."""
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, model, files, end, out = TaskContext.get().partitionId(), encoder(tokenizer), [], array("I", [END_ID]).tobytes(), None
        for batch in batches:
            for rows in steps(batch, 1):
                ids, offs = model.encode(rows.column(1))
                for doc, a, b in zip(rows.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    if out is None:
                        out = Writer(f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids", bits)
                    out.add(doc, ids[a:b].tobytes() + end)
                    if out.ids >= FILE_IDS or len(out.docs) >= FILE_DOCS:
                        files.append(out.close())
                        out = None
        if out is not None:
            files.append(out.close())
        yield pa.RecordBatch.from_pylist([{"part": part, "seq": k, **f} for k, f in enumerate(files)], schema=pa.schema(
            [("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, "id")
               .sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text")))
    files = written(ordered.mapInArrow(run, "part int, seq int, path string, n_docs bigint, n_ids bigint"), "id-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.select("path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def read_documents(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(Reader(path).documents())
                lengths = np.array([n for _, n, _ in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in found], pa.int64()), pa.array(start + np.cumsum(lengths) - lengths, pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array([c for _, _, c in found], pa.int64())],
                                                 names=["id", "start", "n_tokens", "ids_crc32"])

    rows = written(files, "id-order")
    return (rows.select("path", "start").repartition(max(1, rows.count()))
            .mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, written, and read back from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_documents(write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))).withColumnRenamed("id", "doc_id")

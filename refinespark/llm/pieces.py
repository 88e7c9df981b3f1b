"""SentencePiece encoding by sampling, and decoding.

Forward filtering, backward sampling over the piece lattice: a text, with the model's leading space, is cut into
units (spaces and the characters up to the next space; no piece but runs of spaces crosses such a place).  Each
different unit of a slice gets its lattice once, ``LATTICE_BYTES`` of units at a time: a trie walk from every character finds all pieces, and a character
that is no piece of its own gets its byte pieces.  Forward sums give each node its weight over all segmentations;
backward, each occurrence of the unit draws one segmentation with probability in proportion to the product of
its pieces' weights.  Every draw is a hash of (seed, row key, place in the text): the same row gives the same
pieces on any cluster, in any order of rows.

Weights: a unigram model's log-probabilities; a BPE model's scores are merge ranks, taken as probabilities by
Zipf's law (``-log(1 + rank)``).  ``alpha`` sharpens (above 1) or flattens them.

Decoding joins the pieces and drops the leading space; byte pieces give their byte, so any text comes back as it was,
a literal U+2581 too (it is encoded by bytes).  The model must have byte pieces, add a leading space and leave
the text as it is otherwise.

Null text: null ids; empty text: no ids.  Null ids (decoding): null text.  Rows with one key and one text get one
segmentation; null keys count as one key.  Empty tables and extra columns: as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import as_binary, fresh_names, mix, prepare, release, starts_char, steps, word_hashes

SEED, ALPHA = 7, 1.0
#: Text bytes of one step; a longer single text is a step of its own.
STEP = 1 << 20
#: Bytes of different units whose lattices are built at once (one longer unit alone); a lattice takes about 1 KB a byte.
LATTICE_BYTES = 1 << 15
#: Shares of a node's edges are whole multiples of one of so many, so that sums do not depend on what else is in the lattice.
_PARTS = 1 << 32
_SPACE = 32
_FREE = np.uint64((1 << 64) - 1)


class Model:
    """Pieces of a SentencePiece model as bytes (spaces for U+2581), their log weights, and a trie as a hash table."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        scores = np.array([model.get_score(i) for i in range(n)], np.float64)
        ranks = bool((scores == np.floor(scores)).all())
        self.weight = -np.log1p(-np.minimum(scores, 0)) if ranks else scores
        self.byte = np.full(256, -1, np.int32)
        self.surface: list[bytes] = [b""] * n
        words: dict[bytes, int] = {}
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte[value], self.surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.surface[i] = model.id_to_piece(i).replace("▁", " ").encode()
                words.setdefault(self.surface[i], i)
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces, so it can't encode every text")
        lowest = self.weight[[*words.values()]].min()
        self.weight[self.byte] = lowest
        self.lengths = np.array([len(x) for x in self.surface])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self._trie(words)

    def _trie(self, words: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for word, i in words.items():
            at = 0
            for b in word:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    piece.append(-1)
                at = children[at][b]
            piece[at] = i
        self.piece = np.array(piece, np.int32)
        keys = np.array([state << 8 | b for state, own in enumerate(children) for b in own], np.uint64)
        following = np.array([state for own in children for state in own.values()], np.int32)
        bits = max(8, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.owner, self.next = np.full(1 << bits, _FREE, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # each round every free slot takes the first that asks for it, the others go one on
            asked, first = np.unique(slot[left], return_index=True)
            takes = first[self.owner[asked] == _FREE]
            self.owner[slot[left[takes]]], self.next[slot[left[takes]]] = keys[left[takes]], following[left[takes]]
            left = np.delete(left, takes)
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _follow(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after ``byte``, or -1; the table has a free slot after every run, where a search ends."""
        keys = state.astype(np.uint64) << np.uint64(8) | byte
        slot = self._slot(keys)
        owner = self.owner[slot]
        found = np.where(owner == keys, self.next[slot], -1)
        left = np.flatnonzero((owner != keys) & (owner != _FREE))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            owner = self.owner[slot[left]]
            found[left] = np.where(owner == keys[left], self.next[slot[left]], -1)
            left = left[(owner != keys[left]) & (owner != _FREE)]
        return found

    def edges(self, data: np.ndarray, chars: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece): all pieces that begin at the places ``chars`` and do not cross ``end`` (of each place)."""
        found, at, state, size = [], chars, np.zeros(len(chars), np.int32), 0
        while len(at):
            state = self._follow(state, data[at + size])
            go = state >= 0
            at, state, end = at[go], state[go], end[go]
            size += 1
            piece = self.piece[state]
            hit = piece >= 0
            found.append((at[hit], at[hit] + size, piece[hit]))
            more = at + size < end
            at, state, end = at[more], state[more], end[more]
        return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Lattice:
    """Lattices of different units; the place b of unit u is node b + u, so each unit has an end node of its own."""

    def __init__(self, model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alpha: float):
        n = len(data)
        unit = np.repeat(np.arange(len(starts)), ends - starts)
        boundary = starts_char(data)
        boundary[starts] = True
        chars = np.flatnonzero(boundary)
        char_end = np.append(chars[1:], n)
        a, b, piece = model.edges(data, chars, ends[unit[chars]])
        has_own = np.zeros(n, bool)
        own_end = np.zeros(n, np.int64)
        own_end[chars] = char_end
        has_own[a[b == own_end[a]]] = True
        alone = np.flatnonzero(~has_own[np.repeat(chars, char_end - chars)])  # bytes of characters that are no piece
        a = np.concatenate([a, alone])
        b = np.concatenate([b, alone + 1])
        piece = np.concatenate([piece, model.byte[data[alone]]])
        u = unit[a]
        order = np.lexsort((b, b - starts[u]))
        a, b, piece, u = a[order], b[order], piece[order], u[order]
        self.starts, self.piece = starts, piece
        self.origin, target = a + u, b + u
        self.end_node = ends + np.arange(len(ends))
        nodes = n + len(starts)
        weight = alpha * model.weight[piece]
        forward = np.full(nodes, -np.inf)
        forward[starts + np.arange(len(starts))] = 0.0
        depth = b - starts[u]
        heads = np.flatnonzero(np.diff(target, prepend=-1))  # first edge of each node
        levels = np.flatnonzero(np.diff(depth, prepend=-1))
        share = np.empty(len(piece))
        for lo, hi in zip(levels.tolist(), [*levels[1:].tolist(), len(piece)], strict=True):
            own = heads[np.searchsorted(heads, lo) : np.searchsorted(heads, hi)]
            value = forward[self.origin[lo:hi]] + weight[lo:hi]
            count = np.diff(np.append(own, hi))
            best = np.maximum.reduceat(value, own - lo)
            best = np.where(np.isfinite(best), best, 0.0)
            value = np.exp(value - np.repeat(best, count))
            total = np.add.reduceat(value, own - lo)
            with np.errstate(divide="ignore", invalid="ignore"):
                forward[target[own]] = best + np.log(total)
                share[lo:hi] = value / np.repeat(total, count)
        share = np.nan_to_num(share)
        self.forward = forward
        self.upto = np.cumsum(np.rint(share * _PARTS).astype(np.int64))
        self.first, self.last = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        self.first[target[heads]], self.last[target[heads]] = heads, np.append(heads[1:], len(piece)) - 1

    def draw(self, which: np.ndarray, place: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        """Draw a segmentation for each occurrence: of unit ``which``, from byte ``place`` on; each piece goes to ``ids`` at its first byte.

        ``key``: hash of the row minus the place where it begins, so that draws depend on the row and the place in it.
        """
        node = self.end_node[which]
        start_node = self.starts[which] + which
        shift = place - start_node
        while len(node):
            random = mix(key + (node + shift).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            random = (random >> np.uint64(11)).astype(np.float64) * 2.0**-53
            first, last = self.first[node], self.last[node]
            before = np.where(first > 0, self.upto[first - 1], 0)
            edge = np.searchsorted(self.upto, before + (random * (self.upto[last] - before)).astype(np.int64), side="right")
            edge = np.clip(edge, first, last)
            node = self.origin[edge]
            ids[node + shift] = self.piece[edge]
            more = node != start_node
            node, start_node, shift, key = node[more], start_node[more], shift[more], key[more]


def encode_texts(model: Model, texts: list[bytes], keys: np.ndarray, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, n + 1 offsets of the texts in them, the bytes that were encoded, n + 1 offsets in these)."""
    lead = [b" " + t if t else b"" for t in texts]
    data = np.frombuffer(b"".join(lead), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in lead])]).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), data, offs
    space = data == _SPACE
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offs[:-1][offs[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    _, first, which = np.unique(word_hashes(data, starts, ends) + (ends - starts).astype(np.uint64), return_index=True, return_inverse=True)
    size = (ends - starts)[first]
    order = np.argsort(size, kind="stable")  # units of like length together: a lattice has as many levels as its longest
    first, size = first[order], size[order]
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    which = rank[which.reshape(-1)]
    turn = np.argsort(which, kind="stable")
    which = which[turn]
    text = np.searchsorted(offs, starts, side="right") - 1
    key = keys[text] - offs[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ids = np.full(len(data), -1, np.int32)
    at, upto = 0, np.cumsum(size)
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + LATTICE_BYTES, side="right")))
        own_size = size[at:stop]
        own_end = np.cumsum(own_size)
        own = data[np.arange(own_end[-1]) + np.repeat(starts[first[at:stop]] - own_end + own_size, own_size)]
        lattice = Lattice(model, own, own_end - own_size, own_end, alpha)
        lo, hi = np.searchsorted(which, [at, stop])
        lattice.draw(which[lo:hi] - at, starts[turn[lo:hi]], key[turn[lo:hi]], ids)
        at = stop
    used = ids >= 0
    return ids[used], np.concatenate([[0], np.cumsum(used)])[offs], data, offs


def decode_bytes(model: Model, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces end to end, and the place where each piece ends."""
    size = model.lengths[ids]
    end = np.cumsum(size)
    if not len(ids):
        return np.zeros(0, np.uint8), end
    return model.bytes[np.arange(end[-1]) + np.repeat(model.places[ids] - end + size, size)], end


def decode_lists(model: Model, lists: pa.Array) -> pa.Array:
    """The text of each list of ids, without the leading space that encoding adds (null: null)."""
    count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, end = decode_bytes(model, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    offs = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]
    some = np.diff(offs) > 0
    keep = np.ones(len(raw), bool)
    keep[offs[:-1][some]] = False
    offs = offs - np.concatenate([[0], np.cumsum(some)])
    valid = np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
    found = pa.Array.from_buffers(pa.large_binary(), len(lists), [pa.py_buffer(valid), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[keep]))])
    return found.cast(pa.binary()).cast(pa.string())


RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])


def encode(df: DataFrame, model_path: str, key_col: str, text_col: str = "text", out: str = "ids", check: str | None = None,
           seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """``df`` plus the sampled piece ids; with ``check`` also whether decoding them gave the text back."""
    prepare(df.sparkSession)
    at = df.columns.index(text_col)
    key, = fresh_names(df, ["row_key"])
    extra = [T.StructField(out, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else [])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields] + extra)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        release()  # what earlier stages left in this worker
        for batch in batches:
            for part in steps(batch, at, STEP):
                *columns, keys = part.columns
                texts = as_binary(part.column(at))
                ids, offs, data, begins = encode_texts(model, [t or b"" for t in texts.to_pylist()], keys.to_numpy().view(np.uint64), alpha)
                null = ~texts.is_valid().to_numpy(zero_copy_only=False)
                found = pa.ListArray.from_arrays(pa.array(offs, pa.int32(), mask=np.append(null, False)), pa.array(ids, pa.int32()))
                new = [found]
                if check:
                    back, end = decode_bytes(model, ids)
                    same = back == data if len(back) == len(data) else np.zeros(len(data), bool)
                    wrong = np.concatenate([[0], np.cumsum(~same)])[begins]
                    new.append(pa.array(np.diff(wrong) == 0, pa.bool_(), mask=null))
                yield pa.RecordBatch.from_arrays([*columns, *new], names=names)
                release()

    return df.withColumn(key, F.xxhash64(F.lit(seed), F.col(key_col))).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the text that the ids stand for."""
    prepare(df.sparkSession)
    at = df.columns.index(ids_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields] + [T.StructField(out, T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_lists(model, batch.column(at))], names=names)

    return df.mapInArrow(run, schema)


def op8_sentencepiece_sampling(spark, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to its text."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id", check="lossless")
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "lossless")

"""Token ids by cut pieces against whole texts, files over their limits, and piece lattices against all segmentations."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from refinespark.llm import pieces, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")

ODD = [" ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "　", " ", " ", "​", " ", "a", "b", "The", "'s", "'", "é", "漢",
       "ㄱ", "1", "23", ".", ",", "—", "<|endoftext|>", "<|", "🙂", "́", "Â", "longer", "word " * 3]


def test_ids_of_pieces_equal_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PIECES", 500)  # generations change often
    monkeypatch.setattr(token_files, "CALL_BYTES", 200)
    rng, whole, encoder = random.Random(0), Tokenizer.from_file(BPE), token_files.Encoder(BPE)
    for _ in range(60):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 25))) for _ in range(100)] + [None, "", "x" * 3000]
        ids, offs = encoder.encode(pa.array(texts, pa.string()))
        for k, found in enumerate(whole.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[offs[k] : offs[k + 1]].tolist() == found.ids, texts[k]
    assert len(encoder.kept) <= 500 + 103 * 25
    assert encoder.encode(pa.array([], pa.string()))[0].tolist() == []


def test_a_call_whose_bytes_do_not_add_up_is_encoded_piece_by_piece(monkeypatch):
    encoder = token_files.Encoder(BPE)
    expected = encoder.alone([b" some", b"words", b" here"])
    encoder.size[:] = 1
    assert encoder.together([b" some", b"words", b" here"]) == expected


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("bits", [False, True])
def test_files_over_their_limits(spark, monkeypatch, bits):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 16)
    monkeypatch.setattr(token_files, "FILE_IDS", 200)
    monkeypatch.setattr(token_files, "FILE_DOCS", 7)
    rng = random.Random(bits)
    rows = [(i, " ".join(rng.choice(ODD) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(None, "no id"), (None, None)]
    whole = Tokenizer.from_file(BPE)
    files = token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), BPE, bits=bits)
    listed = files.orderBy("start").collect()
    assert len(listed) > 8 and all(f["n_docs"] <= 7 for f in listed)
    found = {r["id"]: r for r in token_files.read_documents(files).collect() if r["id"] is not None}
    start = sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows if i is None)
    for i, text in rows[:60]:
        ids = whole.encode(text, add_special_tokens=False).ids + [token_files.END_ID]
        assert tuple(found[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    reader = token_files.Reader(listed[0]["path"])
    everything = reader.range(0, listed[0]["n_ids"])
    assert len(everything) == listed[0]["n_ids"] and reader.range(5, 40).tolist() == everything[5:40].tolist()


# --- lattices -------------------------------------------------------------------------------------


def segmentations(model, unit):
    """(weight, pieces) of all ways to cut the bytes of a unit in pieces; a character that is no piece goes by bytes."""
    known = {}
    for i, word in enumerate(model.surface):
        if word and i not in set(model.byte.tolist()):
            known.setdefault(word, i)
    chars = [0]
    for ch in unit.decode():
        chars.append(chars[-1] + len(ch.encode()))
    edges = {}
    for a, b in itertools.combinations(chars, 2):
        if unit[a:b] in known:
            edges.setdefault(a, []).append((b, [known[unit[a:b]]]))
    for a, b in itertools.pairwise(chars):
        if unit[a:b] not in known:
            edges.setdefault(a, []).append((b, [int(model.byte[x]) for x in unit[a:b]]))

    def walk(a):
        if a == len(unit):
            yield 0.0, []
            return
        for b, ids in edges.get(a, []):
            for weight, rest in walk(b):
                yield weight + sum(model.weight[i] for i in ids), ids + rest
    return list(walk(0))


UNITS = [" the".encode(), " caféé".encode(), " 🙂a".encode(), " ▁x".encode(), "   ab".encode(), " hello".encode()]


def test_forward_weights_equal_the_sum_over_all_segmentations():
    model = pieces.load(MODEL)
    data = np.frombuffer(b"".join(UNITS), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    lattice = pieces.Lattice(model, data, ends - np.array([len(u) for u in UNITS]), ends, 1.0)
    for k, unit in enumerate(UNITS):
        every = segmentations(model, unit)
        assert math.isclose(lattice.forward[lattice.end_node[k]], math.log(sum(math.exp(w) for w, _ in every)), rel_tol=1e-9)


def test_draws_follow_the_weights_and_not_the_slice(monkeypatch):
    model = pieces.load(MODEL)
    n = 4000
    keys = pieces.mix(np.arange(n, dtype=np.uint64))
    text = "caféé 🙂a"
    ids, offs, _, _ = pieces.encode_texts(model, [text.encode()] * n, keys, 0.3)
    drawn = [tuple(ids[a:b].tolist()) for a, b in itertools.pairwise(offs.tolist())]
    first, second = (segmentations(model, u) for u in (" caféé".encode(), " 🙂a".encode()))
    weight = {tuple(x + y): math.exp(0.3 * (a + b)) for a, x in first for b, y in second}
    total = sum(weight.values())
    assert set(drawn) <= set(weight)
    for way, w in sorted(weight.items(), key=lambda x: -x[1])[:8]:
        p = w / total
        assert abs(drawn.count(way) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    monkeypatch.setattr(pieces, "LATTICE_BYTES", 1)  # each unit in a lattice of its own
    alone, _, _, _ = pieces.encode_texts(model, [text.encode()] * 50 + [b"other words entirely"], np.append(keys[:50], np.uint64(5)), 0.3)
    assert alone[: offs[50]].tolist() == ids[: offs[50]].tolist()


def test_decoding_lists_with_nulls_slices_and_empty_ones():
    model = pieces.load(MODEL)
    texts = ["one two", "", "ü 🙂", " lead", "▁"]
    ids, offs, _, _ = pieces.encode_texts(model, [t.encode() for t in texts], np.arange(5, dtype=np.uint64))
    lists = pa.array([None] + [ids[a:b].tolist() for a, b in itertools.pairwise(offs.tolist())] + [None, []], pa.list_(pa.int32()))
    assert pieces.decode_lists(model, lists).to_pylist() == [None, *texts, None, ""]
    assert pieces.decode_lists(model, lists.slice(2, 4)).to_pylist() == texts[1:5]
    assert pieces.decode_lists(model, lists.slice(0, 0)).to_pylist() == []

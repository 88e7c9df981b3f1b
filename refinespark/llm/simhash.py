"""SimHash near-duplicates: exact tiled comparison of 64-bit fingerprints.

A tile holds the fingerprints whose four 16-bit quarters have given numbers of set bits.  Two fingerprints at
most ``radius`` bits apart have quarter counts that differ by ``radius`` in sum at most, so only such tile pairs
meet (an equi-join on the tile); the others are skipped.  Tiles are packed in blocks of at most ``BLOCK``
different fingerprints, and a pair of blocks is compared exactly: exclusive-or, bit count.  No link is lost:
of the links within a pair of blocks a spanning star per group is kept, which joins the same texts, so
groups of copies cost rows in proportion to their fingerprints.  Equal fingerprints are one node.

Null, empty and word-less texts: fingerprint zero, linked like any other.  Texts of fewer words than the
shingle: one shingle.  A null id never names a group unless it has no other id (then the id of its component is
null).  Repeated rows and ids: every row is returned; ``keep_one`` keeps one row of each group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinespark.llm.common import as_binary, fresh_names, prepare, steps, written
from refinespark.llm.components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
BLOCK = 16_384
#: Pairs of the blocks of one tile are formed in so many parts.
PARTS = 16
#: Cells of one comparison step in a task (8 bytes each).
CELLS = 1 << 21
#: A fingerprint of more than one in so many rows is common: under ``COMMON`` of them exist, whatever the corpus.
COMMON = 1_000
QUARTERS, QUARTER_BITS = 4, 16

#: A-Z lower-cased; \x09-\x0D become the space that separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BITS_STEP = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of the text's ``width``-word shingles, repeats included, as a signed 64-bit integer."""
    words = text.translate(_NORMAL).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    begins = np.concatenate([[0], ends[: len(words) - width] + 1])
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(whole[a:b], SEED) for a, b in zip(begins.tolist(), ends[width - 1 :].tolist(), strict=True)]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _BITS_STEP):
        counts += np.unpackbits(hashes[i : i + _BITS_STEP], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp) of every row; ``fp`` is never null."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                found = [fingerprint(x or b"", width) for x in as_binary(part.column(1)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.int64())], names=["id", "text_hash", "fp"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, text_hash bigint, fp bigint"))


def _tile(counts) -> int:
    return sum(int(c) * (QUARTER_BITS + 1) ** k for k, c in enumerate(counts))


def neighbours(tile: int, radius: int) -> list[int]:
    """Tiles from ``tile`` on whose quarter counts differ from its own by ``radius`` in sum at most."""
    counts = [tile // (QUARTER_BITS + 1) ** k % (QUARTER_BITS + 1) for k in range(QUARTERS)]
    near = itertools.product(*(range(max(0, c - radius), min(QUARTER_BITS, c + radius) + 1) for c in counts))
    return sorted(t for x in near if sum(abs(a - b) for a, b in zip(x, counts, strict=True)) <= radius and (t := _tile(x)) >= tile)


def blocks(distinct: DataFrame, radius: int) -> DataFrame:
    """(tile, head, fps, near): different fingerprints packed by tile, ``head`` the first of the block.

    Dealt by ranges of (tile, fp): fingerprints differ, so a full tile is spread over many tasks.
    """
    count = lambda k: F.bit_count(F.shiftrightunsigned("fp", QUARTER_BITS * k).bitwiseAND(0xFFFF))
    tile = sum((count(k) * (QUARTER_BITS + 1) ** k for k in range(QUARTERS)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(tile: int, fps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([int(fps[0])], pa.int64()), pa.array([fps.tobytes()], pa.binary()),
                                               pa.array([neighbours(tile, radius)], pa.list_(pa.int32()))], names=["tile", "head", "fps", "near"])
        held_tile, held = -1, np.zeros(0, np.int64)
        for batch in batches:
            tiles, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(tiles)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(tiles)]):
                if a == b:
                    continue
                if tiles[a] != held_tile and len(held):
                    yield packed(held_tile, held)
                    held = held[:0]
                held_tile, held = int(tiles[a]), np.concatenate([held, fps[a:b]])
                while len(held) >= BLOCK:
                    yield packed(held_tile, held[:BLOCK])
                    held = held[BLOCK:]
        if len(held):
            yield packed(held_tile, held)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (distinct.select(tile.cast("int").alias("tile"), "fp").repartitionByRange(n, "tile", "fp").sortWithinPartitions("tile", "fp")
            .mapInArrow(run, "tile int, head bigint, fps binary, near array<int>"))


def merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (least node of each node's group) after the links i-j; links within a group are dropped first."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        while not np.array_equal(nxt := root[root], root):
            root = nxt
        label = root[label]


def links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (root, member) of each group that links of ``radius`` bits form in the two blocks."""
    nodes = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    label = np.arange(len(nodes))
    rows = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at : at + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        label = merge(label, i + at, j + shift)
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[member]], nodes[member]


def near_edges(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) fingerprints: edges whose components are those of all links of ``radius`` bits."""
    packed = written(blocks(distinct, radius), "blocks")
    # heads meet first, in ``PARTS`` parts of a tile; bytes join last, by block, so no tile is one task's
    heads = packed.select("tile", "head", "near")
    left = heads.select(F.explode("near").alias("tile"), F.col("head").alias("h1"), F.col("tile").alias("t1"), F.pmod(F.xxhash64("head"), F.lit(PARTS)).alias("part"))
    right = heads.select("tile", F.col("head").alias("h2"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"))
    near = left.join(right, ["tile", "part"]).filter("t1 != tile or h1 <= h2").select("h1", "h2")
    blocks_ = packed.select("head", "fps")
    pairs = (near.join(blocks_.toDF("h2", "f2"), "h2").join(blocks_.toDF("h1", "f1"), "h1")
             .select("f1", "f2", (F.col("h1") == F.col("h2")).alias("same")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [links(np.frombuffer(a, np.int64).view(np.uint64), np.frombuffer(b, np.int64).view(np.uint64), radius, same)
                     for a, b, same in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            a, b = (np.concatenate([x[k] for x in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, text_hash, fp, component_id) of every row; ``component_id``: the smallest id that links reach.

    Rows of common fingerprints (under ``COMMON`` of them, broadcast) get their component where they lie; the others are dealt by fingerprint.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    linked = components(near_edges(distinct, radius))
    named = (linked.join(distinct, linked["node"] == distinct["fp"]).groupBy("label").agg(F.min("least").alias("component_id")))
    linked = linked.join(named, "label").select(F.col("node").alias("fp"), "component_id")
    classes = written(distinct.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "least").alias("component_id")), "classes")
    common = F.broadcast(classes.filter(F.col("rows") * COMMON > prints.count()).drop("rows"))
    named = [prints.join(common, "fp"), prints.join(common, "fp", "left_anti").join(classes.drop("rows"), "fp")]
    return named[0].union(named[1]).select("id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` with the smallest id of their group, with the columns of ``docs``.

    A row that repeats both id and text of a kept row goes; rows without an id stay only if no row of their group has one.
    """
    groups = written(near_groups(docs, id_col, text_col, width, radius), "groups")
    chosen = groups.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    chosen = written(chosen, "chosen")
    name, text_hash = fresh_names(docs, ["chosen_id", "chosen_hash"])
    same = F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(text_hash))  # ids may repeat or be null
    kept = docs.join(chosen.select(F.col("id").alias(name), F.col("text_hash").alias(text_hash)), same, "left_semi")
    if chosen.filter("rows > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])


def op4_simhash_groups(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

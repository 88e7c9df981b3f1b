"""Jaccard join of word n-gram sets: size-banded tiles, hashed bitmap signatures, exact intersection.

A text's set holds the hashes of its different ``WIDTH``-word shingles.  Equal sets are one class, so copies cost
one comparison.  Two sets link when ``den * intersection >= num * union``.  Hence (with u = a + b - i):

* sizes bound a link: ``den * a >= num * b`` for a <= b.  Classes are sorted by size and cut into tiles of one
  bitmap width and a bounded number of classes; only tiles with compatible sizes meet (an equi-join on size bands);
* a signature is a bitmap of the parities of hashed shingles, at least as many bits as shingles.  A bit differs only if
  the sets differ there, so the bit count of the exclusive-or is at most the symmetric difference, and bounds
  the overlap from above.  Half the width, by folding, decides nearly all pairs; the rest are decided at full width.

What passes becomes a candidate: per pair of tiles a spanning star of each group, not all pairs.  Only members of
candidate groups get their sorted arrays (recomputed from the text); within a group they are tiled by size again, and a pair
of tiles is verified by bitmaps and exact intersection of sorted arrays.  Pairs that are already joined are
skipped, so a group of n near copies costs about n intersections a pair of tiles.  No link between classes is lost.

A word is a longest sequence of bytes outside white space after A-Z are lower-cased.  Shingles are told apart by 64-bit
hashes (keyed hashes of the words, mixed in order), equal sets by 128 bits of their sorted hashes.

Null, empty and word-less texts: an empty set, linked with nothing, a component of its own.  Texts of fewer words than
``WIDTH``: the whole sequence is one shingle.  A null id names no component unless it has no other id.  Repeated rows
and ids: every row is returned.  Empty tables give empty results; extra columns change nothing.

Memory: two tiles at a time (``TILE_MOST`` bitmaps at most, or ``SETS`` arrays of ``SET_BYTES`` in all, one larger set apart).
The work of the bitmap comparison grows with the square of the number of different sets within a size band, spread
over pairs of tiles; nothing but tile heads is exploded, bytes are joined last, and what is sent grows with the power 1.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refinespark.llm.common import flat, mix, prepare, steps, word_spans, written
from refinespark.llm.components import components
from refinespark.llm.periodic import word_numbers
from refinespark.llm.simhash import merge

WIDTH, NUM, DEN = 4, 85, 100
#: Classes of a tile: so many times the root of the number of classes, within these bounds (a tile is sent to each tile that it meets).
TILE_FACTOR, TILE_LEAST, TILE_MOST = 16, 4_096, 1 << 20
SETS, SET_BYTES = 1_024, 8 << 20
CELLS = 1 << 20
#: Pairs of tile heads of one size band are formed in so many parts.
PARTS = 32
#: Bits of the filter that keeps texts of no candidate out of the shuffle (a longer list of candidates only lets more texts pass).
FILTER_BITS = 1 << 20
#: A class of more than one in so many rows is common: under ``COMMON`` of them exist, whatever the corpus.
COMMON = 1_000
_SEED = 0x4A616363
_LEAST_BITS = 64


# --- sets ------------------------------------------------------------------------------------------


def distinct_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each word; each different word is hashed once."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    number = word_numbers(data, starts, ends)
    _, first = np.unique(number, return_index=True)
    raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    known = np.array([digest(raw[a:b], _SEED) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.uint64)
    return known[number]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    data, offs = flat(texts)
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends, first = word_spans(data, offs)
    words = distinct_hashes(data, starts, ends)
    n = len(words)

    def mixed(at: np.ndarray, size: int) -> np.ndarray:
        out = np.full(len(at), size, np.uint64)
        for k in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
        return out

    full = mixed(np.arange(max(0, n - width + 1)), width)
    found = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            found.append(np.unique(full[a : b - width + 1]))
        else:
            found.append(mixed(np.array([a]), b - a) if b > a else np.zeros(0, np.uint64))
    return found


def bits_of(n: np.ndarray | int) -> np.ndarray:
    """Bits of the signature of a set of ``n``: the power of two from n on, ``_LEAST_BITS`` at least."""
    return np.maximum(_LEAST_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))


def signature(values: np.ndarray) -> bytes:
    """Parities of the set's hashes modulo the number of bits."""
    size = int(bits_of(len(values)))
    parity = np.bincount((values & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def folded(signs: np.ndarray, words: int) -> np.ndarray:
    """Signatures (n, 64-bit words) folded to ``words``: the parities modulo fewer bits."""
    while signs.shape[1] > words:
        half = signs.shape[1] // 2
        signs = signs[:, :half] ^ signs[:, half:]
    return signs


def set_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, n, lo, hi, signs) of every row; lo and hi: 128 bits that name the set."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 1):
                sets = shingle_sets(part.column(1), width)
                name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(name[:, 0]), pa.array(name[:, 1]),
                     pa.array([signature(s) if len(s) else b"" for s in sets], pa.binary())], names=["id", "text_hash", "n", "lo", "hi", "signs"])

    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
            .mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, text_hash bigint, n bigint, lo bigint, hi bigint, signs binary"))


# --- tiles -----------------------------------------------------------------------------------------


def _pack(rows: DataFrame, payload: str, most: int, most_bytes: int, parts: int) -> DataFrame:
    """(grp, head, least, largest, members, sizes, payload): tiles of rows (grp, n, member, payload).

    Sorted by (grp, n, member) and dealt by ranges of these; a tile has one group, one bitmap width, at most ``most``
    members and about ``most_bytes`` of payload.  A member that repeats counts once.  ``head``: the first member.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tile(key: tuple[int, int], members: list[int], sizes: list[int], parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([members[0]], pa.int64()), pa.array([sizes[0]], pa.int64()), pa.array([sizes[-1]], pa.int64()),
                 pa.array([np.array(members, np.int64).tobytes()], pa.binary()), pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()),
                 pa.array([b"".join(parts)], pa.binary())], names=["grp", "head", "least", "largest", "members", "sizes", "payload"])

        key, members, sizes, parts, held = None, [], [], [], 0
        for batch in batches:
            grp, n, member, data = (c.to_pylist() for c in batch.columns)
            bits = bits_of(np.array(n, np.int64)).tolist()
            for g, s, m, d, b in zip(grp, n, member, data, bits, strict=True):
                if members and (key != (g, b) or len(members) >= most or held >= most_bytes):
                    if key == (g, b) and members[-1] == m:
                        continue
                    yield tile(key, members, sizes, parts)
                    members, sizes, parts, held = [], [], [], 0
                if members and members[-1] == m:
                    continue
                key = (g, b)
                members.append(m)
                sizes.append(s)
                parts.append(d)
                held += len(d)
        if members:
            yield tile(key, members, sizes, parts)

    return (rows.select("grp", "n", "member", payload).repartitionByRange(parts, "grp", "n", "member").sortWithinPartitions("grp", "n", "member")
            .mapInArrow(run, "grp bigint, head bigint, least bigint, largest bigint, members binary, sizes binary, payload binary"))


def _band(size: Column, num: int, den: int) -> Column:
    """Bands a little wider than the size bound, so that rounding never puts compatible sizes two bands apart."""
    return F.floor(F.log(size.cast("double")) / float(np.log(den / num) * (1 + 1e-6))).cast("int")


def _pairs(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different tiles of one group with compatible sizes: heads (h1, h2) first, bytes last.

    Equi-join on (group, size band, part); a band is as wide as the size bound, so compatible sizes are in one band or
    neighbouring ones.
    """
    heads = tiles.select("grp", "head", "least", "largest")
    bands = F.sequence(_band(F.col("least"), num, den), _band(F.col("largest"), num, den))
    left = heads.select("grp", F.col("head").alias("h1"), F.col("least").alias("a1"), F.col("largest").alias("b1"),
                        F.explode(F.array_distinct(F.flatten(F.transform(bands, lambda x: F.array(x - 1, x, x + 1))))).alias("band"),
                        F.pmod(F.xxhash64("head"), F.lit(PARTS)).alias("part"))
    right = heads.select("grp", F.col("head").alias("h2"), F.col("least").alias("a2"), F.col("largest").alias("b2"), F.explode(bands).alias("band"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    before = (F.col("a1") < F.col("a2")) | ((F.col("a1") == F.col("a2")) & (F.col("h1") < F.col("h2")))
    near = left.join(right, ["grp", "band", "part"]).filter(before & (den * F.col("b1") >= num * F.col("a2"))).select("h1", "h2").distinct()
    second = tiles.select(F.col("head").alias("h2"), F.col("members").alias("m2"), F.col("sizes").alias("s2"), F.col("payload").alias("p2"))
    first = tiles.select(F.col("head").alias("h1"), F.col("members").alias("m1"), F.col("sizes").alias("s1"), F.col("payload").alias("p1"))
    return near.join(second, "h2").join(first, "h1").select("m1", "s1", "p1", "m2", "s2", "p2")


def _edges(tiles: DataFrame, star, num: int, den: int, names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """``names`` (bigint) that ``star(tile, other or None)`` finds within each tile and in each pair of tiles that meet."""
    kind = ", ".join(f"{x} bigint" for x in names)

    def arrays(row: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
        return np.frombuffer(row[0], np.int64), np.frombuffer(row[1], np.int64), row[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = [c[k].as_py() for c in batch.columns]
                found = star(arrays(row[:3]), arrays(row[3:]) if len(row) > 3 else None)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=list(names))

    own = tiles.select("members", "sizes", "payload").mapInArrow(run, kind)
    return own.union(_pairs(tiles, num, den).mapInArrow(run, kind))


def _most(a, b, num: int, den: int):
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (den - num) // (den + num)


def near_cells(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, same: bool, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (i, j) whose bit counts allow a link, some rows at a time; with ``same`` only j > i.

    ``left``, ``right``: signatures of one width each (n, 64-bit words), sizes ascending.
    """
    words = min(left.shape[1], right.shape[1])
    left, right = folded(left, words), folded(right, words)
    half = max(1, words // 2)
    coarse_left, coarse_right = folded(left, half), folded(right, half)
    rows = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), rows):
        stop = min(at + rows, len(left))
        lo = at + 1 if same else int(np.searchsorted(n_right, -(-num * n_left[at] // den)))
        hi = int(np.searchsorted(n_right, den * n_left[stop - 1] // num, side="right"))
        if lo >= hi:
            continue
        count = np.zeros((stop - at, hi - lo), np.uint16 if half < 1024 else np.uint32)
        for w in range(half):
            count += np.bitwise_count(coarse_left[at:stop, w, None] ^ coarse_right[None, lo:hi, w])
        i, j = np.nonzero(count <= _most(int(n_left[stop - 1]), int(n_right[hi - 1]), num, den))
        i, j = i + at, j + lo
        a, b = n_left[i], n_right[j]
        ok = (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (i < j if same else True)
        i, j = i[ok], j[ok]
        for k in range(0, len(i), rows * 64):
            x, y = i[k : k + rows * 64], j[k : k + rows * 64]
            exact = np.bitwise_count(left[x] ^ right[y]).sum(axis=1, dtype=np.int64) <= _most(n_left[x], n_right[y], num, den)
            if exact.any():
                yield x[exact], y[exact]


def _signs(tile: tuple[np.ndarray, np.ndarray, bytes]) -> np.ndarray:
    return np.frombuffer(tile[2], np.uint64).reshape(len(tile[0]), -1)


def candidate_star(num: int, den: int):
    def star(one: tuple, other: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        left, right = _signs(one), _signs(other or one)
        members = one[0] if other is None else np.concatenate([one[0], other[0]])
        label, shift = np.arange(len(members)), 0 if other is None else len(left)
        for i, j in near_cells(left, one[1], right, (other or one)[1], other is None, num, den):
            label = merge(label, i, j + shift)
        member = np.flatnonzero(label != np.arange(len(label)))
        return members[label[member]], members[member]
    return star


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others."""
    size = np.array([len(x) for x in others])
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    return np.add.reduceat(one[at] == values, np.cumsum(size) - size, dtype=np.int64)


def tile_sets(tile: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted arrays of a tile and their signatures."""
    sets = np.split(np.frombuffer(tile[2], np.uint64), np.cumsum(tile[1])[:-1])
    return sets, np.frombuffer(b"".join(map(signature, sets)), np.uint64).reshape(len(sets), -1)


def linked_cells(one: tuple, other: tuple | None, num: int, den: int, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, ys, shared): linked sets of two tiles of sorted arrays (or within one), their exact intersections; ``wanted(x, ys)`` picks what is verified."""
    a, left = tile_sets(one)
    b, right = (a, left) if other is None else tile_sets(other)
    for i, j in near_cells(left, one[1], right, (other or one)[1], other is None, num, den):
        cut = np.flatnonzero(np.diff(i, prepend=-1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(i)], strict=True):
            x = int(i[lo])
            ys = wanted(x, j[lo:hi])
            if not len(ys):
                continue
            both = overlaps(a[x], [b[y] for y in ys.tolist()])
            ok = den * both >= num * (len(a[x]) + np.array([len(b[y]) for y in ys.tolist()]) - both)
            if ok.any():
                yield x, ys[ok], both[ok]


def verified_star(num: int, den: int):
    """As ``candidate_star`` for tiles of sorted arrays: an edge only where the exact intersection says so."""
    def star(one: tuple, other: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        if other is None and len(one[0]) == 1:
            return one[0][:0], one[0][:0]
        members = one[0] if other is None else np.concatenate([one[0], other[0]])
        label, shift = np.arange(len(members)), 0 if other is None else len(one[0])

        def apart(x: int, ys: np.ndarray) -> np.ndarray:  # what is joined already needs no proof
            return ys[label[ys + shift] != label[x]]

        for x, ys, _ in linked_cells(one, other, num, den, apart):
            label = merge(label, np.full(len(ys), x), ys + shift)
        member = np.flatnonzero(label != np.arange(len(label)))
        return members[label[member]], members[member]
    return star


def verified_links(num: int, den: int):
    """All links of tiles of sorted arrays: members of both ends and the size of their intersection."""
    def star(one: tuple, other: tuple | None) -> tuple[np.ndarray, ...]:
        found = [(np.full(len(ys), one[0][x]), (other or one)[0][ys], both) for x, ys, both in linked_cells(one, other, num, den, lambda x, ys: ys)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (one[0][:0],) * 3
    return star


# --- join ------------------------------------------------------------------------------------------


def _filter_place(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).cast("int")


def _filter_words(rows: DataFrame, columns: list[str]) -> Column:
    """A bit for the hash of each row, in ``FILTER_BITS`` / 64 numbers: a scalar of fixed size."""
    place = _filter_place(*columns)
    some = rows.groupBy((place / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)).alias("bits"))
    every = rows.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("w")).join(some, "w", "left")
    in_order = F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))))
    return every.agg(F.transform(in_order, lambda x: x["bits"])).scalar()


def _arrays(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(grp, n, member, payload): sorted arrays of the classes in ``wanted`` (grp, member, n, lo, hi, row_id, row_hash), from their text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    words, place = _filter_words(wanted, ["row_id", "row_hash"]), _filter_place("id", "text_hash")
    rows = rows.filter(F.getbit(F.element_at(words, (place / 64).cast("int") + 1), place % 64) == 1)
    found = (rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("row_id")) & (F.col("text_hash") == F.col("row_hash")))
             .select("grp", "n", "member", "text", "lo", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 3):
                data = [s.tobytes() for s in shingle_sets(part.column(3), width)]
                name = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data)), np.int64).reshape(-1, 2)
                own = (name[:, 0] == part.column(4).to_numpy()) & (name[:, 1] == part.column(5).to_numpy())  # not another text of this hash
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(data, pa.binary())], names=["grp", "n", "member", "payload"]).filter(pa.array(own))

    return found.mapInArrow(run, "grp bigint, n bigint, member bigint, payload binary")


def _candidates(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (``set_rows``), the classes of equal sets, and the tiles of the sorted arrays of those that bitmaps do not rule out."""
    if not 0 < num < den:
        raise ValueError("the similarity num / den must lie between 0 and 1")
    prints = written(set_rows(docs, id_col, text_col, width), "sets")
    named = (prints.filter("n > 0").groupBy("lo", "hi")
             .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"), F.max("signs").alias("signs"),
                  F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("row")))
    classes = written(named.select(F.monotonically_increasing_id().alias("member"), "lo", "hi", "least", "rows", "n", "signs",
                                   F.col("row.id").alias("row_id"), F.col("row.text_hash").alias("row_hash")), "classes")
    most = min(TILE_MOST, max(TILE_LEAST, int(TILE_FACTOR * classes.count() ** 0.5)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bitmaps = written(_pack(classes.withColumn("grp", F.lit(0).cast("bigint")), "signs", most, 256 << 20, max(parts // 4, 4)), "tiles")
    candidates = components(_edges(bitmaps, candidate_star(num, den), num, den))
    wanted = (candidates.join(classes.drop("signs"), candidates["node"] == classes["member"])
              .select(F.col("label").alias("grp"), "member", "n", "lo", "hi", "row_id", "row_hash"))
    rows = written(_arrays(docs, written(wanted, "wanted"), id_col, text_col, width), "arrays")
    return prints, classes, written(_pack(rows, "payload", SETS, SET_BYTES, parts), "array-tiles")


def _per_row(prints: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """(id, text_hash, n) of every row that has a set, with ``columns`` of its class in ``known`` (lo, hi, rows, columns).

    Rows of common classes (under ``COMMON`` of them, broadcast) get them where they lie; the others are dealt by class.
    """
    known = known.select("lo", "hi", "rows", *columns)
    common = F.broadcast(known.filter(F.col("rows") * COMMON > prints.count()).drop("rows"))
    some = prints.filter("n > 0").drop("signs")
    found = some.join(common, ["lo", "hi"]).union(some.join(common, ["lo", "hi"], "left_anti").join(known.drop("rows"), ["lo", "hi"]))
    return found.select("id", "text_hash", "n", *columns)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, text_hash, n, component_id) of every row; ``component_id``: the smallest id that links reach, its own included."""
    prints, classes, arrays = _candidates(docs, id_col, text_col, width, num, den)
    linked = components(_edges(arrays, verified_star(num, den), num, den))
    least = linked.join(classes.select("member", "least"), linked["node"] == F.col("member")).groupBy("label").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "label").select(F.col("node").alias("member"), "component_id")
    known = written(classes.join(linked, "member", "left").select("lo", "hi", "rows", F.coalesce("component_id", "least").alias("component_id")), "named")
    none = prints.filter("n = 0").select("id", "text_hash", "n", F.col("id").alias("component_id"))
    return _per_row(prints, known, ["component_id"]).union(none)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame]:
    """The whole join: links (a, b, shared) between classes of equal sets, and rows (id, text_hash, n, class, n_links).

    Each link of two different sets is there once, with the size of their intersection; every one is verified, so the
    work grows with the links, n squared in a group of n different texts that all link.  Rows of one ``class`` have equal
    sets and link too; ``n_links`` counts the other rows that a row links with.  Rows without words have no class and no link.
    """
    prints, classes, arrays = _candidates(docs, id_col, text_col, width, num, den)
    links = written(_edges(arrays, verified_links(num, den), num, den, ("a", "b", "shared")), "links")
    both = links.select("a", F.col("b").alias("member")).union(links.select(F.col("b").alias("a"), F.col("a").alias("member")))
    others = both.join(classes.select("member", "rows"), "member").groupBy("a").agg(F.sum("rows").alias("others"))
    known = classes.join(others, classes["member"] == others["a"], "left").select(
        "lo", "hi", "rows", F.col("member").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).cast("bigint").alias("n_links"))
    none = prints.filter("n = 0").select("id", "text_hash", "n", F.lit(None).cast("bigint").alias("class"), F.lit(0).cast("bigint").alias("n_links"))
    return links, _per_row(prints, written(known, "linked"), ["class", "n_links"]).union(none)


def op11_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_groups(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


ORACLE_SQL = r"""with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
sh as materialized (select distinct doc_id, array_to_string(ws[i : i + 3], ' ') s
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) i from w where len(ws) > 0)),
sets as materialized (select doc_id, count(*) n, md5(string_agg(s, chr(10) order by s)) k from sh group by doc_id),
reps as materialized (select k, min(doc_id) r, any_value(n) n from sets group by k),
rs as materialized (select sh.doc_id r, sh.s from sh join reps on reps.r = sh.doc_id),
common as materialized (select a.r x, b.r y, count(*) i from rs a join rs b on a.s = b.s and a.r < b.r
  join reps p on p.r = a.r join reps q on q.r = b.r where 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n) group by a.r, b.r),
links as materialized (select x, y from common join reps p on p.r = x join reps q on q.r = y where 100 * i >= 85 * (p.n + q.n - i)),
both_ways as materialized (select x, y from links union all select y, x from links),
reach as (select r, r c from reps union select b.y, reach.c from reach join both_ways b on b.x = reach.r),
comp as (select r, min(c) c from reach group by r)
select d.doc_id, coalesce(s.n, 0) n_shingles, coalesce(c.c, d.doc_id) component_id
from documents d left join sets s using (doc_id) left join reps using (k) left join comp c on c.r = reps.r"""

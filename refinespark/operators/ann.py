"""Clustered, quantised search: IVF cells + per-dimension scalar codes.

The index is three small-to-large tables instead of an opaque file:

* ``centroids(cell, vec, n, radius)`` - coarse cells by L2, the vectors each holds and how far the farthest (as decoded
  from its code) lies from the centroid;
* ``bounds(lo, hi)`` - one row, the quantiser's range per dimension;
* ``lists(pids, codes, cell)`` - blocks of one cell each, sorted, written once ``partitionBy("cell")``.

A search reads probed cells only: their numbers are a partition filter of the list scan, and blocks of queries are sent
to the lists: broadcast up to a checked size, so that nothing is shuffled between the scan and the scoring; beyond it
both sides of a cell are dealt over a grid, so that neither the driver nor a task holds more than a bound.  By default probing is bounded: the nearest cells give each query a k-th score, and then
exactly those unread cells are read that can hold a better vector by the triangle inequality on centroid distance and
radius.  The result is that of reading every cell: the search is exact over the stored codes.  ``nprobe`` asks for a
fixed number of nearest cells instead.

Scores need no decoding.  A code is linear in its number, so a query's table of partial scores per dimension and code
(asymmetric distance) is a slope and an offset: ``q . x = q . lo + sum(q * step * code)``, and with the code's own
squared norm the same holds for L2.

Model parameters (nlist x d centroids, 2 x d bounds) are the only things that the driver collects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import hash32
from ..session import ensure_arrow_limits, materialise, shared_dir
from .exact import (DEFAULT_BROADCAST_BYTES, DEFAULT_CELL_BYTES, GRID_PARTITIONS, HIT_SCHEMA, METRICS, _final_rank, _ids, _matrix, _TopK,
                    grid_factors, grid_tasks, joined_bytes, score_steps)
from .sampling import DEFAULT_SEED

# Distances are rounded to this many places before the arg-min, so both
# engines pick the same cell on near-ties; ties go to the lower cell.
ASSIGN_DECIMALS = 9
DEFAULT_LIST_ROWS = 2048
DEFAULT_QUERY_GROUP_ROWS = 2048
# Partial rows of one key that one step of a tree merge sees.
MERGE_FAN_IN = 64
# Centroids compared at once with an Arrow batch of vectors (bounds the distance matrix of a task).
CENTROID_STEP = 4096
# Distances of queries to centroids, and rows of probes, that a task holds at a time.
PROBE_CELLS = 1 << 21
PROBE_ROWS = 1 << 15
# Cells that hold at least k vectors are read before any bound is known; this many at least.
FIRST_CELLS = 1
# Scores closer than this to a bound are read (rounding of the scores and of the bounds).
BOUND_SLACK = 2e-6


@dataclass
class IvfIndex:
    """Stored tables of an index, and the quantiser's bounds (``bits`` 0: the lists hold the vectors themselves)."""
    centroids: DataFrame
    lists: DataFrame
    lo: np.ndarray
    hi: np.ndarray
    bits: int
    nlist: int

    @property
    def codes(self) -> DataFrame:
        """(pid, cell, code) view of the inverted lists."""
        bits, kind = self.bits, "array<smallint>" if self.bits else "array<float>"

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cell, pids, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids = np.frombuffer(pids, np.int64)
                    mat = _codes(codes, len(ids), bits)
                    mat = mat.astype(np.int16) if bits else mat
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * mat.shape[1]), pa.array(mat.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), cell, np.int32)), flat], names=["pid", "cell", "code"])
        return self.lists.select("cell", "pids", "codes").mapInArrow(unpack, f"pid long, cell int, code {kind}")


def _codes(raw: bytes, n: int, bits: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if bits else np.float32).reshape(n, -1)


# ------------------------------------------------------------------ cells
def _centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(cells, nlist x d) in cell order: bounded model parameters, like MLlib's cluster centres."""
    rows = sorted(centroids.select("cell", "vec").collect())
    return np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.float64)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared L2 distances (n, nlist), rounded; the centroids in steps."""
    x2 = np.einsum("ij,ij->i", x, x)[:, None]
    parts = []
    for at in range(0, len(c), CENTROID_STEP):
        part = c[at:at + CENTROID_STEP]
        parts.append(x2 + np.einsum("ij,ij->i", part, part)[None, :] - 2.0 * (x @ part.T))
    return np.round(np.maximum(np.concatenate(parts, axis=1), 0.0), ASSIGN_DECIMALS)


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Places of the n nearest centroids of each vector, nearest first; ties to the lower place."""
    d = _distances(x, c)
    if n == 1:
        return d.argmin(axis=1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def with_nearest_cells(df: DataFrame, vec: str, centroids: DataFrame, n: int = 1, out: str = "cells") -> DataFrame:
    """Add ARRAY<INT> ``out``: the n nearest cells by L2 (distance rounded, then cell); null for a null vector.

    The centroid matrix (nlist x d, bounded by the index parameters) is broadcast once and every Arrow batch
    is compared with it by matrix products.
    """
    spark = df.sparkSession
    ensure_arrow_limits(spark)
    shared = spark.sparkContext.broadcast(_centroid_matrix(centroids))
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    idx = df.columns.index(vec)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = shared.value
        take = min(n, len(cells))
        for b in batches:
            some = b.column(idx).is_valid()
            x, _ = _matrix(b.column(idx).filter(some))
            picked = cells[_nearest(x.astype(np.float64), c, take)] if len(x) else np.zeros((0, take), np.int32)
            ends = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False) * take)]).astype(np.int32)
            null = np.append(~some.to_numpy(zero_copy_only=False), False)
            lst = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=null), pa.array(picked.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays(list(b.columns) + [lst], schema=pa.schema(list(b.schema) + [pa.field(out, pa.list_(pa.int32()))]))

    return df.mapInArrow(assign, schema)


def tree_merge(partial: DataFrame, keys: list[str], merge: Callable[[pa.Table], list[pa.Array]], name: str) -> DataFrame:
    """One row per ``keys`` out of the rows that tasks gave, tagged with their number in ``tag``.

    A step merges at most ``MERGE_FAN_IN`` rows of a key, so no row or group grows with the number of tasks.
    ``merge`` returns the one-row columns after ``keys`` and ``tag``.
    """
    partial = materialise(partial, name)
    schema = partial.schema
    tags = (partial.agg(F.max("tag")).first()[0] or 0) + 1

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        head = [pa.array([x.as_py()], table.schema.field(n).type) for x, n in zip(key, [*keys, "tag"], strict=True)]
        return pa.Table.from_arrays([*head, *merge(table)], names=[*keys, "tag", *[c for c in table.column_names if c not in keys and c != "tag"]])

    while True:
        order = [*keys, "tag", *[c for c in partial.columns if c not in keys and c != "tag"]]
        partial = partial.select(*order).withColumn("tag", F.floor(F.col("tag") / MERGE_FAN_IN).cast("int"))
        partial = partial.groupBy(*keys, "tag").applyInArrow(run, T.StructType([schema[c] for c in order]))
        tags = math.ceil(tags / MERGE_FAN_IN)
        if tags <= 1:
            return partial.drop("tag")


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def _lloyd_sums(shared) -> Callable:
    """Per task: vector sum and count of every cell seen (at most nlist rows out)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells, c = shared.value
        sums, counts = np.zeros(c.shape), np.zeros(len(c), np.int64)
        for b in batches:
            x, _ = _matrix(b.column(0))
            if len(x):
                x = x.astype(np.float64)
                place = _nearest(x, c, 1)[:, 0]
                np.add.at(sums, place, x)
                counts += np.bincount(place, minlength=len(c))
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[seen]), pa.array(np.full(len(seen), TaskContext.get().partitionId(), np.int32)), pa.array(counts[seen]), _lists(sums[seen])],
                names=["cell", "tag", "n", "s"])
    return run


def _add_sums(table: pa.Table) -> list[pa.Array]:
    return [pa.array([sum(table["n"].to_pylist())], pa.int64()), _lists(_stack(table["s"]).sum(axis=0)[None])]


def ivf_train(vectors: DataFrame, nlist: int = 16, iters: int = 2, seed: int = DEFAULT_SEED,
              method: str = "hash_sample", key: str = "pid", vec: str = "vec") -> DataFrame:
    """Coarse centroids (cell, vec ARRAY<DOUBLE>).

    ``hash_sample``: the ``nlist`` vectors first in seeded-hash order, then
    ``iters`` Lloyd steps (assign by L2, mean per cell; an empty cell keeps
    its centroid).  A step is one pass over the vectors that sums per task and cell, and a
    tree merge of these sums; the small centroid table is written each step, which cuts lineage.
    ``kmeans``: ``pyspark.ml`` k-means|| on the same vectors.
    Null vectors are left out.
    """
    spark = vectors.sparkSession
    ensure_arrow_limits(spark)
    v = vectors.select(F.col(key).alias("pid"), F.col(vec).cast("array<float>").alias("vec")).where(F.col("vec").isNotNull())
    if method == "kmeans":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        feats = v.select(array_to_vector("vec").alias("features"))
        model = KMeans(k=nlist, seed=seed, maxIter=max(iters, 1)).fit(feats)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        return spark.createDataFrame(rows, "cell int, vec array<double>")
    # the nlist vectors first in seeded-hash order: a top-n (per-partition top-n, then a merge of
    # nlist x partitions rows), never a sort of the whole table
    h = hash32(F.concat(F.lit(f"{seed}:"), F.col("pid").cast("string")))
    first = v.select("pid", "vec", h.alias("_h")).orderBy("_h", "pid").limit(nlist)
    w = Window.orderBy("_h", "pid")  # over nlist rows only
    cents = materialise(first.select((F.row_number().over(w) - 1).cast("int").alias("cell"),
                                     F.col("vec").cast("array<double>").alias("vec")), "centroids")
    for _ in range(iters):
        shared = spark.sparkContext.broadcast(_centroid_matrix(cents))
        partial = v.select("vec").mapInArrow(_lloyd_sums(shared), "cell int, tag int, n long, s array<double>")
        merged = tree_merge(partial, ["cell"], _add_sums, "cell-sums")
        means = merged.select("cell", F.transform("s", lambda x: x / F.col("n")).alias("mean"))
        cents = materialise(cents.join(means, "cell", "left").select("cell", F.coalesce("mean", "vec").alias("vec")), "centroids")
        shared.unpersist()
    return cents


# -------------------------------------------------------------- quantiser
def _partial_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: per-dimension min and max (one row out)."""
    from pyspark import TaskContext

    lo = hi = None
    for b in batches:
        if b.num_rows == 0:
            continue
        x, _ = _matrix(b.column(0))
        x = x.astype(np.float64)
        lo = x.min(axis=0) if lo is None else np.minimum(lo, x.min(axis=0))
        hi = x.max(axis=0) if hi is None else np.maximum(hi, x.max(axis=0))
    if lo is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), _lists(lo[None]), _lists(hi[None])],
                                         names=["tag", "lo", "hi"])


def _merge_bounds(table: pa.Table) -> list[pa.Array]:
    return [_lists(_stack(table["lo"]).min(axis=0)[None]), _lists(_stack(table["hi"]).max(axis=0)[None])]


def sq_bounds(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Per-dimension bounds of all vectors: one row (lo, hi ARRAY<DOUBLE>), written; no row without vectors."""
    ensure_arrow_limits(vectors.sparkSession)
    part = vectors.select(F.col(vec).cast("array<float>")).where(F.col(vec).isNotNull()) \
                  .mapInArrow(_partial_bounds, "tag int, lo array<double>, hi array<double>")
    return materialise(tree_merge(part, [], _merge_bounds, "partial-bounds"), "bounds")


def sq_train(vectors: DataFrame, vec: str = "vec") -> tuple[Column, Column]:
    """The bounds (lo, hi) as two ARRAY<DOUBLE> scalar subqueries over the written row."""
    bounds = sq_bounds(vectors, vec)
    return bounds.select("lo").scalar(), bounds.select("hi").scalar()


def sq_encode(df: DataFrame, vec: str, lo: Column, hi: Column, bits: int = 8, out: str = "code") -> DataFrame:
    """code = clamp(floor((x - lo) / (hi - lo) * L + 0.5), 0, L), L = 2^bits - 1; hi = lo -> 0."""
    levels = float((1 << bits) - 1)
    b = df.withColumn("_lo", lo).withColumn("_hi", hi)

    def code(x, i):
        lo_i, hi_i = F.element_at("_lo", i + 1), F.element_at("_hi", i + 1)
        raw = F.floor((x.cast("double") - lo_i) / (hi_i - lo_i) * F.lit(levels) + F.lit(0.5))
        return F.when(hi_i == lo_i, F.lit(0)).otherwise(
            F.least(F.lit(levels), F.greatest(F.lit(0.0), raw))).cast("smallint")

    return b.withColumn(out, F.transform(vec, code)).drop("_lo", "_hi")


def _encode(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    """As ``sq_encode``, for a matrix of doubles."""
    levels, width = float((1 << bits) - 1), hi - lo
    raw = np.floor((x - lo) / np.where(width == 0, 1.0, width) * levels + 0.5)
    return np.where(width == 0, 0.0, np.clip(raw, 0.0, levels)).astype(np.uint8)


def _step(lo: np.ndarray, hi: np.ndarray, bits: int) -> np.ndarray:
    return (hi - lo) / float((1 << bits) - 1)


def sq_decode(df: DataFrame, code: str, lo: Column, hi: Column, bits: int = 8, out: str = "dvec") -> DataFrame:
    levels = float((1 << bits) - 1)
    b = df.withColumn("_lo", lo).withColumn("_hi", hi)
    dec = F.transform(code, lambda x, i: F.element_at("_lo", i + 1) + x.cast("double")
                      * (F.element_at("_hi", i + 1) - F.element_at("_lo", i + 1)) / F.lit(levels))
    return b.withColumn(out, dec).drop("_lo", "_hi")


# ------------------------------------------------------------------ index
def ivf_add(vectors: DataFrame, centroids: DataFrame, lo: np.ndarray, hi: np.ndarray, bits: int = 8,
            key: str = "pid", vec: str = "vec") -> DataFrame:
    """(pid, cell, code BINARY, away) - nearest cell by L2, the code, and how far what it decodes to is from the centroid.

    One pass: assigning, coding and the distance happen in one task function.  Null vectors are left out.
    """
    if bits not in range(0, 9):
        raise ValueError("bits must be 0 (vectors as they are) or 1 to 8")
    spark = vectors.sparkSession
    ensure_arrow_limits(spark)
    shared = spark.sparkContext.broadcast(_centroid_matrix(centroids))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c = shared.value
        for b in batches:
            x32, d = _matrix(b.column(1))
            if not len(x32):
                continue
            x = x32.astype(np.float64)
            place = _nearest(x, c, 1)[:, 0]
            code = _encode(x, lo, hi, bits) if bits else x32
            back = lo + code * _step(lo, hi, bits) if bits else x
            raw = np.ascontiguousarray(code).view(np.uint8).reshape(len(x), -1)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * raw.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(raw.ravel())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells[place]), packed, pa.array(np.sqrt(((back - c[place]) ** 2).sum(axis=1)))],
                                             names=["pid", "cell", "code", "away"])

    v = vectors.select(F.col(key).cast("long").alias("pid"), F.col(vec).cast("array<float>").alias("vec")).where(F.col("vec").isNotNull())
    return v.mapInArrow(add, "pid long, cell int, code binary, away double")


def inverted_lists(added: DataFrame, block_rows: int = DEFAULT_LIST_ROWS) -> DataFrame:
    """Rows of ``ivf_add`` as blocks (cell, n, radius, pids BINARY, codes BINARY) of at most ``block_rows``.

    Dealt by ranges of (cell, pid): a cell that holds a large share of all vectors is spread over many tasks.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(cell: int, held: list[tuple]) -> pa.RecordBatch:
            pids, codes, away = (np.concatenate([h[k] for h in held]) for k in range(3))
            return pa.RecordBatch.from_arrays(
                [pa.array([cell], pa.int32()), pa.array([len(pids)], pa.int64()), pa.array([float(away.max())]),
                 pa.array([pids.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=["cell", "n", "radius", "pids", "codes"])

        cell, held, size = -1, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            pids, cells, away = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            codes = np.array([np.frombuffer(x, np.uint8) for x in b.column(2).to_pylist()]).reshape(len(pids), -1)
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                at = lo
                while at < hi:
                    if held and (cells[at] != cell or size >= block_rows):
                        yield block(cell, held)
                        held, size = [], 0
                    cell, stop = int(cells[at]), min(hi, at + block_rows - size)
                    held.append((pids[at:stop].astype(np.int64), codes[at:stop], away[at:stop]))
                    size, at = size + stop - at, stop
        if held:
            yield block(cell, held)

    n = int(added.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (added.select("pid", "cell", "code", "away").repartitionByRange(n, "cell", "pid").sortWithinPartitions("cell", "pid")
                 .mapInArrow(pack, "cell int, n long, radius double, pids binary, codes binary"))


def build_index(vectors: DataFrame, nlist: int = 16, bits: int = 8, iters: int = 2,
                seed: int = DEFAULT_SEED, method: str = "hash_sample",
                list_rows: int = DEFAULT_LIST_ROWS, path: str | None = None) -> IvfIndex:
    """Train cells, fit the quantiser, add every vector; ``bits=0`` keeps flat (unquantised) lists.

    The tables are written once to ``path`` (default: a new folder of the shared one), the lists clustered by cell;
    the centroids come last, so an index without them is not complete.
    """
    spark = vectors.sparkSession
    if path is None:
        import uuid
        path = shared_dir(spark, "tables", f"ivf-{uuid.uuid4().hex}")
    cents = ivf_train(vectors, nlist, iters, seed, method)
    bounds = sq_bounds(vectors)
    row = bounds.first()
    lo, hi = (np.array(x, np.float64) for x in row) if row else (np.zeros(0), np.zeros(0))
    added = materialise(ivf_add(vectors, cents, lo, hi, bits), "added")  # read for the ranges and for the lists
    inverted_lists(added, list_rows).write.partitionBy("cell").parquet(f"{path}/lists")
    bounds.write.parquet(f"{path}/bounds")
    sizes = spark.read.schema(LIST_SCHEMA).parquet(f"{path}/lists").groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    (cents.join(sizes, "cell", "left").select("cell", "vec", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"))
          .write.parquet(f"{path}/centroids"))
    return open_index(spark, path, bits, nlist)


LIST_SCHEMA = "n long, radius double, pids binary, codes binary, cell int"


def open_index(spark, path: str, bits: int, nlist: int) -> IvfIndex:
    """The index stored at ``path``."""
    row = spark.read.schema("lo array<double>, hi array<double>").parquet(f"{path}/bounds").first()
    lo, hi = (np.array(x, np.float64) for x in row) if row else (np.zeros(0), np.zeros(0))
    cents = spark.read.schema("cell int, vec array<double>, n long, radius double").parquet(f"{path}/centroids")
    return IvfIndex(cents, spark.read.schema(LIST_SCHEMA).parquet(f"{path}/lists"), lo, hi, bits, nlist)


# ----------------------------------------------------------------- search
def _steps(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``PROBE_CELLS`` pairs of a row and a cell."""
    step = max(1, PROBE_CELLS // cells)
    return (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step))


def _first_cells(q: DataFrame, model, k: int, nprobe: int | None) -> DataFrame:
    """(qid, qvec, seen): the nearest cells of each query: ``nprobe`` of them, or as many as hold k vectors (``FIRST_CELLS`` at least)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c, n, _ = model.value
        for b in _steps(batches, len(c)):
            x, _ = _matrix(b.column(1))
            order = _nearest(x.astype(np.float64), c, len(c))
            if nprobe is None:
                held = np.cumsum(n[order], axis=1)
                many = np.minimum(np.maximum(FIRST_CELLS, 1 + (held < k).sum(axis=1)), len(c))
            else:
                many = np.full(len(x), min(nprobe, len(c)))
            use = np.arange(len(c))[None, :] < many[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _cell_lists(cells[order[use]], many)], names=["qid", "qvec", "seen"])
    return q.select("qid", "qvec").mapInArrow(run, "qid long, qvec array<float>, seen array<int>")


def _cell_lists(cells: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(cells.astype(np.int32)))


def _open_cells(q: DataFrame, model, metric: str) -> DataFrame:
    """(qid, qvec, open): cells not yet read (``seen``) that can hold a vector as good as the query's k-th (``kth``; null: fewer
    than k found)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, c, n, radius = model.value
        for b in _steps(batches, len(c)):
            x, _ = _matrix(b.column(1))
            x = x.astype(np.float64)
            kth = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
            if metric == "ip":
                best = x @ c.T + np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * radius[None, :]
                reach = ~(best < kth[:, None] - BOUND_SLACK)
            else:
                best = np.maximum(np.sqrt(_distances(x, c)) - radius[None, :], 0.0) ** 2
                reach = ~(best > kth[:, None] + BOUND_SLACK)
            reach &= n[None, :] > 0
            seen = b.column(2)
            rows = np.repeat(np.arange(len(x)), seen.value_lengths().to_numpy(zero_copy_only=False))
            reach[rows, np.searchsorted(cells, seen.flatten().to_numpy(zero_copy_only=False))] = False
            place = np.nonzero(reach)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _cell_lists(cells[place], reach.sum(axis=1))], names=["qid", "qvec", "open"])
    return q.select("qid", "qvec", "seen", "kth").mapInArrow(run, "qid long, qvec array<float>, open array<int>")


def _query_blocks(probes: DataFrame, rows: int) -> DataFrame:
    """(cell, qids BINARY, qmat BINARY): the probes (qid, qvec, cell) in blocks of one cell and at most ``rows`` queries, packed
    inside their partitions, ``PROBE_ROWS`` probes at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            cells, qids, mat = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.argsort(cells, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cells[order])) + 1, [len(order)]])
            own = [order[at:min(at + rows, hi)] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for at in range(lo, hi, rows)]
            yield pa.RecordBatch.from_arrays([pa.array([cells[o[0]] for o in own], pa.int32()), pa.array([qids[o].tobytes() for o in own], pa.binary()),
                                              pa.array([mat[o].tobytes() for o in own], pa.binary())], names=["cell", "qids", "qmat"])
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), _ids(b.column(1)), _matrix(b.column(2))[0]))
                size += b.num_rows
            if size >= PROBE_ROWS:
                yield from packed(held)
                held, size = [], 0
        if held:
            yield from packed(held)
    return probes.select("cell", "qid", "qvec").mapInArrow(run, "cell int, qids binary, qmat binary")


class _Scorer:
    """Scores of one query group against code blocks: a slope per dimension and an offset per query, no decoding."""

    def __init__(self, qmat: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int, metric: str):
        self.l2, self.bits = metric == "l2", bits
        self.step = _step(lo, hi, bits) if bits else np.ones(qmat.shape[1])
        base = lo if bits else np.zeros(qmat.shape[1])
        if self.l2:
            rest = qmat - base
            self.slope, self.offset = -2.0 * rest * self.step, np.einsum("ij,ij->i", rest, rest)
        else:
            self.slope, self.offset = qmat * self.step, qmat @ base

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        codes = codes.astype(np.float64)
        scores = self.slope @ codes.T + self.offset[:, None]
        if self.l2:
            own = codes * self.step
            scores = np.maximum(scores + np.einsum("ij,ij->i", own, own)[None, :], 0.0)
        return scores


def _add_scores(top: _TopK, scorer: _Scorer, pids: np.ndarray, codes: np.ndarray) -> None:
    for part in score_steps(len(scorer.offset), len(pids)):
        top.add(scorer(codes[part]), pids[part])


def _score_fn(k: int, metric: str, index_bits: int, lo: np.ndarray, hi: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[bytes, tuple] = {}
        for b in batches:
            for qids, qmat, pids, codes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if qids not in groups:
                    ids = np.frombuffer(qids, np.int64)
                    mat = np.frombuffer(qmat, np.float32).reshape(len(ids), -1).astype(np.float64)
                    groups[qids] = (ids, _TopK(k, metric), _Scorer(mat, lo, hi, index_bits, metric))
                _, top, scorer = groups[qids]
                own = np.frombuffer(pids, np.int64)
                _add_scores(top, scorer, own, _codes(codes, len(own), index_bits))
        for ids, top, _ in groups.values():
            if len(top.r):
                yield pa.RecordBatch.from_arrays([pa.array(ids[top.r]), pa.array(top.pid), pa.array(top.score)], names=["qid", "pid", "score"])
    return score


def _cell_fn(k: int, metric: str, bits: int, lo: np.ndarray, hi: np.ndarray, group_rows: int):
    """Hits of the query blocks and list blocks of one grid cell."""
    def run(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and blocks.num_rows:
            qids = joined_bytes(queries["qids"], np.int64)
            qmat = joined_bytes(queries["qmat"], np.float32).reshape(len(qids), -1)
            for at in range(0, len(qids), group_rows):
                ids, top = qids[at:at + group_rows], _TopK(k, metric)
                scorer = _Scorer(qmat[at:at + group_rows].astype(np.float64), lo, hi, bits, metric)
                for pids, codes in zip(blocks["pids"], blocks["codes"], strict=True):
                    own = np.frombuffer(pids.as_buffer(), np.int64)
                    _add_scores(top, scorer, own, _codes(codes.as_buffer(), len(own), bits))
                if len(top.r):
                    found.append(pa.RecordBatch.from_arrays([pa.array(ids[top.r]), pa.array(top.pid), pa.array(top.score)], names=["qid", "pid", "score"]))
        return pa.Table.from_batches(found, schema=pa.schema([("qid", pa.int64()), ("pid", pa.int64()), ("score", pa.float64())]))
    return run


def _scan(probes: DataFrame, index: IvfIndex, held: dict[int, int], k: int, metric: str, group_rows: int, broadcast_bytes: int,
          cell_bytes: int) -> DataFrame | None:
    """Hits (qid, pid, score) of the probes (qid, qvec, cell); None without any.  Reads the lists of probed cells only.

    ``held``: vectors a cell.  Blocks of queries over ``broadcast_bytes`` in all are dealt with the lists over a grid of query rows and list
    columns a cell, either side of which is about ``cell_bytes``.
    """
    spark = probes.sparkSession
    blocks = materialise(_query_blocks(probes, group_rows), "query-blocks")
    sizes = blocks.groupBy("cell").agg(F.sum((F.octet_length("qids") + F.octet_length("qmat")).cast("long"))).collect()  # nlist rows at most
    if not sizes:
        return None
    lists = index.lists.where(F.col("cell").isin(sorted(r[0] for r in sizes))).select("cell", "pids", "codes")
    if sum(r[1] for r in sizes) <= broadcast_bytes:
        joined = lists.join(F.broadcast(blocks), "cell").select("qids", "qmat", "pids", "codes")
        return joined.mapInArrow(_score_fn(k, metric, index.bits, index.lo, index.hi), HIT_SCHEMA)
    width = 8 + len(index.lo) * (1 if index.bits else 4)
    work = [(cell, b, held[cell] * width) for cell, b in sizes]
    total = max(1, sum(b * p for _, b, p in work))
    grid = []  # list blocks are the smaller side: cells for more tasks come from query rows
    for cell, b, p in work:
        columns, rows = grid_factors(p, b, cell_bytes, math.ceil(grid_tasks(spark) * b * p / total))
        grid.append((cell, rows, columns))
    parts = min(sum(rows * columns for _, rows, columns in grid), GRID_PARTITIONS)
    plan = F.broadcast(spark.createDataFrame(grid, "cell int, _rows int, _columns int"))  # nlist rows at most
    qs = (blocks.join(plan, "cell").withColumn("gr", F.pmod(F.xxhash64("qids"), F.col("_rows")).cast("int"))
                .withColumn("gc", F.explode(F.sequence(F.lit(0), F.col("_columns") - 1))).select("cell", "gr", "gc", "qids", "qmat"))
    ps = (lists.join(plan, "cell").withColumn("gc", F.pmod(F.xxhash64("pids"), F.col("_columns")).cast("int"))
               .withColumn("gr", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1))).select("cell", "gr", "gc", "pids", "codes"))
    keys = ["cell", "gr", "gc"]
    qs, ps = (x.repartition(parts, *keys).groupBy(*keys) for x in (qs, ps))
    return qs.cogroup(ps).applyInArrow(_cell_fn(k, metric, index.bits, index.lo, index.hi, group_rows), HIT_SCHEMA)


def ann_search_bulk(query_vecs: DataFrame, index: IvfIndex, k: int = 1, nprobe: int | None = None,
                    qkey: str = "qid", vec: str = "vec", metric: str = "ip",
                    query_group_rows: int = DEFAULT_QUERY_GROUP_ROWS,
                    broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, cell_bytes: int = DEFAULT_CELL_BYTES) -> DataFrame:
    """(qid, rk INT, pid, score) over the stored codes; see the module's description.

    ``nprobe``: a fixed number of nearest cells (the answer is approximate); None: bounded probing, the same answer as
    reading every cell.  Queries with a null vector have no hits; ids of queries are unique.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1 or (nprobe is not None and nprobe < 1):
        raise ValueError("k and nprobe must be at least 1")
    spark = query_vecs.sparkSession
    ensure_arrow_limits(spark)
    q = query_vecs.select(F.col(qkey).cast("long").alias("qid"), F.col(vec).cast("array<float>").alias("qvec")).where(F.col("qvec").isNotNull())
    rows = sorted(index.centroids.select("cell", "n", "radius", "vec").collect())  # model parameters
    none = spark.createDataFrame([], "qid long, rk int, pid long, score double")
    if not rows:
        return none
    model = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int32), np.array([r[3] for r in rows], np.float64),
                                          np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.float64)))
    held = {r[0]: r[1] for r in rows}
    q = materialise(_first_cells(q, model, k, nprobe), "queries")
    hits = _scan(q.select("qid", "qvec", F.explode("seen").alias("cell")), index, held, k, metric, query_group_rows, broadcast_bytes, cell_bytes)
    if nprobe is not None or hits is None:
        return none if hits is None else _final_rank(hits, k, metric)
    first = materialise(_final_rank(hits, k, metric), "first-hits")
    kth = first.where(F.col("rk") == k).select("qid", F.col("score").alias("kth"))
    reach = _open_cells(q.join(kth, "qid", "left"), model, metric).select("qid", "qvec", F.explode("open").alias("cell"))
    more = _scan(reach, index, held, k, metric, query_group_rows, broadcast_bytes, cell_bytes)
    return first if more is None else _final_rank(first.drop("rk").union(more), k, metric)


def ann_search(query_vec: DataFrame, index: IvfIndex, k: int = 1, nprobe: int | None = None, vec: str = "vec", metric: str = "ip") -> DataFrame:
    """One query (one-row frame with ``vec``) -> (rk, pid, score)."""
    q = query_vec.select(F.lit(0).cast("long").alias("qid"), F.col(vec).alias("vec"))
    return ann_search_bulk(q, index, k, nprobe, metric=metric).drop("qid")

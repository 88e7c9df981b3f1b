"""Exact top-k search by block-wise scoring.

Plan (queries Q x d, passages N x d, N >> Q):

1. Passages are packed into blocks of ``block_rows`` vectors *inside their
   own partitions* (``mapInArrow``; no shuffle, the scan is the only pass).
2. Queries are hashed into ``G`` groups of about ``query_group_rows`` each
   and packed per group with ``collect_list`` (JVM side).
3. When the query side is under ``broadcast_bytes`` (checked from its row count and
   width before planning) the groups are broadcast, each passage block meets each group through an equi-join on the
   group id ``g``, and passages never move.  Above it blocks of both sides are dealt over a grid of query rows x passage
   columns (``grid_factors``): a cell holds about ``cell_bytes`` of either side, so a passage is copied once per
   query row - query bytes / cell bytes - and not once per group, and a query once per column.  Either bound is one of
   what a task's Python and the driver hold, whatever the tables' sizes.
4. A task scores every (block, group) pair with matrix
   products of at most ``SCORE_CELLS`` scores, keeps a running top-k per query for the whole task (ties at the
   cut kept in full, order = score desc / distance asc, then pid asc) and
   emits at most k rows per query per task.  A block whose norms can't reach any query's k-th score (Cauchy-Schwarz for inner
   products, difference of norms for L2) is skipped.
5. ``row_number() <= k`` per query merges the task results; Catalyst plans it
   as a partial ``WindowGroupLimit`` before the shuffle and a final one after.

Scores are accumulated in double from float vectors and rounded to 6
decimals before any ranking, so near-ties order the same on every engine.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SCORE_DECIMALS, dot, l2sq
from ..session import ensure_arrow_limits, materialise

METRICS = ("ip", "l2")
DEFAULT_BLOCK_ROWS = 2048
DEFAULT_QUERY_GROUP_ROWS = 2048
DEFAULT_BROADCAST_BYTES = 16 << 20
DEFAULT_CELL_BYTES = 16 << 20     # of one side of a grid cell
# Scores (8 bytes each) of one matrix product.
SCORE_CELLS = 1 << 21
# Grid cells a core at least, and partitions that they are dealt to at most.
GRID_TASKS, GRID_PARTITIONS = 4, 10_000

HIT_SCHEMA = "qid long, pid long, score double"
_BLOCK_SCHEMA = pa.schema([("blk", pa.int64()), ("ids", pa.list_(pa.int64())),
                           ("mat", pa.binary()), ("d", pa.int32())])


def _matrix(lst: pa.Array) -> tuple[np.ndarray, int]:
    """list<float> Arrow array -> (n, d) float32 matrix, checking one width."""
    n = len(lst)
    if n == 0:
        return np.zeros((0, 0), np.float32), 0
    lens = pc.list_value_length(lst).to_numpy(zero_copy_only=False)
    d = int(lens[0])
    if not (lens == d).all():
        raise ValueError("vectors of different widths in one search")
    flat = lst.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(n, d), d


def _ids(column: pa.Array) -> np.ndarray:
    """Keys as int64; a null key is the smallest number."""
    return pc.fill_null(column.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def pack_blocks(df: DataFrame, key: str, vec: str, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(key, vec) rows -> (blk, ids, mat, d) blocks, packed within each partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_buf: list[np.ndarray] = []
        mat_buf: list[np.ndarray] = []
        held = 0

        def flush():
            ids = np.concatenate(ids_buf)
            mat = np.ascontiguousarray(np.concatenate(mat_buf), dtype=np.float32)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(ids[0])], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([mat.tobytes()], pa.binary()), pa.array([mat.shape[1]], pa.int32())],
                schema=_BLOCK_SCHEMA)

        for b in batches:
            if b.num_rows == 0:
                continue
            ids = _ids(b.column(0))
            mat, _ = _matrix(b.column(1))
            start = 0
            while start < len(ids):
                take = min(block_rows - held, len(ids) - start)
                ids_buf.append(ids[start:start + take])
                mat_buf.append(mat[start:start + take])
                held += take
                start += take
                if held == block_rows:
                    yield flush()
                    ids_buf, mat_buf, held = [], [], 0
        if held:
            yield flush()

    src = df.select(F.col(key).cast("long"), F.col(vec).cast("array<float>")).where(F.col(vec).isNotNull())
    return src.mapInArrow(pack, "blk long, ids array<long>, mat binary, d int")


class _TopK:
    """Running top-k per query row of one query group, merged block by block.

    Once a row holds k hits, its k-th best gain is a threshold: a new block
    only contributes entries at or above it (one vectorised compare), so the
    costly partial sort runs only while some row has fewer than k hits.
    Entries equal to a threshold are kept, so ties at the cut are resolved
    by pid like everywhere else.
    """

    def __init__(self, k: int, metric: str):
        self.k = k
        self.sign = 1.0 if metric == "ip" else -1.0
        self.r = np.zeros(0, np.int64)
        self.pid = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.float64)
        self.thr: np.ndarray | None = None

    def add(self, scores: np.ndarray, pids: np.ndarray) -> None:
        nq, n_p = scores.shape
        if n_p == 0 or nq == 0:
            return
        if self.thr is None:
            self.thr = np.full(nq, -np.inf)
        # ``scores`` are raw; ranking is on values rounded to SCORE_DECIMALS.  Rounding moves a
        # value by at most half a unit, so every entry that can reach a rounded threshold is
        # within one unit of it: select on raw values with that slack, round only the selection.
        slack = 10.0 ** -SCORE_DECIMALS
        gain = scores * self.sign if self.sign < 0 else scores
        thr = self.thr
        open_rows = np.isinf(thr)
        if open_rows.any():
            kk = min(self.k, n_p)
            if n_p > kk:
                block_thr = np.partition(gain[open_rows], n_p - kk, axis=1)[:, n_p - kk]
            else:
                block_thr = np.full(int(open_rows.sum()), -np.inf)
            thr = thr.copy()
            thr[open_rows] = block_thr
        r, c = np.nonzero(gain >= (thr - slack)[:, None])
        if not len(r):
            return
        self.r = np.concatenate([self.r, r.astype(np.int64)])
        self.pid = np.concatenate([self.pid, pids[c]])
        self.score = np.concatenate([self.score, np.round(scores[r, c], SCORE_DECIMALS)])
        self._cut(nq)

    def _cut(self, nq: int) -> None:
        order = np.lexsort((self.pid, -self.score * self.sign, self.r))
        r, pid, score = self.r[order], self.pid[order], self.score[order]
        starts = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
        rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
        keep = rank < self.k
        self.r, self.pid, self.score = r[keep], pid[keep], score[keep]
        full = rank == self.k - 1
        self.thr = np.full(nq, -np.inf)
        self.thr[r[full]] = score[full] * self.sign


    def out_of_reach(self, q_norms: np.ndarray, p_norms: np.ndarray, metric: str) -> bool:
        """Whether no vector of a block with these norms can be among the k best of any query so far."""
        if self.thr is None or np.isinf(self.thr).any() or not len(p_norms):
            return False
        lo, hi = float(p_norms.min()), float(p_norms.max())
        if metric == "ip":
            best = q_norms * hi
        else:
            best = -np.maximum(np.maximum(q_norms - hi, lo - q_norms), 0.0) ** 2
        return bool((best < self.thr - 2 * 10.0 ** -SCORE_DECIMALS).all())


def score_steps(n_queries: int, n_passages: int) -> Iterator[slice]:
    """The passages in slices that give at most ``SCORE_CELLS`` scores against all queries."""
    step = max(1, SCORE_CELLS // max(1, n_queries))
    return (slice(at, at + step) for at in range(0, n_passages, step))


class _Group:
    """Queries of one group: their running top-k and norms."""

    def __init__(self, qids: np.ndarray, qmat: np.ndarray, k: int, metric: str):
        self.qids, self.q, self.metric, self.top = qids, qmat.astype(np.float64), metric, _TopK(k, metric)
        self.q2 = np.einsum("ij,ij->i", self.q, self.q)

    def score(self, pids: np.ndarray, pmat: np.ndarray) -> None:
        if pmat.shape[1] != self.q.shape[1]:
            raise ValueError(f"query width {self.q.shape[1]} != passage width {pmat.shape[1]}")
        p = pmat.astype(np.float64)
        p2 = np.einsum("ij,ij->i", p, p)
        if self.top.out_of_reach(np.sqrt(self.q2), np.sqrt(p2), self.metric):
            return
        for part in score_steps(len(self.q), len(p)):
            s = self.q @ p[part].T
            if self.metric == "l2":
                s = np.maximum(self.q2[:, None] + p2[None, part] - 2.0 * s, 0.0)
            self.top.add(s, pids[part])

    def hits(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.qids[self.top.r]), pa.array(self.top.pid), pa.array(self.top.score)],
                                          names=["qid", "pid", "score"])


def grid_factors(q_bytes: int, p_bytes: int, cell_bytes: int = DEFAULT_CELL_BYTES, tasks: int = 1) -> tuple[int, int]:
    """(query rows, passage columns) of the grid: each side of a cell under ``cell_bytes``, ``tasks`` cells at least.

    Query rows are what a passage is copied by, so extra cells for more tasks come from columns first.
    """
    rows = max(1, math.ceil(q_bytes / cell_bytes))
    columns = max(1, math.ceil(p_bytes / cell_bytes))
    return rows, max(columns, math.ceil(tasks / rows))


def grid_tasks(spark) -> int:
    return GRID_TASKS * spark.sparkContext.defaultParallelism


def joined_bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all BINARY values of a column, one after the other."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def _cell_fn(k: int, metric: str, group_rows: int):
    def run(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and blocks.num_rows:
            qids = np.concatenate([_ids(x.values) for x in queries["ids"]])
            qmat = joined_bytes(queries["mat"], np.float32).reshape(len(qids), -1)
            for at in range(0, len(qids), group_rows):
                group = _Group(qids[at:at + group_rows], qmat[at:at + group_rows], k, metric)
                for i, m, d in zip(blocks["ids"], blocks["mat"], blocks["d"], strict=True):
                    group.score(_ids(i.values), np.frombuffer(m.as_buffer(), np.float32).reshape(-1, d.as_py()))
                if len(group.top.r):
                    found.append(group.hits())
        schema = pa.schema([("qid", pa.int64()), ("pid", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(found, schema=schema)
    return run


def _score_fn(k: int, metric: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, _Group] = {}
        for b in batches:
            cols = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                g = cols["g"][i].as_py()
                d = cols["d"][i].as_py()
                pids = np.asarray(cols["ids"][i].values.to_numpy(zero_copy_only=False), np.int64)
                pmat = np.frombuffer(cols["mat"][i].as_py(), np.float32).reshape(len(pids), d)
                if g not in groups:
                    qrows = cols["q"][i].values  # struct<qid, vec>
                    qids = _ids(qrows.field("qid"))
                    groups[g] = _Group(qids, _matrix(qrows.field("vec"))[0], k, metric)
                groups[g].score(pids, pmat)
        for group in groups.values():
            if len(group.top.r):
                yield group.hits()
    return score


def _final_rank(hits: DataFrame, k: int, metric: str) -> DataFrame:
    order = F.col("score").desc() if metric == "ip" else F.col("score").asc()
    w = Window.partitionBy("qid").orderBy(order, F.col("pid").asc())
    return (hits.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
                .select("qid", F.col("rk").cast("int"), "pid", "score"))


def topk_exact_bulk(queries: DataFrame, passages: DataFrame, k: int = 1, metric: str = "ip",
                    qkey: str = "qid", pkey: str = "pid", vec: str = "vec",
                    block_rows: int = DEFAULT_BLOCK_ROWS,
                    query_group_rows: int = DEFAULT_QUERY_GROUP_ROWS,
                    broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, dim: int | None = None,
                    cell_bytes: int = DEFAULT_CELL_BYTES) -> DataFrame:
    """R3 (and R2, R9): top-k passages for every query -> (qid, rk INT, pid, score).

    k larger than the corpus gives the whole corpus (a short list, no padding).
    ``dim`` (the vector width, when the caller knows it from the encoder)
    saves one small job.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    ensure_arrow_limits(spark)
    q = queries.select(F.col(qkey).cast("long").alias("qid"), F.col(vec).cast("array<float>").alias("vec")) \
               .where(F.col("vec").isNotNull())
    # the query side is read three times (size check, width, search): write it once
    q = materialise(q)
    n_q = q.count()
    if n_q and dim is None:
        first = q.select(F.size("vec")).limit(1).collect()
        n_q = n_q if first else 0
        width = first[0][0] if first else 0
    else:
        width = dim or 0
    if n_q == 0:
        return spark.createDataFrame([], "qid long, rk int, pid long, score double")
    groups = max(1, math.ceil(n_q / query_group_rows))
    q_bytes = n_q * max(width, 1) * 4
    pb = pack_blocks(passages.select(F.col(pkey).alias("pid"), F.col(vec).alias("vec")), "pid", "vec",
                     block_rows)
    if q_bytes <= broadcast_bytes:
        qg = (q.withColumn("g", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int"))
               .groupBy("g").agg(F.collect_list(F.struct("qid", "vec")).alias("q")))
        pb = pb.select("ids", "mat", "d", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        joined = pb.join(F.broadcast(qg), "g")
        hits = joined.select("g", "ids", "mat", "d", "q").mapInArrow(_score_fn(k, metric), HIT_SCHEMA)
    else:
        pb = materialise(pb, "blocks")  # packed once, read for its size and for the grid
        p_bytes = pb.agg(F.sum(F.octet_length("mat").cast("long"))).first()[0] or 0
        rows, columns = grid_factors(q_bytes, p_bytes, cell_bytes, grid_tasks(spark))
        qs = (pack_blocks(q, "qid", "vec", query_group_rows).withColumn("gr", F.pmod(F.xxhash64("blk"), F.lit(rows)).cast("int"))
              .withColumn("gc", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))))
        ps = (pb.withColumn("gc", F.pmod(F.xxhash64("blk", F.lit(7)), F.lit(columns)).cast("int"))
                .withColumn("gr", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))))
        parts = min(rows * columns, GRID_PARTITIONS)
        qs, ps = (x.select("gr", "gc", "ids", "mat", "d").repartition(parts, "gr", "gc") for x in (qs, ps))
        hits = qs.groupBy("gr", "gc").cogroup(ps.groupBy("gr", "gc")).applyInArrow(_cell_fn(k, metric, query_group_rows), HIT_SCHEMA)
    return _final_rank(hits, k, metric)


def topk_exact(query_vec: DataFrame, passages: DataFrame, k: int = 10, metric: str = "ip", **kw) -> DataFrame:
    """R2: one query (a one-row frame with ``vec``), default k = 10."""
    q = query_vec.select(F.lit(0).cast("long").alias("qid"), F.col(kw.pop("vec", "vec")).alias("vec"))
    return topk_exact_bulk(q, passages, k=k, metric=metric, **kw).drop("qid")


def score_pairs(pairs: DataFrame, left: str, right: str, metric: str = "ip", out: str = "score") -> DataFrame:
    """R1 on given pairs: inner product (or squared L2) of two vector columns per row."""
    expr = dot(left, right) if metric == "ip" else l2sq(left, right)
    return pairs.withColumn(out, F.round(expr, SCORE_DECIMALS))

"""Block top-k: equal to brute force for any partitioning, edge cases, zero-vector guard."""

import numpy as np
import pytest

from refinespark.operators.encode import guard_zero_vector
from refinespark.operators.exact import topk_exact_bulk


def brute(q, p, k, metric="ip"):
    out = []
    for qi, qv in q:
        s = []
        for pi, pv in p:
            a, b = np.asarray(qv, np.float32).astype(np.float64), np.asarray(pv, np.float32).astype(np.float64)
            s.append((round(float(a @ b if metric == "ip" else ((a - b) ** 2).sum()), 6), pi))
        s.sort(key=lambda x: ((-x[0] if metric == "ip" else x[0]), x[1]))
        out += [(qi, r + 1, pi, sc) for r, (sc, pi) in enumerate(s[:k])]
    return sorted(out)


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, vec array<float>")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    p = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)]
    p += [(100, p[3][1]), (101, p[3][1])]  # exact ties
    q = [(i, rng.normal(size=8).round(3).tolist()) for i in range(9)] + [(50, p[3][1])]
    return q, p


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_block_equals_brute_force(spark, data, parts, metric):
    q, p = data
    got = topk_exact_bulk(frame(spark, q, "qid"), frame(spark, p, "pid").repartition(parts), k=5,
                          metric=metric, block_rows=7, query_group_rows=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(q, p, 5, metric)


def test_shuffle_path_equals_broadcast_path(spark, data):
    q, p = data
    a = topk_exact_bulk(frame(spark, q, "qid"), frame(spark, p, "pid"), k=3, query_group_rows=3)
    b = topk_exact_bulk(frame(spark, q, "qid"), frame(spark, p, "pid"), k=3, query_group_rows=3,
                        broadcast_bytes=0)
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("metric", ["ip", "l2"])
@pytest.mark.parametrize("cell_bytes", [64, 200, 1 << 20])
def test_grid_equals_brute_force(spark, data, metric, cell_bytes):
    q, p = data
    got = topk_exact_bulk(frame(spark, q, "qid"), frame(spark, p, "pid").repartition(5), k=5, metric=metric, block_rows=6, query_group_rows=4,
                          broadcast_bytes=0, cell_bytes=cell_bytes)
    assert sorted(tuple(r) for r in got.collect()) == brute(q, p, 5, metric)


def test_grid_copies_a_passage_once_per_query_row():
    from refinespark.operators.exact import grid_factors
    gib = 1 << 30
    rows, columns = grid_factors(100_000_000 * 64 * 4, 1_000_000_000 * 64 * 4, 256 << 20, 10_000)
    groups = 100_000_000 / 2048  # copies of a passage if each query group had its own
    assert rows == 96 and rows < groups / 400 and columns >= 954
    assert rows * columns >= 10_000 and 25.6e9 / rows <= 256 << 20 and 256e9 / columns <= 256 << 20
    assert grid_factors(0, 0, gib, 8) == (1, 8) and grid_factors(gib, gib, gib, 1) == (1, 1)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_blocks_out_of_reach_are_skipped_and_change_nothing(spark, monkeypatch, metric):
    import numpy as np
    from refinespark.operators import exact
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8))
    base /= np.linalg.norm(base, axis=1)[:, None]
    p = [(i, (v * (10.0 if i < 40 else 0.01)).round(4).tolist()) for i, v in enumerate(base)]
    q = [(i, (v * (10.0 if metric == "l2" else 1.0)).round(4).tolist()) for i, v in enumerate(base[:10])]
    group = exact._Group(np.arange(10), np.array([v for _, v in q], np.float32), 3, metric)
    added = []
    keep = group.top.add
    group.top.add = lambda s, ids: (added.append(len(ids)), keep(s, ids))
    for at in range(0, 300, 20):
        group.score(np.arange(at, min(at + 20, 300)), np.array([v for _, v in p[at:at + 20]], np.float32))
    assert len(added) < 15  # of 15 blocks
    got = topk_exact_bulk(frame(spark, q, "qid"), frame(spark, p, "pid").coalesce(1), k=3, metric=metric, block_rows=20)
    assert sorted(tuple(r) for r in got.collect()) == brute(q, p, 3, metric)


def test_k_larger_than_corpus_gives_short_list(spark):
    p = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    got = topk_exact_bulk(frame(spark, [(0, [1.0, 0.5])], "qid"), frame(spark, p, "pid"), k=10).collect()
    assert [r.pid for r in sorted(got, key=lambda r: r.rk)] == [3, 1, 2]


def test_ties_order_by_pid(spark):
    p = [(5, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [1.0, 0.0])]
    got = topk_exact_bulk(frame(spark, [(0, [1.0, 0.0])], "qid"), frame(spark, p, "pid"), k=2).collect()
    assert [(r.rk, r.pid) for r in sorted(got, key=lambda r: r.rk)] == [(1, 2), (2, 5)]


def test_empty_query_table(spark):
    got = topk_exact_bulk(frame(spark, [], "qid"), frame(spark, [(1, [1.0])], "pid"), k=3)
    assert got.count() == 0 and got.columns == ["qid", "rk", "pid", "score"]


def test_zero_vector_guard(spark):
    q = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])], "qid")
    assert [r.qid for r in guard_zero_vector(q, "vec", "quarantine").collect()] == [2]
    flags = {r.qid: r.zero_vector for r in guard_zero_vector(q, "vec", "flag").collect()}
    assert flags == {1: True, 2: False}
    with pytest.raises(Exception):
        guard_zero_vector(q, "vec", "fail").collect()


def test_plan_is_partial_then_final_limit(spark, data):
    q, p = data
    plan = topk_exact_bulk(frame(spark, q, "qid"), frame(spark, p, "pid"), k=3)._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "MapInArrow" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_scores_of_one_product_are_bounded(monkeypatch, metric):
    """A group meets a block in slices, whatever the size of either, with the same hits."""
    from refinespark.operators import exact
    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(40, 8)).astype(np.float32), rng.normal(size=(300, 8)).astype(np.float32)
    whole = exact._Group(np.arange(40), q, 3, metric)
    whole.score(np.arange(300), p)
    monkeypatch.setattr(exact, "SCORE_CELLS", 1_000)
    sizes, steps = [], exact._Group(np.arange(40), q, 3, metric)
    keep = steps.top.add
    steps.top.add = lambda s, ids: (sizes.append(s.size), keep(s, ids))
    steps.score(np.arange(300), p)
    assert max(sizes) <= 1_000 and sum(sizes) == 40 * 300
    assert all(np.array_equal(getattr(whole.top, c), getattr(steps.top, c)) for c in ("r", "pid", "score"))


def test_defaults_bound_what_a_task_holds_of_the_queries():
    """A task's queries, an Arrow batch and an encoder's counts do not grow with the table."""
    from refinespark import session
    from refinespark.operators import encode, exact
    assert exact.DEFAULT_BROADCAST_BYTES <= 16 << 20 and exact.DEFAULT_CELL_BYTES <= 16 << 20
    assert session.ARROW_MAX_BYTES <= 2 << 20 and encode.STEP_CELLS * 8 <= 2 << 20


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_grid_keeps_keys_beyond_doubles_and_null_keys(spark, metric):
    """Ids above 2^53 stay exact beside a null id, in the broadcast form and in the grid."""
    rng = np.random.default_rng(9)
    p = [((1 << 62) + i, rng.normal(size=8).round(3).tolist()) for i in range(50)]
    q = [((1 << 62) + 2 * i + 1, rng.normal(size=8).round(3).tolist()) for i in range(30)]
    qf, pf = frame(spark, q + [(None, q[0][1])], "qid"), frame(spark, p, "pid")
    want = brute(q, p, 3, metric)
    for kw in ({}, {"broadcast_bytes": 100, "cell_bytes": 300, "block_rows": 4, "query_group_rows": 3}):
        got = sorted(tuple(r) for r in topk_exact_bulk(qf, pf, k=3, metric=metric, **kw).collect())
        assert [r for r in got if r[0] > 0] == want and len(got) == len(want) + 3

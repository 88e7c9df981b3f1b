"""Index search that reads probed cells only, bounded probing, metrics, and the append-only stores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMALL
from refinespark.operators import ann
from refinespark.operators.encode import BatchEncoder, HashedEncoder, TfidfEncoder, encode_passages
from refinespark.operators.exact import topk_exact_bulk
from refinespark.operators.retrieve import search
from refinespark.plans.registry import QUERIES
from refinespark.sources import stores, tables as src


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors in 12 well separated clumps."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 6
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.3, size=16)).tolist()) for i in range(1200)]
    return spark.createDataFrame(rows, "pid long, vec array<float>").repartition(5)


def queries(v):
    return v.select(F.col("pid").alias("qid"), "vec")


def probed(monkeypatch):
    """Record the cells of every scan."""
    seen, scan = [], ann._scan

    def spy(probes, *args):
        seen.append([r[0] for r in probes.select("qid").collect()])
        return scan(probes, *args)
    monkeypatch.setattr(ann, "_scan", spy)
    return seen


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_bounded_probing_is_exact_and_reads_fewer_cells(spark, clustered, monkeypatch, metric):
    index = ann.build_index(clustered, nlist=12, bits=0, iters=4)
    seen = probed(monkeypatch)
    got = sorted(ann.ann_search_bulk(queries(clustered), index, k=10, metric=metric).collect())
    assert got == sorted(topk_exact_bulk(queries(clustered), clustered, k=10, metric=metric).collect())
    assert sum(map(len, seen)) < 1200 * 12 * 0.8  # (query, cell) pairs read, of all


@pytest.mark.parametrize("bits", [8, 4])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_bounded_probing_equals_all_cells_on_codes(spark, bits, metric):
    v = src.vectors(spark, SF_SMALL)
    index = ann.build_index(v, nlist=8, bits=bits, iters=1)
    q = queries(v)
    bounded = sorted(ann.ann_search_bulk(q, index, k=7, metric=metric).collect())
    assert bounded == sorted(ann.ann_search_bulk(q, index, k=7, nprobe=8, metric=metric).collect())
    # scores through slopes and offsets are those of the decoded vectors
    decoded = ann.sq_decode(index.codes, "code", *(F.lit(x.tolist()) for x in (index.lo, index.hi)), bits)
    plain = topk_exact_bulk(q, decoded.select("pid", F.col("dvec").cast("array<float>").alias("vec")), k=7, metric=metric)
    assert all(abs(a.score - b.score) < 1e-5 for a, b in zip(bounded, sorted(plain.collect())))


@pytest.mark.parametrize("name, exact, metric", [("ann_search_bulk", "topk_exact_bulk", "ip"), ("ann_search_l2", "topk_l2", "l2")])
def test_registered_searches_reach_the_recall(spark, name, exact, metric):
    want = {(r.qid, r.pid) for r in QUERIES[exact](spark, SF_CHECK).collect()}
    got = {(r.qid, r.pid) for r in QUERIES[name](spark, SF_CHECK).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_scan_is_pruned_and_nothing_is_shuffled_below_the_scores(spark, clustered):
    index = ann.build_index(clustered, nlist=12, bits=8, iters=2)
    one = queries(clustered).where("qid = 7")
    df = ann.ann_search_bulk(one, index, k=3, nprobe=2)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    tree = df._jdf.queryExecution().sparkPlan().toString()
    assert "PartitionFilters: [cell" in plan and "cell#" in plan
    below = tree[tree.index("MapInArrow"):]
    assert "Exchange" not in below and "SortMergeJoin" not in below and "BroadcastHashJoin" in below


def test_waves_of_queries_give_the_same_hits(spark, clustered):
    index = ann.build_index(clustered, nlist=6, bits=8, iters=1)
    one = sorted(ann.ann_search_bulk(queries(clustered), index, k=4).collect())
    assert one == sorted(ann.ann_search_bulk(queries(clustered), index, k=4, broadcast_bytes=40_000, query_group_rows=50).collect())


def test_short_lists_null_vectors_and_empty_tables(spark):
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "pid long, vec array<float>")
    index = ann.build_index(v, nlist=4, bits=8, iters=1)
    got = ann.ann_search_bulk(queries(v), index, k=5).collect()
    assert sorted((r.qid, r.pid) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert ann.ann_search_bulk(queries(v).limit(0), index, k=5).collect() == []
    empty = ann.build_index(v.limit(0), nlist=4)
    assert ann.ann_search_bulk(queries(v), empty, k=2).collect() == []
    with pytest.raises(ValueError):
        search(queries(v), v, metric="cosine", index=index)


def test_tree_merge_bounds_every_row(spark, monkeypatch):
    monkeypatch.setattr(ann, "MERGE_FAN_IN", 3)
    v = src.vectors(spark, SF_SMALL).repartition(17)
    lo, hi = (np.array(x) for x in ann.sq_bounds(v).first())
    mat = np.array([r.vec for r in v.collect()], np.float64)
    assert np.array_equal(lo, mat.min(axis=0)) and np.array_equal(hi, mat.max(axis=0))
    a = {r.cell: r.vec for r in ann.ivf_train(v, nlist=5, iters=2).collect()}
    monkeypatch.setattr(ann, "MERGE_FAN_IN", 64)
    b = {r.cell: r.vec for r in ann.ivf_train(v.coalesce(1), nlist=5, iters=2).collect()}
    assert all(np.allclose(a[c], b[c], atol=1e-12) for c in b) and a.keys() == b.keys()


# ------------------------------------------------------------------ stores
PASSAGES = "pid long, text string"


def vectors_of(df):
    return sorted((r.pid, tuple(r.vec)) for r in df.collect())


def counting(path):
    """An encoder that writes down how many texts it saw."""
    def factory():
        def model(texts):
            with open(path, "a") as f:
                f.write("x" * len(texts))
            return np.array([[len(t or ""), 1.0] for t in texts])
        return model
    return BatchEncoder(factory, f"count-{abs(hash(str(path)))}")


def test_only_new_rows_are_encoded(spark, tmp_path):
    log = tmp_path / "log"
    store = stores.VectorStore(spark, counting(log), root=str(tmp_path / "store"))
    old = spark.createDataFrame([(1, "a"), (2, "bb"), (None, "ccc")], PASSAGES)
    grown = spark.createDataFrame([(1, "a"), (2, "changed"), (None, "ccc"), (4, None), (4, None)], PASSAGES)
    assert store.append(old) == 3 and len(log.read_text()) == 3
    got = [(r.pid, r.vec) for r in store.read(grown).collect()]
    assert len(log.read_text()) == 5  # the changed text and the new row, once
    assert sorted(got, key=str) == sorted([(1, [1.0, 1.0]), (2, [7.0, 1.0]), (None, [3.0, 1.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0])], key=str)
    assert sorted(r.vec for r in store.read(old).collect()) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]] and len(log.read_text()) == 5
    assert len(store.generations()) == 2 and store.content()[0] == 5
    assert store.append(grown) == 0 and len(store.generations()) == 2


def test_half_written_generations_do_not_count(spark, tmp_path):
    enc = HashedEncoder(8)
    store = stores.VectorStore(spark, enc, root=str(tmp_path / "store"))
    p = spark.createDataFrame([(1, "red apple")], PASSAGES)
    p.write.parquet(f"{store.root}/000000-lost/vectors")  # a writer was lost before its manifest
    assert store.generations() == [] and vectors_of(store.read(p)) == vectors_of(encode_passages(p, "pid", "text", enc))
    with pytest.raises(Exception):
        stores.complete_folders(spark, "nosuchscheme://x/y", "manifest")


def test_content_is_a_multiset(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], PASSAGES)
    b = spark.createDataFrame([(3, "z"), (3, "z"), (2, "y")], PASSAGES)
    assert stores.fingerprint(a, "pid", "text") != stores.fingerprint(b, "pid", "text")
    assert stores.fingerprint(a, "pid", "text") == stores.fingerprint(a.orderBy(F.desc("pid")), "pid", "text")


def test_refitted_weights_give_fresh_vectors(spark):
    p = spark.createDataFrame([(1, "red apple"), (2, "red sky"), (3, "blue sky")], PASSAGES)
    one, two = TfidfEncoder(32).fit(p), TfidfEncoder(32).fit(p.where("pid < 3"))
    assert one.name != two.name and one.name == TfidfEncoder(32).fit(p).name
    for enc in (one, two):
        assert vectors_of(stores.embedding_store(p, enc)) == vectors_of(enc.encode(p, "pid", "text"))
    assert math.isclose(sum(x * x for x in vectors_of(stores.embedding_store(p, one))[0][1]), 1.0, rel_tol=1e-6)


def test_stored_index_is_read_again(spark):
    v = src.vectors(spark, SF_SMALL)
    a, b = (stores.index_store(v, nlist=4, iters=1) for _ in range(2))
    assert a.lists.inputFiles() == b.lists.inputFiles() and np.array_equal(a.lo, b.lo)
    assert stores.index_store(v.where("pid > 0"), nlist=4, iters=1).lists.inputFiles() != a.lists.inputFiles()


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_many_probes_are_dealt_and_not_broadcast(spark, clustered, metric):
    """Beyond the bound no query block goes through the driver; grid cells of either size give the same hits, repeated ids too."""
    index = ann.build_index(clustered, nlist=6, bits=8, iters=1)
    q = queries(clustered)
    q = q.union(q.where("qid < 5"))
    one = sorted(ann.ann_search_bulk(q, index, k=4, metric=metric).collect())
    bounded = {"metric": metric, "broadcast_bytes": 1_000, "cell_bytes": 40_000, "query_group_rows": 50}
    assert one == sorted(ann.ann_search_bulk(q, index, k=4, **bounded).collect())
    plan = ann.ann_search_bulk(q, index, k=4, nprobe=2, **bounded)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan


def test_probes_are_packed_in_bounded_steps(spark, clustered, monkeypatch):
    index = ann.build_index(clustered, nlist=6, bits=8, iters=1)
    one = sorted(ann.ann_search_bulk(queries(clustered), index, k=4).collect())
    monkeypatch.setattr(ann, "PROBE_CELLS", 13)
    monkeypatch.setattr(ann, "PROBE_ROWS", 7)
    assert one == sorted(ann.ann_search_bulk(queries(clustered), index, k=4).collect())

"""Table retrieval schema rules, ANN recall against exact, the stream form, stores."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from refinespark.operators import ann, retrieve
from refinespark.operators.encode import HashedEncoder
from refinespark.operators.exact import topk_exact_bulk
from refinespark.operators.retrieve import retrieve_table, retrieve_table_ids
from refinespark.sources import stores, tables as src
from refinespark.streaming import chat_stream
from refinespark.plans import chat


def _passages(spark):
    return spark.createDataFrame([(1, "red apple pie"), (2, "blue sky"), (3, "red red car")], "pid long, text string")


def test_truth_columns_only_with_both(spark):
    enc = HashedEncoder(64)
    only_ctx = spark.createDataFrame([(10, "red", "ctx")], "id long, question string, context string")
    out = retrieve_table_ids(only_ctx, _passages(spark), enc, k=2)
    assert out.columns == ["id", "question", "context_id", "context"]
    both = spark.createDataFrame([(10, "red", "ctx", ["a"])],
                                 "id long, question string, context string, answers array<string>")
    out = retrieve_table_ids(both, _passages(spark), enc, k=2)
    assert out.columns[-2:] == ["original_context", "answers"]
    r = out.first()
    assert r.context_id[0] == 3 and r.original_context == "ctx"


def test_all_rows_back_and_empty(spark):
    enc = HashedEncoder(64)
    q = spark.createDataFrame([(1, "red", "x"), (2, "!!!", "y")], "qid long, q string, a string")
    got = {r.qid: r.retrieve for r in retrieve_table(q, _passages(spark), enc).collect()}
    assert got == {1: "red red car", 2: None}
    empty = spark.createDataFrame([], "qid long, q string, a string")
    assert retrieve_table(empty, _passages(spark), enc).count() == 0


def test_ann_recall_rises_with_nprobe(spark):
    v = src.vectors(spark, SF_SMALL)
    q = v.select(F.col("pid").alias("qid"), "vec")
    exact = {(r.qid, r.pid) for r in topk_exact_bulk(q, v, k=10).collect()}
    idx = ann.build_index(v, nlist=8, bits=8, iters=1)
    recalls = []
    for nprobe in (1, 4, 8):
        got = {(r.qid, r.pid) for r in ann.ann_search_bulk(q, idx, k=10, nprobe=nprobe).collect()}
        recalls.append(len(got & exact) / len(exact))
    assert recalls[0] <= recalls[1] <= recalls[2] and recalls[2] > 0.9


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_path):
    enc = HashedEncoder(64)
    pairs = src.conversation_pairs(spark, SF_SMALL)
    batch = {tuple(r) for r in chat.chat_retriever(src.utterances(spark, SF_SMALL), pairs, enc).collect()}
    stream = chat_stream.utterance_stream(spark, f"{SF_SMALL}/conversations*.parquet")
    sink = chat_stream.run_chat_stream(spark, stream, pairs, enc, "t", sink=str(tmp_path / "sink"))
    first = {tuple(r) for r in chat_stream.read_replies(spark, sink).collect()}
    assert first == batch
    # same checkpoint: nothing new to answer, sink unchanged
    chat_stream.run_chat_stream(spark, chat_stream.utterance_stream(spark, f"{SF_SMALL}/conversations*.parquet"),
                                pairs, enc, "t", sink=sink)
    assert {tuple(r) for r in chat_stream.read_replies(spark, sink).collect()} == batch


def test_store_reuses_by_fingerprint(spark):
    p = _passages(spark)
    a = stores.embedding_store(p, HashedEncoder(32))
    b = stores.embedding_store(p, HashedEncoder(32))
    assert a.inputFiles() == b.inputFiles()
    c = stores.embedding_store(p, HashedEncoder(16))
    assert a.inputFiles() != c.inputFiles()


def test_nearest_cells_keep_null_vectors(spark):
    cents = spark.createDataFrame([(0, [0.0, 0.0]), (1, [4.0, 0.0]), (2, [4.0, 0.0])], "cell int, vec array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [4.0, 1.0]), (4, [2.0, 0.0])], "pid long, vec array<float>")
    got = {r.pid: r.cells for r in ann.with_nearest_cells(v, "vec", cents, 2).collect()}
    assert got == {1: [0, 1], 2: None, 3: [1, 2], 4: [0, 1]}  # ties go to the lower cell


def test_hot_cell_split_changes_nothing(spark):
    """A cell holding most vectors is cut into many sub-blocks; hits stay the same."""
    import numpy as np
    rng = np.random.default_rng(5)
    hot = [(i, (np.ones(8) + rng.normal(scale=0.01, size=8)).astype(float).tolist()) for i in range(300)]
    rest = [(1000 + i, rng.normal(size=8).astype(float).tolist()) for i in range(60)]
    v = spark.createDataFrame(hot + rest, "pid long, vec array<float>")
    small = ann.build_index(v, nlist=4, bits=8, iters=1, list_rows=16)
    big = ann.build_index(v, nlist=4, bits=8, iters=1, list_rows=100000)
    q = v.select(F.col("pid").alias("qid"), "vec")
    assert small.lists.groupBy("cell").count().agg(F.max("count")).first()[0] > 5  # the hot cell is split
    a = sorted(ann.ann_search_bulk(q, small, k=5, nprobe=2, query_group_rows=8).collect())
    b = sorted(ann.ann_search_bulk(q, big, k=5, nprobe=2, query_group_rows=100000).collect())
    assert a == b


def test_all_cells_flat_lists_equal_exact(spark):
    v = src.vectors(spark, SF_SMALL)
    q = v.select(F.col("pid").alias("qid"), "vec")
    idx = ann.build_index(v, nlist=8, bits=0, iters=1)
    got = sorted(ann.ann_search_bulk(q, idx, k=10, nprobe=8).collect())
    assert got == sorted(topk_exact_bulk(q, v, k=10).collect())


def test_stream_with_processing_time_trigger(spark, tmp_path):
    enc = HashedEncoder(64)
    pairs = src.conversation_pairs(spark, SF_SMALL)
    stream = chat_stream.utterance_stream(spark, f"{SF_SMALL}/conversations*.parquet")
    q = chat_stream.run_chat_stream(spark, stream, pairs, enc, "pt", sink=str(tmp_path / "pt"),
                                    processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert chat_stream.read_replies(spark, str(tmp_path / "pt")).count() == src.utterances(spark, SF_SMALL).count()


def test_popular_passages_are_joined_by_many_keys(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(retrieve, "POPULAR", 4)  # more than a quarter of all hits
    rows = [(q, 1, 7 if q % 3 else q % 40, 0.5) for q in range(900)] + [(q, 2, 8, 0.25) for q in range(0, 900, 2)]
    hits = spark.createDataFrame(rows, "qid long, rk int, pid long, score double").repartition(4)
    texts = spark.createDataFrame([(p, f"text {p}") for p in range(30)], "pid long, text string")  # pids 30 to 39 have none
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = retrieve.with_passages(hits, texts)
        assert sorted(tuple(r) for r in found.select("qid", "rk", "pid", "score", "text").collect()) == sorted(
            (*r, f"text {r[2]}") for r in rows if r[2] < 30)
        keys = hits.join(texts, "pid").count()
        assert found.count() == keys
        context = {r.qid: (r.context_id, r.context) for r in retrieve.join_context(hits, texts).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert context[2] == ([7, 8], "text 7 text 8") and context[1] == ([7], "text 7") and context[0] == ([0, 8], "text 0 text 8")
    assert retrieve.with_passages(hits.limit(0), texts).collect() == []
    assert retrieve.lookup_passage(hits.where(F.col("qid") == 4), texts).collect()[0]["text"] == "text 7"

"""User-supplied encoders and generators, other index settings, self-exclusion."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from refinespark.operators import ann
from refinespark.operators.encode import BatchEncoder, TfidfEncoder
from refinespark.operators.generate import BatchGenerator, generate_batch
from refinespark.operators.retrieve import retrieve_table, search_passages
from refinespark.plans.datasets import refine_prompts
from refinespark.operators.encode import HashedEncoder
from refinespark.sources import tables as src


def test_batch_encoder_runs_in_tasks(spark):
    def _length_encoder():  # defined inside the test so it is pickled by value
        import numpy as np

        def encode(texts):
            return np.array([[len(t), t.count("a") + 1.0] for t in texts], dtype=np.float32)
        return encode

    p = spark.createDataFrame([(1, "aaa"), (2, "b"), (3, "abab")], "pid long, text string")
    enc = BatchEncoder(_length_encoder, "length", batch_rows=2)
    vecs = {r.pid: list(r.vec) for r in enc.encode(p, "pid", "text").collect()}
    assert vecs == {1: [3.0, 4.0], 2: [1.0, 1.0], 3: [4.0, 3.0]}
    q = spark.createDataFrame([(9, "aa", "x")], "qid long, q string, a string")
    assert retrieve_table(q, p, enc, k=1).first().retrieve == "aaa"  # [2,3].[3,4] = 18 beats 17


def test_user_generator(spark):
    def factory():
        return lambda prompts, n: [[(p.upper(), 1.0)] for p in prompts]
    prompts = spark.createDataFrame([(1, "hi")], "qid long, prompt string")
    out = generate_batch(prompts, BatchGenerator(factory, "upper"), "prompt", 3).collect()
    assert [(r.qid, r.cand, r.reply) for r in out] == [(1, 0, "HI")]


def test_tfidf_search(spark):
    p = spark.createDataFrame([(1, "red apple"), (2, "red car"), (3, "blue car")], "pid long, text string")
    enc = TfidfEncoder(64).fit(p, "text")
    hits = search_passages(spark, "apple", p, enc, k=2).orderBy("rk").collect()
    assert hits[0].pid == 1


def test_kmeans_and_four_bit_index(spark):
    v = src.vectors(spark, SF_SMALL)
    idx = ann.build_index(v, nlist=4, bits=4, iters=3, method="kmeans")
    assert idx.centroids.count() == 4
    codes = idx.codes.select(F.array_max("code").alias("m")).agg(F.max("m")).first()[0]
    assert codes <= 15
    q = v.select(F.col("pid").alias("qid"), "vec")
    hits = ann.ann_search_bulk(q, idx, k=3, nprobe=4)
    assert hits.groupBy("qid").count().where("count != 3").count() == 0


def test_exclude_self(spark):
    pairs = spark.createDataFrame([(1, "red apple", "red apple"), (2, "blue sky", "blue sky pie")],
                                  "pair_id long, q string, a string")
    got = {r.pair_id: r.retrieved_pid for r in refine_prompts(pairs, HashedEncoder(64), p=1.0,
                                                                 exclude_self=True).collect()}
    assert got == {1: 2, 2: 1}


def test_incremental_encoding(spark):
    from refinespark.operators.encode import encode_incremental
    enc = HashedEncoder(16)
    old = spark.createDataFrame([(1, "red apple")], "pid long, text string")
    grown = spark.createDataFrame([(1, "red apple"), (2, "blue sky")], "pid long, text string")
    have = enc.encode(old, "pid", "text")
    both = encode_incremental(grown, have, enc)
    assert sorted(r.pid for r in both.collect()) == [1, 2]
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, enc.encode(grown, "pid", "text").collect()))


def test_counts_in_bounded_steps(spark, monkeypatch):
    """Vectors do not depend on how many counts a task holds at a time; wide vectors go in many steps."""
    from refinespark.operators import encode
    rows = [(i, None if i % 11 == 0 else " ".join(f"w{(i * k) % 37}" for k in range(i % 9))) for i in range(300)] + [(None, "w1 w1 w2")]
    df = spark.createDataFrame(rows, "pid long, text string").repartition(3)
    for dim in (16, 5000):
        whole = sorted((str(r.pid), r.vec) for r in encode.HashedEncoder(dim).encode(df, "pid", "text").collect())
        monkeypatch.setattr(encode, "STEP_CELLS", 3 * dim - 1)
        steps = sorted((str(r.pid), r.vec) for r in encode.HashedEncoder(dim).encode(df, "pid", "text").collect())
        monkeypatch.undo()
        assert whole == steps and len(whole) == len(rows) and all(len(v) == dim for _, v in whole)
        words = {"w1": 2.0, "w2": 1.0}
        expected = [0.0] * dim
        for w, n in words.items():
            expected[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += n
        norm = sum(x * x for x in expected) ** 0.5
        got = dict(whole)["None"]
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(got, expected, strict=True))

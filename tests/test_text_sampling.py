"""Text edges, seeded sampling, exact splits, batches."""

import pytest
from pyspark.sql import functions as F

from refinespark.functions.text import strip_blank, vocab_tokens, wrap
from refinespark.operators import sampling
from refinespark.sources.tables import read_pairs_csv


def test_strip_unicode_blanks_and_wrap(spark):
    rows = [(1, "\t hello\n"), (2, " 안녕　"), (3, "NA"), (4, "null")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.p for r in df.select("id", wrap(strip_blank("t")).alias("p")).collect()}
    assert got == {1: "<s>hello</s>", 2: "<s>안녕</s>", 3: "<s>NA</s>", 4: "<s>null</s>"}


def test_tokens_keep_markers_whole(spark):
    df = spark.createDataFrame([("<s>Hello, Wörld 12</s>",)], "t string")
    assert df.select(vocab_tokens("t").alias("x")).first().x == ["<s>", "hello", "wörld", "12", "</s>"]


def test_csv_pairs_multiline_quotes_and_nulls(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text('Q,A\n"hi ""there""","line one\nline two"\nNA,null\n,missing question\n', encoding="utf-8")
    rows = read_pairs_csv(spark, str(path)).orderBy("pair_id").collect()
    assert [(r.pair_id, r.q, r.a) for r in rows] == [(0, 'hi "there"', "line one\nline two"), (1, "NA", "null")]


def test_exact_split_sizes_and_disjoint(spark):
    df = spark.range(233).withColumnRenamed("id", "k")
    s = sampling.exact_split(df, "k", 0.8).cache()
    assert s.where(F.col("split") == "train").count() == int(233 * 0.8)
    assert s.count() == 233 and s.select("k").distinct().count() == 233


def test_seeded_draw_independent_of_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = {r.k for r in sampling.bernoulli_mix(df.repartition(1), "k", 0.3).collect()}
    b = {r.k for r in sampling.bernoulli_mix(df.repartition(7), "k", 0.3).collect()}
    assert a == b and 100 < len(a) < 200


@pytest.mark.parametrize("parts", [1, 5])
def test_global_rank_dense_and_stable(spark, parts):
    df = spark.range(300).withColumnRenamed("id", "k").repartition(parts)
    r = sampling.global_rank(df, "k", bucket_bits=4)
    ranks = sorted(x.rank for x in r.collect())
    assert ranks == list(range(1, 301))
    again = {x.k: x.rank for x in sampling.global_rank(df.repartition(3), "k", bucket_bits=4).collect()}
    assert {x.k: x.rank for x in r.collect()} == again


def test_batches_exact_size_last_short(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    sizes = {r.batch_id: r["count"] for r in sampling.sequential_batches(df, "k", 20).groupBy("batch_id").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 5}
    e0 = sampling.shuffled_batches(df, "k", 20, epoch=0)
    e1 = sampling.shuffled_batches(df, "k", 20, epoch=1)
    assert {r.k: r.batch_id for r in e0.collect()} != {r.k: r.batch_id for r in e1.collect()}


def plain_pairs(rows):
    """(q, a) of user turns followed at once by an assistant turn, by plain sorting."""
    found = []
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is None, turn or 0, role, text))
    for turns in groups.values():
        turns.sort()
        found += [(x[3], y[3]) for x, y in zip(turns, turns[1:]) if x[2] == "user" and y[2] == "assistant"]
    return sorted(found)


def test_pairs_over_partition_borders(spark, tmp_path):
    """Dense, sparse, repeated, null and one hot conversation: one plan, many ranges."""
    import random
    from refinespark.sources.tables import next_rows
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"hot {t}") for t in range(400)]  # most of all turns
    rows += [(c, t * 3, rng.choice(["user", "assistant"]), f"{c} {t}") for c in range(20, 40) for t in range(rng.randrange(1, 6))]
    rows += [(None, t, rng.choice(["user", "assistant"]), f"null {t}") for t in range(20)]
    rows += [(50, 1, "user", "twice"), (50, 1, "user", "twice"), (50, 2, "assistant", "once"), (51, None, "assistant", "last"), (51, 3, "user", "before")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = next_rows(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.text, r.next_text) for r in got if r.role == "user" and r.next_role == "assistant") == plain_pairs(rows)
    assert next_rows(df.limit(0)).collect() == []


def test_ranks_of_outliers_and_of_one_value(spark):
    from refinespark.operators.sampling import key_order_rank, sequential_batches
    keys = [*range(500), 10**17, -10**17, *[42] * 300]
    df = spark.createDataFrame([(k, i % 5) for i, k in enumerate(keys)], "k long, v int").repartition(7)
    rows = key_order_rank(df, "k", name="r").collect()
    assert sorted(r.r for r in rows) == list(range(1, len(keys) + 1))
    ordered = [r.k for r in sorted(rows, key=lambda r: r.r)]
    assert ordered == sorted(keys)
    spread = spark.createDataFrame([(1, "same")] * 400, "k long, v string")
    from refinespark.operators import sampling
    seen = []
    keep = sampling.materialise

    def spy(d, name="table"):
        out = keep(d, name)
        seen.append(max(r[1] for r in out.groupBy(F.shiftright("_mid", 33)).count().collect()))
        return out
    sampling.materialise = spy
    try:
        assert sorted(r.r for r in key_order_rank(spread, "k", name="r").collect()) == list(range(1, 401))
    finally:
        sampling.materialise = keep
    assert seen[0] < 200  # one value of all rows lies in many parts
    batches = sequential_batches(df, "k", 100).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in batches) == [2, *[100] * 8]
    assert key_order_rank(df.limit(0), "k").collect() == []


def test_with_position_dense_over_partitions(spark):
    from refinespark.sources.tables import with_position
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "x")
    rows = with_position(df, "pos").collect()
    assert sorted(r.pos for r in rows) == list(range(1000))
    assert all(r.pos == r.x for r in rows)  # file (partition) order kept

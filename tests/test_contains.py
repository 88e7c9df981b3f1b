"""The substring join against brute force: short and long patterns, common grams, odd rows."""

import random

from pyspark.sql import functions as F

from refinespark.operators import textmatch
from refinespark.operators.textmatch import contains_join


def pairs_of(df):
    return sorted((r.did, r.pid) for r in df.collect())


def brute(docs, pats):
    return sorted((i, j) for i, d in docs for j, p in pats if d is not None and p is not None and p in d)


def test_contains_join_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épée", "ß", "x", "🙂🙂"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) for _ in range(40)] + [None, ""]
    pats = [d[i:i + ln] for d in docs[:10] if d for ln in (1, 2, 3, 7, 8, 9, 45) for i in [rng.randint(0, max(0, len(d) - 50))]]
    pats += ["beta gamma", "zzz not there at all, long enough to have a key......", "", "", None, "beta gamma", "🙂"]
    docs, pats = list(enumerate(docs)), list(enumerate(pats))
    ddf = spark.createDataFrame(docs, "did long, d_text string").repartition(5)
    pdf = spark.createDataFrame(pats, "pid long, p_text string").withColumn("key", F.lit("clash")).withColumn("size", F.lit(1))
    got = contains_join(ddf, pdf)
    assert got.columns == ["did", "d_text", "pid", "p_text", "key", "size"] and pairs_of(got) == brute(docs, pats)
    monkeypatch.setattr(textmatch, "FILTER_BITS", 64)  # every gram passes: the same pairs
    assert pairs_of(contains_join(ddf, pdf)) == brute(docs, pats)


def test_many_short_patterns_without_a_nested_loop(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij klm") for _ in range(4000))
    docs = [(i, text[i * 37:i * 37 + rng.randint(0, 200)]) for i in range(60)]
    pats = [(j, "".join(rng.choice("abcdefghij klm") for _ in range(rng.randint(1, 40))) if rng.random() < 0.9 else text[j % 3000:j % 3000 + rng.randint(1, 40)])
            for j in range(10_001)]
    df = contains_join(spark.createDataFrame(docs, "did long, d_text string"), spark.createDataFrame(pats, "pid long, p_text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs_of(df) == brute(docs, pats)


def test_a_common_beginning_is_not_the_key(spark):
    """Patterns that begin with boilerplate are looked up by a gram of their own."""
    docs = [(i, "All rights reserved by the owner. " + f"text number {i} of many") for i in range(200)]
    pats = [(j, f"All rights reserved by the owner. text number {j} of") for j in range(0, 200, 20)]
    ddf, pdf = spark.createDataFrame(docs, "did long, d_text string"), spark.createDataFrame(pats, "pid long, p_text string")
    seen = []
    keep = textmatch.materialise

    def spy(df, name="table"):
        out = keep(df, name)
        if name == "pairs":
            seen.append(out.count())
        return out
    textmatch.materialise = spy
    try:
        assert pairs_of(contains_join(ddf, pdf)) == brute(docs, pats)
    finally:
        textmatch.materialise = keep
    assert seen[0] < 200  # of 2,000 pairs that share the beginning


def test_empty_tables(spark):
    ddf, pdf = spark.createDataFrame([], "did long, d_text string"), spark.createDataFrame([(1, "a"), (2, "")], "pid long, p_text string")
    assert contains_join(ddf, pdf).collect() == []
    assert contains_join(spark.createDataFrame([(1, "abc")], "did long, d_text string"), pdf.limit(0)).collect() == []

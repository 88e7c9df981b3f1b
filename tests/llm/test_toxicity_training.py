"""Toxicity: equal scores for any row layout, priors without two classes, and training against plain versions."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refinespark.llm import toxicity
from refinespark.llm.toxicity import fit, gradient, marks, op10_toxicity, score_texts

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def scores(docs, labels, rows=toxicity.SAMPLE_ROWS):
    model, weights = fit(docs, labels, rows=rows)
    return {r[0]: r[1] for r in score_texts(docs, model, weights).select("doc_id", "toxicity").collect()}


def test_scores_do_not_depend_on_the_layout_of_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_BYTES", 64 << 10)  # several parts, merged in two steps
    monkeypatch.setattr(toxicity, "MERGED", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = scores(docs, labels)
    for d, t in ((docs.repartition(7), labels.repartition(3)), (docs.orderBy(F.desc("text")).coalesce(2), labels.orderBy(F.desc("doc_id")))):
        again = scores(d, t)
        assert again.keys() == first.keys() and max(abs(again[k] - first[k]) for k in first) < 1e-9
        assert all((again[k] >= 0.5) == (first[k] >= 0.5) for k in first)


@pytest.mark.parametrize("labelled, expected", [([], 0.0), ([(i, 0) for i in range(40)], 0.0), ([(i, 1) for i in range(40)], 1.0), ([(None, 1), (3, None)], 0.0)])
def test_one_class_or_none_gives_the_prior(spark, tmp_path, labelled, expected):
    docs = spark.createDataFrame([(i, f"plain words number {i}") for i in range(50)] + [(None, None), (60, "")], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labelled], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = op10_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 52 and all(abs(r.score - expected) < 1e-6 and r.predicted == int(expected) for r in got)


def test_the_sample_is_bounded_in_bytes_and_the_same_for_any_layout(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 20_000)
    monkeypatch.setattr(toxicity, "LONGEST", 5_000)
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 90))) for i in range(400)] + [(1000, "y" * 6000), (7, "a second text of one id")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], LABELS)
    picked = [sorted((r.id, r.text) for r in toxicity.sample(d, labels, "doc_id", "text", "toxic", 16_000).collect()) for d in (docs, docs.repartition(9))]
    assert picked[0] == picked[1] and 10_000 < sum(len(t) for _, t in picked[0]) <= 20_000
    assert all(len(t) <= 5_000 for _, t in picked[0])


def test_marks_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SUPPORT", 2)
    monkeypatch.setattr(toxicity, "RATIO", 2.0)
    rng = np.random.default_rng(2)
    words = ["hateful", "hatefully", "kind", "kindness", "sun", "ünïcode"]
    rows = [(" ".join(rng.choice(words[:2] + words[4:] if t else words[2:], 6)), int(t)) for t in rng.random(60) < 0.4]
    seen = [Counter(), Counter()]
    for text, t in rows:
        found = set()
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()):
            raw = w.encode()
            found |= {raw, *((raw[:size], "prefix") for size in toxicity.PREFIXES if len(raw) > size)}
        seen[t].update(found)
    n = [sum(t == k for _, t in rows) for k in (0, 1)]
    expected = {x for x, c in seen[1].items() if c >= 2 and (c + 0.5) / (n[1] + 1) >= 2.0 * (seen[0][x] + 0.5) / (n[0] + 1)}
    found = marks(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(found) == len(expected) and (np.diff(found.astype(object)) > 0).all()
    keys = toxicity.words_of(pa.array(["hateful hatefully kind"]))
    assert [bool(np.isin(keys.keys[0, k], found)) for k in range(3)] == [w.encode() in expected for w in ("hateful", "hatefully", "kind")]


def log_likelihood(model, places, begins, labels):
    """Over all taggings of each text."""
    score = toxicity.emissions(model, places)
    edges, total = [*np.flatnonzero(begins).tolist(), len(begins)], 0.0

    def weight(a, b, y):
        # a word's score splits between the states as the scoring does: only differences count
        out = model.links[2][y[0]] + sum(model.links[y[t - 1]][y[t]] for t in range(1, b - a))
        return out + sum(min(0, score[a + t]) if y[t] else min(0, -score[a + t]) for t in range(b - a))
    for a, b in itertools.pairwise(edges):
        every = [weight(a, b, y) for y in itertools.product((0, 1), repeat=b - a)]
        total += weight(a, b, labels[a:b].tolist()) - math.log(sum(map(math.exp, every)))
    return total


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(9)
    words = toxicity.words_of(pa.array(["one two bad three", "bad", "four bad bad one two"]))
    places, begins = toxicity.features(words), toxicity._begins(words.first, len(words.starts))
    labels = np.array([0, 0, 1, 0, 1, 0, 1, 1, 0, 0])
    weights = np.zeros(1 << toxicity.BITS)
    used = np.unique(places[1:])
    used = used[used > 0]
    weights[used] = rng.normal(scale=0.3, size=len(used))
    model = toxicity.Model(weights, rng.normal(scale=0.3, size=(3, 2)))
    found = gradient(model, places, begins, labels)
    for at in rng.choice(used, 8, replace=False):
        value = []
        for h in (1e-5, -1e-5):
            moved = weights.copy()
            moved[at] += h
            value.append(log_likelihood(toxicity.Model(moved, model.links), places, begins, labels))
        assert abs((value[0] - value[1]) / 2e-5 - found.weights[at]) < 1e-4
    for i, j in itertools.product(range(3), range(2)):
        value = []
        for h in (1e-5, -1e-5):
            links = model.links.copy()
            links[i, j] += h
            value.append(log_likelihood(toxicity.Model(weights, links), places, begins, labels))
        assert abs((value[0] - value[1]) / 2e-5 - found.links[i, j]) < 1e-4


def test_spans_are_the_runs_of_words_over_one_half(spark):
    weights = np.zeros(1 << toxicity.BITS)
    words = toxicity.words_of(pa.array(["bad awful"]))
    weights[toxicity.features(words)[1]] = 12.0  # the words' own features
    model = toxicity.Model(weights, np.zeros((3, 2)))
    weights[0] = -6.0
    df = spark.createDataFrame([(1, "ü so Bad, awful day; bad"), (2, None), (3, "fine")], DOCS)
    got = {r.doc_id: r for r in score_texts(df, model, np.array([0.0, 1.0, 0.0, 0.0])).collect()}
    assert [tuple(s) for s in got[1].toxic_spans] == [(5, 15), (21, 24)] and got[2].toxic_spans == [] and got[3].toxic_spans == []
    assert got[1].toxicity > 0.9 > 0.1 > got[3].toxicity

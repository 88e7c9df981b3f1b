"""The Jaccard join against brute force over word n-gram sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from refinespark.llm import jaccard
from refinespark.llm.jaccard import bits_of, folded, jaccard_groups, jaccard_links, op11_ngram_jaccard, overlaps, shingle_sets, signature

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, width=4):
    words = (text or "").translate(LOWER).encode().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def plain_components(rows, num=85, den=100, width=4):
    """(id, set size, component) of (id, text) rows, over all pairs."""
    sets = [plain_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rng, words, share):
    return [rng.choice("abcdefghij") * 3 + str(rng.randrange(999)) if rng.random() < share else w for w in words]


def documents(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 30, 90, 300, 1200]))]
        for share in (0.0, 0.002, 0.01, 0.02, 0.04):
            rows.append(" ".join(edited(rng, base, share)))
            if rng.random() < 0.4:
                rows.append(" ".join(base[: max(1, int(len(base) * rng.uniform(0.8, 1)))]))
    rows += [None, "", " \n\t\x0b", "One", "one", "ONE two", "one two three", "one two three four", "Ünï ünï Ünï", "é" * 5000] * 2
    rows += ["the same words over and over again " * 40] * 5
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def found(df):
    return sorted((tuple(r) for r in df.select("id", "n", "component_id").collect()), key=str)


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("small", [False, True])
def test_components_equal_brute_force(spark, monkeypatch, small):
    if small:  # many tiles, groups over several tiles, few rows a comparison step
        monkeypatch.setattr(jaccard, "TILE_MOST", 7)
        monkeypatch.setattr(jaccard, "FILTER_BITS", 64)
        monkeypatch.setattr(jaccard, "SETS", 3)
        monkeypatch.setattr(jaccard, "CELLS", 16)
    rows = documents(1 + small)
    assert found(jaccard_groups(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain_components(rows)


def test_one_group_of_near_copies_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SETS", 8)
    monkeypatch.setattr(jaccard, "TILE_MOST", 16)
    rng = random.Random(3)
    base = [f"v{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.03))) for i in range(160)]  # links come and go: chains join most of them
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(jaccard_groups(df)) == plain_components(rows)


def plain_links(rows, num=85, den=100):
    """Links between different sets as (set, set, shared), and (id, n, number of other rows linked) of every row."""
    sets = [plain_set(t) for _, t in rows]
    links, count = set(), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                count[i] += 1
                count[j] += 1
                if sets[i] != sets[j]:
                    links.add((frozenset([sets[i], sets[j]]), both))
    return links, sorted(((d, len(sets[i]), count[i]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_every_link_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard, "TILE_LEAST", 7)
        monkeypatch.setattr(jaccard, "TILE_FACTOR", 1)
        monkeypatch.setattr(jaccard, "SETS", 3)
        monkeypatch.setattr(jaccard, "CELLS", 16)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(150)]
    texts = [t for _, t in documents(6)][:120] + [" ".join(edited(rng, base, 0.01)) for _ in range(40)] + [" ".join(base)] * 7
    rows = list(enumerate(texts))
    links, members = jaccard_links(spark.createDataFrame(rows, SCHEMA).repartition(5))
    expected, counts = plain_links(rows)
    members = members.collect()
    assert sorted(((r.id, r.n, r.n_links) for r in members), key=str) == counts
    of = {r["class"]: plain_set(texts[r.id]) for r in members if r["class"] is not None}
    assert len({r["class"] for r in members} - {None}) == len({plain_set(t) for t in texts} - {frozenset()})
    found = [(frozenset([of[a], of[b]]), shared) for a, b, shared in links.collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_links_of_empty_tables_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e", 1), (None, "A b c d e", 2), (7, "a b c d e", 3), (7, None, 3), (8, " ", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("class", F.lit(0)).withColumn("n_links", F.lit("x"))
    links, members = jaccard_links(df)
    assert links.collect() == []
    assert sorted(((r.id, r.n, r.n_links) for r in members.collect()), key=str) == sorted([(None, 2, 2), (None, 2, 2), (7, 2, 2), (7, 0, 0), (8, 0, 0)], key=str)
    links, members = jaccard_links(df.limit(0))
    assert links.collect() == [] and members.collect() == []


@pytest.mark.parametrize("num, den, width", [(1, 2, 1), (9, 10, 2)])
def test_other_thresholds_and_widths(spark, num, den, width):
    rng = random.Random(num)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    assert found(jaccard_groups(spark.createDataFrame(rows, SCHEMA), width=width, num=num, den=den)) == plain_components(rows, num, den, width)


def test_null_and_repeated_ids_and_clashing_columns(spark):
    text = "a b c d e f g h i j k"
    rows = [(None, text, 1), (None, text, 2), (7, text, 3), (7, text + " l", 3), (5, "x y", 4), (5, "x y", 4), (None, "only null ids", 5), (9, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumn("text_hash", F.lit(0)).withColumn("component_id", F.lit("c"))
    assert found(jaccard_groups(df)) == plain_components([r[:2] for r in rows])
    assert jaccard_groups(df.limit(0)).collect() == []


def test_op11_on_the_smallest_tables(spark):
    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    df = op11_ngram_jaccard(spark, small)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == plain_components(rows)


def test_signatures_bound_the_symmetric_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        values = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64))
        other = np.unique(np.concatenate([values[rng.random(len(values)) < 0.9], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]))
        a, b = (np.frombuffer(signature(x), np.uint64)[None] for x in (values, other))
        differ = len(np.setxor1d(values, other))
        for words in {1, min(a.shape[1], b.shape[1])}:
            assert np.bitwise_count(folded(a, words) ^ folded(b, words)).sum() <= differ
        assert overlaps(values, [other, values]).tolist() == [len(np.intersect1d(values, other)), len(values)]
    assert bits_of(np.array([0, 1, 64, 65, 128, 129])).tolist() == [64, 64, 64, 128, 128, 256]


def test_sets_of_long_and_short_texts():
    import pyarrow as pa
    texts = ["w%d" % i for i in range(5)]
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    for text in [None, "", "A b", "a B", "a b c d e a b c d", " ".join(texts), long]:
        found_set = shingle_sets(pa.array([text, "other words stand here"], pa.string()))[0]
        assert len(found_set) == len(plain_set(text)) and (np.diff(found_set.astype(object)) > 0).all()
    one, two = shingle_sets(pa.array(["A b", "a B"], pa.string()))
    assert np.array_equal(one, two)

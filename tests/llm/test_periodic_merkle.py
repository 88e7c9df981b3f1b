"""Periodic runs against brute force, and the Merkle manifest against a plain recursion."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from refinespark.llm import merkle, periodic
from refinespark.llm.merkle import Block, fold, height, op13_merkle_manifest, proofs
from refinespark.llm.periodic import find_runs, kept_words, op12_periodic_runs, periodic_runs, planted, strongest


def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            found[i, j + q] = min(q, found.get((i, j + q), q))
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(6, 4 * q))


def test_runs_equal_brute_force_however_the_words_arrive():
    rng = random.Random(5)
    for _ in range(600):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 3])
        if rng.random() < 0.5:
            base = [rng.randrange(k + 1) for _ in range(rng.randrange(1, 12))]
            w = [base[i % len(base)] for i in range(n)]
            for _ in range(rng.randrange(0, 3) if n else 0):
                w[rng.randrange(n)] = rng.randrange(k + 1)
        else:
            w = [rng.randrange(k) for _ in range(n)]
        for part in (1, 5, 1 << 20):
            assert find_runs(np.array(w, np.int64), None, part) == plain_runs(w)


def test_colliding_names_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda x: np.zeros_like(x))  # every window has one name
    rng = random.Random(6)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(40)]
        assert find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_long_runs_and_words_that_repeat_without_a_run():
    assert find_runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert find_runs(np.tile(np.arange(1000), 6)) == [(0, 6000, 1000)]
    assert find_runs(np.array([bin(i).count("1") & 1 for i in range(1 << 14)])) == []  # Thue-Morse: no cubes


def plain_row(doc_id, text):
    words = planted(doc_id, (text or "").encode()).split()
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12_equals_brute_force_on_whole_documents(spark, tmp_path):
    rng = random.Random(7)
    texts = [None, "", " \t\n", "a", "x " * 50, "one two three　four " * 9, "ab\x0bab ab\x0cab ab ab ab", "same same", "same same"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 120))) for _ in range(120)]
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(7, "x y " * 30), (7, "x y " * 30)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((plain_row(*r) for r in rows), key=str)


def test_op12_planted_rule():
    hit = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [f"w{i}" for i in range(100)]
    g = zlib.crc32(str(hit).encode()) // 10
    a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
    assert planted(hit, " ".join(words).encode()).decode().split() == [words[i] if i < a else words[a + (i - a) % p] for i in range(100)]
    assert planted(hit, b"") == b"" and planted(None, b"a b") == b"a b"


def test_periodic_runs_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("k", "go " * 8 + "home", 1)], "runs_ string, text string, start int")
    row = periodic_runs(df).collect()[0]
    assert row["collapsed"] == "go home" and [tuple(r) for r in row["runs"]] == [(0, 8, 1)] and row["start"] == 1
    assert periodic_runs(df.limit(0)).collect() == []
    assert strongest([]) is None and kept_words(3, []).tolist() == [0, 1, 2]


# --- Merkle ---------------------------------------------------------------------------------------


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_paths(nodes, fan):
    """Top of the nodes and the siblings of each, by plain recursion."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
    top, above = plain_paths([H(r) for r in runs], fan)
    return top, [[(r[:j], r[j + 1 :]) for j in [k]] + above[i] for i, r in enumerate(runs) for k in range(len(r))]


def plain_manifest(rows, fan):
    """rows: (id, group, leaf, presented)."""
    groups = sorted({g for _, g, _, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted([r for r in rows if r[1] == g], key=lambda r: (r[0] is not None, r[0] or 0, r[2])) for g in groups}
    trees = {g: plain_paths([r[2] for r in ordered[g]], fan) for g in groups}
    root, above = plain_paths([trees[g][0] for g in groups], fan)
    out = []
    for k, g in enumerate(groups):
        for r, path in zip(ordered[g], trees[g][1]):
            path = path + above[k]
            node = r[3] or r[2]
            for left, right in path:
                node = H([*left, node, *right])
            out.append((r[0], r[2], trees[g][0], root, H([x for a, b in path for x in a + b]), node, node == root))
    return out


COLUMNS = ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("fan, depth", [(2, 1), (2, 3), (8, 1), (8, 4)])
def test_proofs_equal_plain_recursion_over_several_stages(spark, fan, depth):
    rng = random.Random(fan + depth)
    rows = [(i, g, H([str(i), str(g)]), H(["t", str(i)]) if rng.random() < 0.3 else None)
            for i, g in enumerate(["en"] * 70 + ["de"] * 17 + [None] * 9 + ["z"] + ["é"] * 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, grp string, leaf string, presented string").repartition(5)
    found = sorted(tuple(r[c] for c in COLUMNS) for r in proofs(df, fan, depth).collect())
    assert found == sorted(plain_manifest(rows, fan))


def test_proofs_with_ties_nulls_repeats_and_empty_tables(spark):
    a, b = H(["a"]), H(["b"])
    rows = [(None, "x", a, None), (None, "x", b, b), (1, "x", a, None), (1, "x", a, None), (1, "x", a, None), (2, "x", b, a)]
    df = spark.createDataFrame(rows, "id long, grp string, leaf string, presented string")
    found = [tuple(r[c] for c in COLUMNS) for r in proofs(df, 2, 2).collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(rows, 2), key=str)
    one = proofs(df.limit(0), 2, 2)
    assert one.columns == ["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"] and one.collect() == []
    lone = proofs(spark.createDataFrame([(5, None, a, b)], df.schema)).collect()[0]
    assert (lone["root"], lone["subroot"], lone["folded_root"], lone["proof"], lone["verified"]) == (a, a, b, [], False)


def test_a_version_copies_ancestors_only():
    nodes = [H([str(i)]) for i in range(100)]
    block = Block(nodes, height(100))
    before = [list(x) for x in block.levels]
    copied = block.version(77, H(["new"]))
    assert len(copied) == len(block.levels) and block.levels == before
    changed = Block(nodes[:77] + [H(["new"])] + nodes[78:], height(100))
    place, differ = 77, 0
    for k, level in enumerate(changed.levels):
        assert level[place] == copied[k]
        differ += sum(x != y for x, y in zip(level, block.levels[k]))
        place //= merkle.FAN
    assert differ == len(copied) and fold(copied[0], block.path(77)) == changed.top


def test_op13_leaf_rule_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp int, id string"
    rows = [(0, "s", "en", 3, "Aé", "x", 1, "y"), (3, None, None, None, None, None, None, None), (None, "", "en", -1, "", "x", 1, "y")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in op13_merkle_manifest(spark, str(tmp_path)).collect()}

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    for row in rows:
        assert found[row[0]]["leaf"] == H([field(v) for v in row[:5]])
        touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None and row[4].lower() != row[4]
        assert found[row[0]]["verified"] == (not touched)

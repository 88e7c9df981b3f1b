"""Paths that only larger inputs take: many index blocks and shards, many blocks a tile, long chains and stars, long token runs."""

import base64
import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refinespark.llm import decontaminate, secrets, simhash, warc
from refinespark.llm.components import components


# --- WARC -----------------------------------------------------------------------------------------


def test_lookup_over_many_blocks_shards_and_archives(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 600)
    rng = random.Random(1)
    rows = [(i, f"http://h{rng.randrange(9)}.org/p{rng.randrange(12)}", f"body {rng.randrange(40)}") for i in range(250)]
    rows += [(1000 + i, "http://hot.org/one", f"hot {i}") for i in range(90)]  # one key fills blocks and shards
    rows += [(2000, None, None), (2001, "", ""), (2002, "HTTP://HOT.org/one", "upper"), (2003, "not a url", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = str(tmp_path / "w")
    warc.write_index(warc.write_archives(pages, f"{folder}/archives"), folder)
    assert warc.directory(spark, folder).count() > 60 and warc.directory(spark, folder).select("shard").distinct().count() > 4
    everything = sorted(r.page_id for r in warc.lookup(pages.select("url"), folder).collect())
    assert everything == sorted(i for i, _, _ in rows)
    by_key = {}
    for i, url, _ in rows:
        by_key.setdefault(warc.url_key(url), []).append(i)
    for url in ("http://hot.org/one", "http://h3.org/p5", None, "http://absent.org/", "zzz", "!"):
        asked = spark.createDataFrame([(url,)], "url string")
        assert sorted(r.page_id for r in warc.lookup(asked, folder).collect()) == sorted(by_key.get(warc.url_key(url), []))
    payloads = {r.page_id: r.payload for r in warc.read_records(warc.lookup(pages.select("url"), folder)).collect() if r.record_type == "response"}
    html = {i: (h or "").encode() for i, _, h in rows}
    assert payloads and all(bytes(p) == html[i] for i, p in payloads.items())


def test_revisits_only_of_payloads_of_min_bytes(spark, tmp_path):
    rows = [(3, "a", "long enough"), (1, "b", "long enough"), (2, "c", "short"), (4, "d", "short"), (5, "e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_index(warc.write_archives(pages, f"{folder}/archives", min_bytes=8), folder)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect()}
    assert got == {1: ("response", None), 3: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None)}


# --- SimHash --------------------------------------------------------------------------------------


def flat_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    return sorted(sorted(g) for g in groups.values())


def test_many_blocks_of_one_tile(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    monkeypatch.setattr(simhash, "PARTS", 3)
    rng = random.Random(2)
    fps = set()
    while len(fps) < 120:  # two bits a quarter: one tile, and neighbours that differ by one or two bits
        fps.add(sum(1 << (16 * q + b) for q in range(4) for b in rng.sample(range(4), 2)))
    while len(fps) < 160:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    assert simhash.blocks(distinct, 3).groupBy("tile").count().agg(F.max("count")).first()[0] > 10
    for radius in (0, 1, 2, 3):
        labels = {r.node: r.label for r in components(simhash.near_edges(distinct, radius)).collect()}
        groups = {}
        for i, f in enumerate(signed):
            groups.setdefault(labels.get(f, ("alone", f)), []).append(i)
        assert sorted(sorted(g) for g in groups.values()) == flat_components(fps, radius)


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(300)],  # a long path
    [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 700)],  # stars
    [(i, (i * 7 + 3) % 90) for i in range(90)] + [(4, 4)],
    [],
])
def test_components_of_paths_and_stars(spark, edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        root[find(a)] = find(b)
    shuffled = edges[:]
    random.Random(3).shuffle(shuffled)
    got = {r.node: r.label for r in components(spark.createDataFrame(shuffled, "a long, b long")).collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert set(got) == joined and all((got[a] == got[b]) == (find(a) == find(b)) for a in joined for b in list(joined)[:20])


def test_rows_of_rare_fingerprints_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(simhash, "COMMON", 1)  # no fingerprint is common
    rows = [(i, f"text number {i % 7} of a few that repeat") for i in range(40)] + [(None, "no id"), (50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rare = sorted(map(str, simhash.near_groups(docs).collect()))
    monkeypatch.setattr(simhash, "COMMON", 1_000)
    assert rare == sorted(map(str, simhash.near_groups(docs).collect())) and len(rare) == 42


# --- secrets and benchmark blocks -------------------------------------------------------------------


def b64(x):
    return base64.urlsafe_b64encode(x).rstrip(b"=")


def test_long_runs_of_header_starts_take_linear_time():
    payload = b64(b'{"sub":"1"}')
    for run in (b"eyJ" * 350_000, b"ey" * 500_000, b64(b'{"a' * 250_000), b64(b'{"a' * 250_000 + b"}"), b64(b'{"\xff' * 250_000)):
        text = run + b"." + payload + b".signature"
        start = time.process_time()
        assert secrets.token_spans(text, 0, len(text)) == []
        assert time.process_time() - start < 3


def test_a_header_is_found_at_every_place_of_a_part():
    header, payload = b64(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64(b'{"sub":"1"}')
    for before in (b"", b"a", b"ab", b"abc", b"eyJ", b"eyJeyJ", b"x" * 37, b64(b"\x00\xff{"), b64(b'{"alg')):
        text = before + header + b"." + payload + b".sig"
        assert secrets.token_spans(text, 0, len(text)) == [(len(before), len(text), "jwt")], before
    assert secrets.header_start(b"eyJ") is None and secrets.header_start(b"") is None
    deep = b64(b'{"a":' * 50_000)
    assert secrets.token_spans(deep + b"." + payload + b".s", 0, len(deep) + len(payload) + 3) == []


def test_benchmark_in_several_blocks(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs = [(i, " ".join([*(rng.choice(words) for _ in range(20)), rng.choice(items)[1], "tail"])) for i in range(50)] + [(99, None)]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bdf = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    one = sorted(map(str, decontaminate.find_benchmark(ddf, bdf).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2_000)
    assert decontaminate.write_patterns(bdf, "item_id", "text", decontaminate.WIDTH)[1] > 3
    assert sorted(map(str, decontaminate.find_benchmark(ddf, bdf).collect())) == one


def test_common_and_rare_copies_refer_to_the_least_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "COMMON", 5)  # a payload of more than a fifth of all pages is common
    monkeypatch.setattr(warc, "SPREAD", 8)
    rng = random.Random(9)
    pages = [(i, f"http://a.example/{i % 7}", rng.choice(["", None, "<p>common</p>", "<p>common</p>", f"<p>{rng.randrange(25)}</p>", f"<p>own {i}</p>"])) for i in range(300)]
    rng.shuffle(pages)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        kinds = warc.record_kinds(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), "page_id", "url", "html", 0)
        found = sorted((r.page_id, r.html, r.refers_to) for r in kinds.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    first = {}
    for i, _, html in sorted(pages, key=lambda x: x[0]):
        first.setdefault(html or "", i)
    assert found == sorted(((i, h or "", None if first[h or ""] == i else first[h or ""]) for i, _, h in pages), key=lambda x: x[0])

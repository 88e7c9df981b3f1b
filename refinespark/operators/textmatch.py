"""Exact substring join ``contains(doc, pattern)`` on keys and ids, without a cross product or texts in a shuffle.

Every pattern has one key: the hash of one of its ``GRAM``-character grams, or of the whole pattern if it is shorter.  A
document that holds the pattern holds that gram, so it has the key too.  Documents are scanned once; of their
grams only those pass that hit a filter of the patterns' keys, a bit array of fixed size, so what leaves the scan is about
as much as there is to find.  The pattern's gram is the one with the fewest documents by a first count of
such grams (document frequencies of the patterns' own grams), so a pattern with a common beginning is not looked up
by it.

Then (document id, key) meets (key, pattern id): ids and hashes only.  Texts join last, for documents and patterns that
met, and ``contains`` decides.  A key that very many documents hold is a pattern that very many documents hold,
or a gram that has no rarer neighbour in its pattern; skewed joins split such keys.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_arrow_limits, materialise

GRAM = 8
FILTER_BITS = 1 << 24             # 2 MiB; a longer list of keys only lets more grams pass
_BASE = np.uint64(1_000_003)


def _gram_hashes(text: str, n: int) -> np.ndarray:
    """A 64-bit hash of each n-character gram of a text; n is part of it."""
    cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(cp) < n:
        return np.zeros(0, np.int64)
    m = len(cp) - n + 1
    h = np.full(m, n, np.uint64)
    for j in range(n):  # mixing after every character: no colliding strings are known in advance
        h = (h ^ cp[j:j + m]) * _BASE
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h.view(np.int64)


def _pattern_grams(patterns: DataFrame, n: int) -> DataFrame:
    """(pid, size, key) of all grams of all patterns; a pattern shorter than n is one gram.  Empty and null ones have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    size = min(n, len(text))
                    keys = np.unique(_gram_hashes(text, size))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), pid), pa.int64()), pa.array(np.full(len(keys), size), pa.int32()), pa.array(keys)],
                                                     names=["pid", "size", "key"])
    return patterns.mapInArrow(run, "pid long, size int, key long")


def _filter(grams: DataFrame) -> tuple[list[int], np.ndarray]:
    """Gram sizes, and one bit for the hash of each key: at most ``FILTER_BITS`` / 64 numbers are collected."""
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # GRAM at most
    place = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = grams.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return sizes, bits.view(np.uint64)


def _document_keys(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(did, key): different grams of each document that pass the filter of ``grams``.  One narrow scan."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits = shared.value
        for b in batches:
            for did, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for size in sizes:
                    h = _gram_hashes(text or "", size)
                    at = (h & (FILTER_BITS - 1)).astype(np.uint64)
                    hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                    keys = np.unique(h[hit == 1])
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), did), pa.int64()), pa.array(keys)], names=["did", "key"])
    return docs.mapInArrow(run, "did long, key long")


def contains_join(docs: DataFrame, patterns: DataFrame, doc_text: str = "d_text", pat_text: str = "p_text", n: int = GRAM) -> DataFrame:
    """All (doc row, pattern row) pairs with ``contains(doc_text, pat_text)``.

    Null texts match nothing; an empty pattern is in every text that is not null.  Repeated rows pair like any others.
    """
    spark = docs.sparkSession
    ensure_arrow_limits(spark)
    # rows are known by numbers of their own, kept with the written tables
    d = materialise(docs.withColumn("_did", F.monotonically_increasing_id()), "docs")
    p = materialise(patterns.withColumn("_pid", F.monotonically_increasing_id()), "patterns")
    grams = materialise(_pattern_grams(p.select("_pid", pat_text), n), "grams")
    met = materialise(_document_keys(d.select("_did", doc_text), grams), "met")
    spread = met.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    # the pattern's rarest gram; a gram that no document holds rules the pattern out
    rarest = (grams.join(spread, "key", "left").groupBy("pid")
                   .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "key")).alias("r"))
                   .where("r.df > 0").select("pid", F.col("r.key").alias("key")))
    pairs = materialise(met.join(rarest, "key").select(F.col("did").alias("_d"), F.col("pid").alias("_p")), "pairs")
    found = (d.join(pairs, d["_did"] == pairs["_d"]).join(p, F.col("_p") == p["_pid"])
              .where(F.expr(f"contains({doc_text}, {pat_text})")).drop("_did", "_pid", "_d", "_p"))
    empty = p.where(F.col(pat_text) == "").drop("_pid")
    if empty.isEmpty():
        return found
    rows = empty.agg(F.collect_list(F.struct(*empty.columns))).scalar()  # one for each empty pattern
    both = d.where(F.col(doc_text).isNotNull()).drop("_did").withColumn("_e", F.explode(rows))
    return found.unionByName(both.select(*docs.columns, *[F.col(f"_e.{c}").alias(c) for c in patterns.columns]))

"""Encoders: text -> dense vector, in distributed batches.

Two built-in encoders need no model file:

* ``HashedEncoder`` - token counts hashed into ``dim`` buckets, L2-normalised;
* ``TfidfEncoder``  - the same counts times ``ln((n+1)/(df+1))`` fitted on a
  corpus, L2-normalised.

Tokenising is a Column expression; hashing and the bucket count per row
(``np.bincount`` over bounded steps of an Arrow batch) is a ``mapInArrow`` stage.  A user model plugs
in through ``BatchEncoder``: a factory called once per task that returns a
function from a list of texts to an (n, d) array, run with ``mapInPandas``.
"""

from __future__ import annotations

import hashlib
from array import array
from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import encoder_tokens, wrap
from ..functions.vectors import vec_sum
from ..session import materialise

DEFAULT_DIM = 1024
#: Counts (8 bytes each) that a task holds at a time.
STEP_CELLS = 1 << 18


def _token_buckets(tokens: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every token, tokens per row) for an Arrow list<string> batch.

    Tokens are dictionary-encoded in Arrow (C++), so md5 runs once per
    *distinct* token of the batch.
    """
    lens = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten()
    if len(flat) == 0:
        return np.zeros(0, np.int64), lens
    enc = pc.dictionary_encode(flat)
    uniq = enc.dictionary.to_pylist()
    hashed = np.fromiter((int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % dim for t in uniq),
                         dtype=np.int64, count=len(uniq))
    return hashed[enc.indices.to_numpy(zero_copy_only=False)], lens


def _bincounts(df: DataFrame, key: str, text_col: str, dim: int) -> DataFrame:
    """(key, _counts): tokens per bucket of every text, at most ``STEP_CELLS`` counts at a time whatever ``dim`` is."""
    step = max(1, STEP_CELLS // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, lens = _token_buckets(batch.column(1), dim)  # a token of the batch is hashed once
            ends = np.concatenate([[0], np.cumsum(lens)])
            for at in range(0, batch.num_rows, step):
                n = min(step, batch.num_rows - at)
                rows = np.repeat(np.arange(n, dtype=np.int64), lens[at : at + n])
                counts = np.bincount(rows * dim + buckets[ends[at] : ends[at + n]], minlength=n * dim).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists], names=[key, "_counts"])

    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_counts", T.ArrayType(T.DoubleType()))])
    return df.select(key, encoder_tokens(F.col(text_col)).alias("_tokens")).mapInArrow(run, kind)


def _buckets_udf(dim: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def buckets(tokens: pa.Array) -> pa.Array:
        b, lens = _token_buckets(tokens, dim)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(b.astype(np.int32)))
    # Marked nondeterministic only so Catalyst never copies the call into a
    # pushed-down filter (which would run the Python stage twice per row).
    return buckets.asNondeterministic()


def term_buckets(text, dim: int) -> Column:
    """Bucket index of every token: md5-based hash32(token) mod dim.

    Tokenising is a JVM regex; the hashing runs once per *distinct* token of
    an Arrow batch (Arrow dictionary encoding), not once per token.
    """
    return _buckets_udf(dim)(encoder_tokens(text))


def _norm(weights: Column) -> Column:
    return F.sqrt(F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x * x))


def _scaled(weights: Column, norm: Column) -> Column:
    return F.transform(weights, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm).cast("float"))


class HashedEncoder:
    """Hashed bag of words, L2-normalised; no tokens -> zero vector (see guard)."""

    def __init__(self, dim: int = DEFAULT_DIM):
        self.dim = dim
        self.name = f"hashed-{dim}"

    def weights(self, counts: Column) -> Column:
        return counts

    def encode(self, df: DataFrame, key: str, text_col: str, out: str = "vec") -> DataFrame:
        counted = self._with_params(_bincounts(df, key, text_col, self.dim))
        weighted = counted.select(key, self.weights(F.col("_counts")).alias("_w"))
        # the norm is its own column, so it is computed once per row, not once per element
        normed = weighted.select(key, "_w", _norm(F.col("_w")).alias("_n"))
        return normed.select(key, _scaled(F.col("_w"), F.col("_n")).alias(out))

    def _with_params(self, df: DataFrame) -> DataFrame:
        return df


class TfidfEncoder(HashedEncoder):
    """E5: hashed counts x idf fitted on a corpus; idf is a ``dim``-long array.

    Fitting is one distributed aggregate (document frequency per bucket) and
    the fitted weights reach every row as a scalar subquery, never a join.
    """

    def __init__(self, dim: int = DEFAULT_DIM):
        super().__init__(dim)
        self.name = f"tfidf-{dim}"
        self.idf: Column | None = None

    def fit(self, corpus: DataFrame, text_col: str = "text") -> "TfidfEncoder":
        docs = corpus.select(term_buckets(F.col(text_col), self.dim).alias("b")).select(
            F.array_distinct("b").alias("b"))
        n = corpus.agg(F.count(F.lit(1))).scalar()
        df_counts = docs.select(F.explode("b").alias("bucket")).groupBy("bucket").agg(
            F.count(F.lit(1)).alias("df"))
        all_buckets = corpus.sparkSession.range(self.dim).select(F.col("id").cast("int").alias("bucket"))
        idf = all_buckets.join(df_counts, "bucket", "left").select(
            "bucket", F.log((n + 1).cast("double") / (F.coalesce("df", F.lit(0)) + 1)).alias("w"))
        fitted = materialise(idf.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "w"))),
                                                 lambda x: x["w"]).alias("idf")), "idf")
        self.idf = fitted.scalar()
        # the weights are part of the name, so that what is stored under it belongs to this fit (``dim`` numbers)
        weights = array("d", fitted.first()[0]).tobytes()
        self.name = f"tfidf-{self.dim}-{hashlib.sha1(weights).hexdigest()[:16]}"
        return self

    def _with_params(self, df: DataFrame) -> DataFrame:
        if self.idf is None:
            raise ValueError("fit the encoder on a corpus first")
        # scalar subquery projected first: it may not sit inside a lambda
        return df.withColumn("_idf", self.idf)

    def weights(self, counts: Column) -> Column:
        return F.zip_with(counts, F.col("_idf"), lambda c, w: c * w)


class BatchEncoder:
    """User model: ``factory()`` -> fn(list[str]) -> array (n, d); one model per task."""

    def __init__(self, factory: Callable[[], Callable[[list[str]], np.ndarray]], name: str,
                 batch_rows: int = 64):
        self.factory = factory
        self.name = name
        self.batch_rows = batch_rows

    def encode(self, df: DataFrame, key: str, text_col: str, out: str = "vec") -> DataFrame:
        factory, batch_rows = self.factory, self.batch_rows
        key_type = df.schema[key].dataType.simpleString()

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = factory()
            for pdf in it:
                for start in range(0, len(pdf), batch_rows):
                    part = pdf.iloc[start:start + batch_rows]
                    mat = np.asarray(model(part[text_col].tolist()), dtype=np.float32)
                    yield pd.DataFrame({key: part[key].values, out: list(mat)})

        return df.select(key, text_col).mapInPandas(run, f"{key} {key_type}, {out} array<float>")


def encode_passages(df: DataFrame, key: str, text_col: str, encoder, out: str = "vec") -> DataFrame:
    """Every passage -> vector; raw text (not wrapped)."""
    return encoder.encode(df.select(key, text_col), key, text_col, out)


def encode_incremental(passages: DataFrame, existing: DataFrame, encoder, key: str = "pid",
                       text_col: str = "text", out: str = "vec") -> DataFrame:
    """Vectors of a grown corpus: keep the existing rows, encode only new keys, union by name.

    The anti-join on the key leaves unchanged passages untouched; a changed
    text under an old key is the caller's to drop from ``existing`` first.
    """
    new = passages.select(key, text_col).join(existing.select(key), key, "left_anti")
    return existing.select(key, out).unionByName(encoder.encode(new, key, text_col, out))


def encode_queries(df: DataFrame, key: str, text_col: str, encoder, wrap_markers: bool = True,
                   out: str = "vec") -> DataFrame:
    """Query text -> vector; served and refine queries are wrapped in markers."""
    q = df.select(key, (wrap(text_col) if wrap_markers else F.col(text_col)).alias(text_col))
    return encoder.encode(q, key, text_col, out)


def guard_zero_vector(df: DataFrame, vec_col: str = "vec", mode: str = "quarantine") -> DataFrame:
    """A query whose vector sums to 0 cannot be ranked.

    ``fail`` stops the job on the first such row; ``quarantine`` drops it
    (judged per query, unlike a sum over the whole query batch); ``flag``
    only adds the boolean column ``zero_vector``.
    """
    zero = vec_sum(vec_col) == 0
    if mode == "fail":
        return df.withColumn(vec_col, F.when(zero, F.raise_error(
            F.lit("query vector is zero: no known token"))).otherwise(F.col(vec_col)))
    if mode == "quarantine":
        return df.where(~zero)
    if mode == "flag":
        return df.withColumn("zero_vector", zero)
    raise ValueError(f"unknown mode {mode!r}")

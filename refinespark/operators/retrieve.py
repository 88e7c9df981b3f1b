"""Retrieval over tables: hits joined back to text and ground truth.

Hits are keys, never positions: every lookup is an equi-join on ``pid`` that deals the hits of popular
passages to many tasks (``with_passages``), and
the hit texts of one query are put in rank order with an ordered
``collect_list`` (partial on the map side, at most k rows per query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .encode import encode_passages, encode_queries, guard_zero_vector
from .exact import topk_exact_bulk

#: A passage with more than one in so many hits is popular (under ``POPULAR`` passages are); it is copied to ``COPIES`` keys.
POPULAR, COPIES = 1_000, 64


def search(query_vecs: DataFrame, passage_vecs: DataFrame, k: int = 1, metric: str = "ip",
           index=None, nprobe: int | None = None, dim: int | None = None) -> DataFrame:
    """Hits (qid, rk, pid, score) by exact block search, or by an IVF index when given (``nprobe`` None: bounded probing)."""
    if index is None:
        return topk_exact_bulk(query_vecs, passage_vecs, k=k, metric=metric, dim=dim)
    from .ann import ann_search_bulk
    return ann_search_bulk(query_vecs, index, k=k, nprobe=nprobe, metric=metric)


def with_passages(hits: DataFrame, passages: DataFrame, out: str = "text") -> DataFrame:
    """Hits (qid, pid, ...) with the text of their passage in ``out``; the hits are written first.

    Popular passages are few (bounded by ``POPULAR``), so their ids are broadcast; each gets ``COPIES`` keys, over which its
    hits are dealt by ``qid``.  All other passages have one key.
    """
    hits = materialise(hits, "hits")
    total = hits.count()  # of the written table: file footers
    popular = F.broadcast(hits.groupBy("pid").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * POPULAR > total).select(F.col("pid").alias("_pid")))
    is_popular = F.col("_pid").isNotNull()
    asked = hits.join(popular, F.col("pid") == F.col("_pid"), "left").withColumn(
        "_copy", F.when(is_popular, F.pmod(F.xxhash64("qid"), F.lit(COPIES)).cast("int")).otherwise(0)).drop("_pid")
    copies = F.sequence(F.lit(0), F.when(is_popular, COPIES - 1).otherwise(0))
    texts = passages.select("pid", F.col("text").alias(out)).join(popular, F.col("pid") == F.col("_pid"), "left").withColumn("_copy", F.explode(copies)).drop("_pid")
    return asked.join(texts, ["pid", "_copy"]).drop("_copy")


def join_context(hits: DataFrame, passages: DataFrame, sep: str = " ") -> DataFrame:
    """P5: (qid, context_id ARRAY<LONG>, context STRING) with hit texts in rank order."""
    h = with_passages(hits, passages)
    agg = h.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "pid", "text"))).alias("_h"))
    return agg.select("qid", F.transform("_h", lambda x: x["pid"]).alias("context_id"),
                      F.array_join(F.transform("_h", lambda x: x["text"]), sep).alias("context"))


def lookup_passage(hits: DataFrame, passages: DataFrame, out: str = "text") -> DataFrame:
    """Text of the top-1 hit per query -> (qid, pid, score, text)."""
    top = hits.where(F.col("rk") == 1).select("qid", "pid", "score")
    return with_passages(top, passages, out).select("qid", "pid", "score", out)


def retrieve_table(queries: DataFrame, passages: DataFrame, encoder, k: int = 1,
                   qkey: str = "qid", question: str = "q", wrap_markers: bool = False,
                   guard: str = "quarantine", index=None, nprobe: int | None = None,
                   passage_vecs: DataFrame | None = None) -> DataFrame:
    """Every input row plus ``retrieve`` = the k hit texts joined by a blank.

    All rows come back (an empty table gives an empty result); a query that
    cannot be encoded keeps its row with ``retrieve`` NULL.
    """
    qv = encode_queries(queries.select(F.col(qkey).alias("qid"), F.col(question).alias("q")), "qid", "q",
                        encoder, wrap_markers=wrap_markers)
    qv = guard_zero_vector(qv, "vec", guard)
    pv = passage_vecs if passage_vecs is not None else encode_passages(passages, "pid", "text", encoder)
    hits = search(qv, pv, k=k, index=index, nprobe=nprobe, dim=getattr(encoder, "dim", None))
    ctx = join_context(hits, passages).select(F.col("qid").alias(qkey), F.col("context").alias("retrieve"))
    return queries.join(ctx, qkey, "left")


def retrieve_table_ids(dataset: DataFrame, passages: DataFrame, encoder, k: int = 1,
                       guard: str = "quarantine", index=None, nprobe: int | None = None,
                       passage_vecs: DataFrame | None = None) -> DataFrame:
    """(id, question, context_id, context[, original_context, answers]).

    Ground truth is returned only when the input has both ``context`` and
    ``answers``; the check is made once on the schema.
    """
    qv = encode_queries(dataset.select(F.col("id").alias("qid"), F.col("question").alias("q")), "qid", "q",
                        encoder, wrap_markers=False)
    qv = guard_zero_vector(qv, "vec", guard)
    pv = passage_vecs if passage_vecs is not None else encode_passages(passages, "pid", "text", encoder)
    hits = search(qv, pv, k=k, index=index, nprobe=nprobe, dim=getattr(encoder, "dim", None))
    ctx = join_context(hits, passages).withColumnRenamed("qid", "id")
    cols = ["id", "question"]
    has_truth = "context" in dataset.columns and "answers" in dataset.columns
    if has_truth:
        base = dataset.select("id", "question", F.col("context").alias("original_context"), "answers")
    else:
        base = dataset.select(*cols)
    out = base.join(ctx, "id", "left")
    order = cols + ["context_id", "context"] + (["original_context", "answers"] if has_truth else [])
    return out.select(*order)


def search_passages(spark, text: str, passages: DataFrame, encoder, k: int = 10,
                    passage_vecs: DataFrame | None = None, index=None, nprobe: int | None = None) -> DataFrame:
    """One string -> ranked (rk, score, text) rows."""
    q = spark.createDataFrame([(0, text)], "qid long, q string")
    qv = guard_zero_vector(encode_queries(q, "qid", "q", encoder, wrap_markers=False), "vec", "fail")
    pv = passage_vecs if passage_vecs is not None else encode_passages(passages, "pid", "text", encoder)
    hits = search(qv, pv, k=k, index=index, nprobe=nprobe, dim=getattr(encoder, "dim", None))
    return hits.join(passages.select("pid", "text"), "pid").select("rk", "pid", "score", "text")

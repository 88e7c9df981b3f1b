"""In-batch retriever measures: logits, log-softmax, arg-max, loss, accuracy (V1-V6).

Row i of a batch is answer i scored against every question j of the same
batch (the answers play the query role).  Batches are built with an exact
size (B3/B4), so the self-join on ``batch_id`` pairs at most
batch_size x batch_size rows per batch and every window below is bounded by
the batch size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import SCORE_DECIMALS, dot


def inbatch_logits(batched: DataFrame, q_vec: str = "q_vec", a_vec: str = "a_vec",
                   dedup_key: str | None = None) -> DataFrame:
    """V1: (batch_id, i, j, logit) with logit = a_i . q_j (unrounded; round only to publish).

    ``dedup_key`` (e.g. a hash of the answer text): columns j != i whose key
    equals row i's are dropped, so a duplicate answer in the same batch is
    not counted as a wrong answer (off by default, like the original).
    """
    extra = [F.col(dedup_key).alias("_ka")] if dedup_key else []
    a = batched.select("batch_id", F.col("pos_in_batch").alias("i"), F.col(a_vec).alias("_a"), *extra)
    q = batched.select("batch_id", F.col("pos_in_batch").alias("j"), F.col(q_vec).alias("_q"),
                       *([F.col(dedup_key).alias("_kq")] if dedup_key else []))
    pairs = a.join(q, "batch_id")
    if dedup_key:
        pairs = pairs.where((F.col("i") == F.col("j")) | ~F.col("_ka").eqNullSafe(F.col("_kq")))
    return pairs.select("batch_id", "i", "j", dot("_a", "_q").alias("logit"))


def inbatch_log_softmax(logits: DataFrame) -> DataFrame:
    """V2: row-wise log-softmax, stable form s - m - ln(sum(exp(s - m)))."""
    w = Window.partitionBy("batch_id", "i")
    m = F.max("logit").over(w)
    shifted = logits.withColumn("_m", m)
    lse = F.log(F.sum(F.exp(F.col("logit") - F.col("_m"))).over(w))
    return shifted.withColumn("logp", F.col("logit") - F.col("_m") - lse).drop("_m")


def inbatch_predict(logits: DataFrame) -> DataFrame:
    """V3: best column per row (ties to the lower j) -> (batch_id, i, pred)."""
    w = Window.partitionBy("batch_id", "i").orderBy(F.col("logit").desc(), F.col("j").asc())
    return (logits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
                  .select("batch_id", "i", F.col("j").alias("pred")))


def inbatch_loss(logp: DataFrame) -> DataFrame:
    """V4: mean over the batch of -log p(i, i) -> (batch_id, loss, n)."""
    return (logp.where(F.col("i") == F.col("j")).groupBy("batch_id")
                .agg(F.avg(-F.col("logp")).alias("loss"), F.count(F.lit(1)).alias("n")))


def epoch_loss(batch_losses: DataFrame) -> DataFrame:
    """V5: unweighted mean of batch losses (a short last batch counts fully)."""
    return batch_losses.agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batches"))


def epoch_accuracy(preds: DataFrame) -> DataFrame:
    """V6: correct rows / all rows."""
    return preds.agg((F.sum(F.when(F.col("pred") == F.col("i"), 1).otherwise(0))
                      / F.count(F.lit(1))).alias("acc"))


def evaluate_batches(batched: DataFrame, q_vec: str = "q_vec", a_vec: str = "a_vec",
                     dedup_key: str | None = None) -> DataFrame:
    """V1-V6 together -> one row (loss, acc, batches), values rounded to publish."""
    logits = inbatch_logits(batched, q_vec, a_vec, dedup_key)
    logp = inbatch_log_softmax(logits)
    losses = epoch_loss(inbatch_loss(logp))
    acc = epoch_accuracy(inbatch_predict(logits)).select("acc").scalar()
    return losses.select(F.round("loss", SCORE_DECIMALS).alias("loss"),
                         F.round(acc, SCORE_DECIMALS).alias("acc"), "batches")

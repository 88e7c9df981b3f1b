"""The three chat modes as batch jobs over a table of utterances.

Each utterance is independent, so a whole table (or one stream micro-batch)
is answered with one bulk search instead of one corpus scan per line.  The
answers' vectors come from the store; ``serve`` opens them once for many calls.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_blank, wrap, refine_prompt
from ..operators.encode import HashedEncoder, guard_zero_vector
from ..operators.exact import topk_exact_bulk
from ..operators.generate import CopyGenerator, constrain_candidates, generate_batch
from ..operators.retrieve import lookup_passage
from ..session import materialise
from ..sources.stores import embedding_store

# The decoding numbers of the two chat modes (sampling by top_p happens inside a model).
CHAT_PARAMS = dict(max_length=128, min_length=0, num_beams=5, num_return_sequences=1)
REFINE_PARAMS = dict(max_length=36, min_length=5, num_beams=5, num_return_sequences=5)


def normalize_utterance(utts: DataFrame, text_col: str = "text", out: str = "prompt") -> DataFrame:
    """Strip Unicode blanks at both ends, then wrap in markers."""
    return utts.withColumn(out, wrap(strip_blank(F.col(text_col))))


@dataclass(frozen=True)
class Served:
    """The search side of the chat: answers (pid, text) and their stored vectors, opened once and used for many batches."""
    passages: DataFrame
    vectors: DataFrame


def serve(pairs: DataFrame, encoder) -> Served:
    """Open the answers of ``pairs``: vectors from the store; only answers that it lacks are encoded."""
    passages = pairs.select(F.col("pair_id").alias("pid"), F.col("a").alias("text"))
    return Served(passages, embedding_store(passages, encoder))


def _top1(utts: DataFrame, pairs: DataFrame | Served, encoder, guard: str) -> DataFrame:
    side = pairs if isinstance(pairs, Served) else serve(pairs, encoder)
    u = normalize_utterance(utts)
    qv = encoder.encode(u.select(F.col("utt_id").alias("qid"), "prompt"), "qid", "prompt")
    qv = guard_zero_vector(qv, "vec", guard)
    hits = topk_exact_bulk(qv, side.vectors, k=1, dim=getattr(encoder, "dim", None))
    top = lookup_passage(hits, side.passages, "reply")
    return u.join(top.withColumnRenamed("qid", "utt_id"), "utt_id", "left")


def chat_retriever(utts: DataFrame, pairs: DataFrame | Served, encoder=None, guard: str = "quarantine") -> DataFrame:
    """L4: reply = raw text of the top-1 answer -> (utt_id, pid, score, reply)."""
    encoder = encoder or HashedEncoder()
    return _top1(utts, pairs, encoder, guard).select("utt_id", "pid", "score", "reply")


def refine_prompts(top: DataFrame) -> DataFrame:
    """(qid, pid, prompt): utterance and retrieved answer; the utterance alone (null pid) where nothing was retrieved."""
    prompt = F.coalesce(refine_prompt(strip_blank(F.col("text")), F.col("reply")), F.col("prompt"))
    return top.select(F.col("utt_id").alias("qid"), "pid", prompt.alias("prompt"))


def _all_answered(asked: DataFrame, kept: DataFrame) -> DataFrame:
    """Every row of ``asked`` with its kept candidates; a query without any stays, with a reason."""
    cols = kept.select("qid", "cand", "reply", "reason")
    return asked.join(cols, "qid", "left").withColumn(
        "reason", F.when(F.col("cand").isNull(), "no_candidate").otherwise(F.col("reason")))


def chat_generator(utts: DataFrame, model=None, vocab: DataFrame | None = None, **params) -> DataFrame:
    """Reply generated from the wrapped utterance -> (utt_id, cand, reply, reason).

    Every utterance has a row; ``reason`` is null, the rule its fallback reply breaks, or
    ``no_candidate`` when the model gave none.
    """
    p = {**CHAT_PARAMS, **params}
    u = normalize_utterance(utts).select(F.col("utt_id").alias("qid"), "prompt")
    cands = generate_batch(u, model or CopyGenerator(), "prompt", p["num_beams"])
    kept = constrain_candidates(cands, vocab, min_length=p["min_length"], max_length=p["max_length"],
                                n_best=p["num_return_sequences"])
    return _all_answered(u.select("qid").distinct(), kept).select(F.col("qid").alias("utt_id"), "cand", "reply", "reason")


def chat_refine(utts: DataFrame, pairs: DataFrame | Served, encoder=None, model=None, guard: str = "quarantine",
                vocab: DataFrame | None = None, **params) -> DataFrame:
    """Candidates generated from utterance + retrieved answer (default mode).

    -> (utt_id, pid, prompt, cand, reply, reason); the reply is the generated
    tail after the prompt.  Every utterance has a row (``reason`` as in L5);
    one without tokens retrieves nothing and is prompted alone.
    """
    p = {**REFINE_PARAMS, **params}
    encoder = encoder or HashedEncoder()
    prompts = materialise(refine_prompts(_top1(utts, pairs, encoder, guard)))
    cands = generate_batch(prompts, model or CopyGenerator(), "prompt", p["num_beams"], cut_prompt=True)
    kept = constrain_candidates(cands, vocab, min_length=p["min_length"], max_length=p["max_length"],
                                n_best=p["num_return_sequences"])
    return _all_answered(prompts, kept).select(
        F.col("qid").alias("utt_id"), "pid", "prompt", "cand", "reply", "reason")


def chat(utts: DataFrame, pairs: DataFrame | Served, mode: str = "refine", **kw) -> DataFrame:
    """Mode choice; any value other than 'generator' or 'retriever' means refine."""
    if mode == "generator":
        return chat_generator(utts, **kw)
    if mode == "retriever":
        return chat_retriever(utts, pairs, **kw)
    return chat_refine(utts, pairs, **kw)

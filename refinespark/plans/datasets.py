"""Training-set builders and retriever evaluation.

Each builder is one lazy plan: tokenise with a corpus vocabulary, pad to the
longest row of the whole column (one scalar aggregate), mask.  The refine
builder draws its ~30 % rows with a seeded hash *before* retrieval, so only
the drawn questions are encoded and searched, in one bulk search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gold_prompt, refine_prompt, wrap
from ..operators.encode import encode_passages, encode_queries, guard_zero_vector
from ..operators.evaluate import evaluate_batches
from ..operators.exact import topk_exact_bulk
from ..operators.retrieve import lookup_passage
from ..operators.sampling import DEFAULT_SEED, bernoulli_mix, exact_split, shuffled_batches
from ..operators.vocab import attention_mask, encode_columns, encode_tokens, fits, labels_column, pad_columns
from ..session import materialise
from ..sources.stores import embedding_store


def _examples(df: DataFrame, columns: dict[str, tuple[str, str | None]], vocab: DataFrame) -> DataFrame:
    """(pair_id, ids and masks) of the text columns ({text column: (ids column, mask column or None)}).

    One pass makes the ids of all columns and writes them; one aggregate over what was written gives all maxima.
    """
    if fits(vocab):
        ids = encode_columns(df.select("pair_id", *columns), {c: out for c, (out, _) in columns.items()}, vocab).drop(*columns)
    else:
        ids = None
        for c, (out, _) in columns.items():
            part = encode_tokens(df, "pair_id", c, vocab, out=out)
            ids = part if ids is None else ids.join(part, "pair_id")
    return pad_columns(materialise(ids, "ids"), dict(columns.values()))


def generator_dataset(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """L2: wrapped question -> wrapped answer: (pair_id, input_ids, attention_mask, labels)."""
    p = pairs.select("pair_id", wrap("q").alias("wq"), wrap("a").alias("wa"))
    both = _examples(p, {"wq": ("input_ids", "attention_mask"), "wa": ("labels", None)}, vocab)
    return both.select("pair_id", "input_ids", "attention_mask", labels_column("labels").alias("labels"))


def dpr_dataset(pairs: DataFrame, vocab: DataFrame) -> DataFrame:
    """L3: raw question and raw answer, each tokenised, padded and masked on its own."""
    both = _examples(pairs, {"q": ("q_input_ids", "q_attention_mask"), "a": ("a_input_ids", "a_attention_mask")}, vocab)
    return both.select("pair_id", "q_input_ids", "q_attention_mask", "a_input_ids", "a_attention_mask")


def refine_prompts(pairs: DataFrame, encoder, p: float = 0.3, seed: int = DEFAULT_SEED,
                   corpus: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """(pair_id, prompt, retrieved_pid): gold prompt, or for drawn rows question + top-1 answer.

    The retrieval corpus is an argument (default: the answers of the same
    pairs) and hits carry keys, never positions; its vectors come from the store and are encoded
    only once.  ``exclude_self``: never the pair's own answer, so it needs the pairs' own corpus.
    """
    if exclude_self and corpus is not None:
        raise ValueError("exclude_self compares answers of the pairs themselves; it has no meaning for another corpus")
    corpus = corpus if corpus is not None else pairs.select(F.col("pair_id").alias("pid"), F.col("a").alias("text"))
    chosen = bernoulli_mix(pairs.select("pair_id", "q"), "pair_id", p, seed)
    qv = guard_zero_vector(encode_queries(chosen.select(F.col("pair_id").alias("qid"), "q"), "qid", "q", encoder,
                                          wrap_markers=True), "vec", "quarantine")
    pv = embedding_store(corpus, encoder)
    k = 2 if exclude_self else 1
    hits = topk_exact_bulk(qv, pv, k=k, dim=getattr(encoder, "dim", None))
    if exclude_self:
        hits = hits.where(F.col("qid") != F.col("pid"))
        hits = hits.withColumn("rk", F.row_number().over(Window.partitionBy("qid").orderBy("rk")))
    top = lookup_passage(hits, corpus, "retrieved").select(F.col("qid").alias("pair_id"),
                                                            F.col("pid").alias("retrieved_pid"), "retrieved")
    joined = pairs.join(top, "pair_id", "left")
    prompt = F.when(F.col("retrieved").isNotNull(), refine_prompt(F.col("q"), F.col("retrieved"))) \
              .otherwise(gold_prompt(F.col("q"), F.col("a")))
    return joined.select("pair_id", prompt.alias("prompt"), "retrieved_pid", wrap("a").alias("target"))


def refine_dataset(pairs: DataFrame, vocab: DataFrame, encoder, p: float = 0.3, seed: int = DEFAULT_SEED,
                   corpus: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """L1: (pair_id, input_ids, attention_mask, labels) of the retrieve-and-refine set."""
    prompts = refine_prompts(pairs, encoder, p, seed, corpus, exclude_self)
    return _examples(prompts, {"prompt": ("input_ids", "attention_mask"), "target": ("labels", None)}, vocab)


def evaluate_retriever(pairs: DataFrame, encoder, train_fraction: float = 0.8, batch_size: int = 20,
                       seed: int = DEFAULT_SEED, epoch: int = 0, dedup_in_batch: bool = False) -> DataFrame:
    """Held-out in-batch loss and accuracy -> one row (loss, acc, batches).

    ``dedup_in_batch``: a duplicate answer in the same batch is not scored as
    a wrong answer (off by default, as in the original).
    """
    split = exact_split(pairs.select("pair_id", "q", "a"), "pair_id", train_fraction, seed)
    # read three times below (two encoders, the batches): written once
    valid = materialise(split.where(F.col("split") == "valid").drop("split"), "valid")
    qv = encode_passages(valid, "pair_id", "q", encoder, out="q_vec")
    av = encode_passages(valid, "pair_id", "a", encoder, out="a_vec")
    batched = shuffled_batches(valid.select("pair_id", F.xxhash64("a").alias("a_key")), "pair_id", batch_size,
                               epoch, seed)
    return evaluate_batches(batched.join(qv, "pair_id").join(av, "pair_id"),
                            dedup_key="a_key" if dedup_in_batch else None)


__all__ = ["generator_dataset", "dpr_dataset", "refine_prompts", "refine_dataset", "evaluate_retriever",
           "attention_mask"]

"""Generation as batch scoring (G1) and decoding constraints as filters.

A model is supplied by the caller as a factory (called once per task) that
returns ``fn(prompts: list[str], n: int) -> list[list[tuple[str, float]]]``:
n (reply, score) candidates per prompt.  ``CopyGenerator`` is the built-in
stand-in used by tests and the default chat modes: it copies the last
marked segment of the prompt (the retrieved answer in the refine prompt).

The decoding rules of the original (minimum/maximum length, no repeated
bigram, a banned id sequence, n best) are applied after the fact: a reply is
cut at the maximum, and the other rules rank the candidates.  A query whose
candidates all break a rule keeps its best one, with the rule as ``reason``.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_tokens, vocab_tokens
from .vocab import PAD_ID, UNK_ID, encode_tokens

CAND_SCHEMA = "qid long, cand int, reply string, score double"
_SEGMENT = re.compile(r"<s>(.*?)</s>", re.S)


class CopyGenerator:
    """Candidates = the last marked segment (stripped), then its first line (stripped): two at most."""

    name = "copy"

    def __call__(self):
        def generate(prompts: list[str], n: int) -> list[list[tuple[str, float]]]:
            out = []
            for p in prompts:
                segs = _SEGMENT.findall(p or "")
                base = (segs[-1] if segs else (p or "")).strip()
                seen, cands = set(), []
                for c in (base, base.split("\n")[0]):
                    c = c.strip()
                    if c not in seen and len(cands) < n:
                        seen.add(c)
                        cands.append((c, float(-len(cands))))
                out.append(cands)
            return out
        return generate


class BatchGenerator:
    def __init__(self, factory: Callable[[], Callable], name: str, batch_rows: int = 16):
        self.factory, self.name, self.batch_rows = factory, name, batch_rows

    def __call__(self):
        return self.factory()


def generate_batch(prompts: DataFrame, model, prompt_col: str = "prompt", n: int = 5,
                   batch_rows: int = 16, cut_prompt: bool = False) -> DataFrame:
    """G1: (qid, prompt) -> (qid, cand INT, reply, score) with a model loaded once per task.

    ``cut_prompt``: a model that returns prompt and reply together gives the reply only.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = model()
        for pdf in it:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows]
                texts = part[prompt_col].tolist()
                rows = [(int(q), i, text[len(p):] if cut_prompt and p and text.startswith(p) else text, float(score))
                        for q, p, cands in zip(part["qid"].tolist(), texts, fn(texts, n))
                        for i, (text, score) in enumerate(cands)]
                yield pd.DataFrame(rows, columns=["qid", "cand", "reply", "score"])

    return prompts.select(F.col("qid").cast("long"), prompt_col).mapInPandas(run, CAND_SCHEMA)


def bigrams(tokens) -> Column:
    """Adjacent pairs of an array, as 'a b' strings."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.size(t)
    return F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))),
                      F.slice(t, 2, F.greatest(n - 1, F.lit(0))),
                      lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string")))


def no_repeated_ngram(tokens) -> Column:
    bg = bigrams(tokens)
    return F.size(F.array_distinct(bg)) == F.size(bg)


def has_sequence(ids, seq: tuple[int, int]) -> Column:
    return F.array_contains(bigrams(ids), f"{seq[0]} {seq[1]}")


def constrain_candidates(cands: DataFrame, vocab: DataFrame | None = None, min_length: int = 0,
                         max_length: int | None = None, n_best: int = 1,
                         banned: tuple[int, int] = (UNK_ID, PAD_ID)) -> DataFrame:
    """The n best candidates per query under the decoding rules -> candidates + ``reason``.

    Replies of more than ``max_length`` word tokens (not model ids) are cut
    after that token.  Candidates that break a rule (``min_length``, a
    repeated bigram, the banned two-id sequence unk then pad) are left out
    as long as another one passes; a query without any keeps its best
    candidate, and ``reason`` names the first rule it breaks (else null).
    The banned sequence is judged on vocabulary ids, which are looked up
    when a vocabulary is given or an ``ids`` column exists.  A null reply
    has no tokens.
    """
    c = cands.withColumn("_tok", F.coalesce(vocab_tokens("reply"), F.array().cast("array<string>")))
    if max_length is not None:
        c = c.withColumn("reply", F.when(F.size("_tok") > max_length, cut_tokens("reply", max_length)).otherwise(F.col("reply")))
        c = c.withColumn("_tok", F.slice("_tok", 1, max_length))
        if "ids" in c.columns:
            c = c.withColumn("ids", F.slice("ids", 1, max_length))
    reason = F.when(F.size("_tok") < min_length, "min_length").when(~no_repeated_ngram("_tok"), "repeated_bigram")
    if "ids" not in c.columns and vocab is not None:
        keyed = c.withColumn("_ck", F.struct("qid", "cand"))
        ids = encode_tokens(keyed.select("_ck", "reply"), "_ck", "reply", vocab, out="ids")
        c = keyed.join(ids, "_ck").drop("_ck")
    if "ids" in c.columns:
        reason = reason.when(has_sequence("ids", banned), "banned")
    c = c.withColumn("reason", reason)
    w = Window.partitionBy("qid").orderBy(F.col("reason").isNotNull(), F.col("score").desc(), F.col("cand").asc())
    kept = c.withColumn("_r", F.row_number().over(w)).where(
        (F.col("_r") <= n_best) & (F.col("reason").isNull() | (F.col("_r") == 1)))
    return kept.drop("_tok", "_r")

"""Quality rules: base counts and suffix-array repetition.

For every text a suffix array over its words is built (many texts at once, no suffix ever ties with one of
another text).  Longest-common-prefix values of neighbouring suffixes give, for every word position, the longest
passage from there that occurs elsewhere in the text; those of ``min_repeat`` words or more are the
maximal repeated substrings, whose spans are united.  A document is rejected by the base rule, when the united
spans cover more than ``max_covered`` of the characters in its words, or when the longest repeat exceeds ``max_longest`` words.

Null and empty texts have no words: counts zero, rejected by the base rule (fewer than ``min_words``).  Rows are
judged one by one: repeated rows get equal results, null ids, empty tables and extra columns change nothing.
Memory: a slice of ``STEP_BYTES`` of text, or one longer text, at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import SPACES, append_columns, flat, fresh_names, mix, per_row, starts_char, word_hashes, word_spans

#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: The method's limits.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.2, 50

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeat_lengths(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on occur at another place of the same text too.

    ``words``: hashes of all words; ``first``: n + 1 offsets of the texts.  Suffix array by prefix doubling
    (only groups that still tie are sorted again); the ranks kept at each power of two give the longest common
    prefix of two neighbours in as many steps.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[text + 1]
    _, inverse, counts = np.unique(words + mix(text.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    head = np.cumsum(counts) - counts
    rank = head[inverse]  # of the first of the group in suffix order
    ranks, width = [rank.astype(np.int32)], 1
    active = np.flatnonzero(counts[inverse] > 1)
    while len(active):
        nxt = active + width
        inside = nxt < end[active]
        second = np.where(inside, rank[np.minimum(nxt, n - 1)] + n, n - 1 - active)  # past the end: unique, in front
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        old = rank[active]
        fresh_old = np.empty(len(active), bool)
        fresh_old[0] = True
        fresh_old[1:] = old[1:] != old[:-1]
        fresh = fresh_old.copy()
        fresh[1:] |= second[1:] != second[:-1]
        place = np.arange(len(active))
        group = np.maximum.accumulate(np.where(fresh, place, 0))
        old_group = np.maximum.accumulate(np.where(fresh_old, place, 0))
        rank = rank.copy()
        rank[active] = old + group - old_group
        ranks.append(rank.astype(np.int32))
        width *= 2
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        active = active[tied]
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    pair = np.flatnonzero(ranks[0][suffix[1:]] == ranks[0][suffix[:-1]])
    a, b = suffix[pair], suffix[pair + 1]
    common = np.zeros(len(pair), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < n) & (y < n)
        same = inside & (ranks[level][np.minimum(x, n - 1)] == ranks[level][np.minimum(y, n - 1)])
        common[same] += 1 << level
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` places lies in one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """The counts of each text."""
    data, offs = flat(texts)
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first)
    in_word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(starts_char(data), out=in_word[1:])
    longest = repeat_lengths(word_hashes(data, starts, ends), first)
    chars = in_word[ends] - in_word[starts]
    at5, at_min = np.flatnonzero(longest >= WINDOW), np.flatnonzero(longest >= min_repeat)
    most = np.zeros(len(n_words), np.int64)
    if len(longest):
        full = np.flatnonzero(n_words)
        most[full] = np.maximum.reduceat(longest, first[full])
    raw = data.tobytes()
    return {
        "n_words": n_words,
        "word_chars": per_row(chars, first),
        "n_symbols": per_row(_IS_SYMBOL[data], offs),
        "n_dup_lines": np.array([repeated_lines(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.int64),
        "n_repeat_words": per_row(covered(at5, at5 + WINDOW, len(starts)), first),
        "covered_chars": per_row(chars * covered(at_min, at_min + longest[at_min], len(starts)), first),
        "longest_repeat": most,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")


def quality_measures(df: DataFrame, text_col: str = "text", out: str = "quality", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """``df`` plus a struct of the counts in ``COUNTS``."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = measure(texts, min_repeat)
        return [pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in COUNTS], names=list(COUNTS))]

    return append_columns(df, text_col, [T.StructField(out, kind)], compute)


def base_failed(q):
    return (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > MAX_REPEAT_PERCENT * q["n_words"])


def is_kept(q, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST):
    """The verdict from the struct of counts."""
    return ~base_failed(q) & (q["covered_chars"] <= max_covered * q["word_chars"]) & (q["longest_repeat"] <= max_longest)


def keep_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that pass, with the columns of ``df``."""
    name, = fresh_names(df, ["quality"])
    return quality_measures(df, text_col, name).filter(is_kept(F.col(name))).select(*df.columns)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality")
    base = (q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return quality_measures(docs).select("doc_id", *base, base_failed(q).alias("base_failed"), is_kept(q).alias("kept"))

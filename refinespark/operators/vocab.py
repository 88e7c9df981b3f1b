"""Vocabulary, token ids, padding and masks.

The pretrained sub-word tokenizers of the original cannot be had offline; the
vocabulary is built from the corpus as a Spark job instead.  Texts become ids in one narrow pass: tokens by a JVM
regular expression, ids by a lookup of the *different* tokens of an Arrow batch in a table that every worker
holds once.  The table is broadcast only when its bytes are under a bound (checked on the written vocabulary);
beyond it the relational form runs: explode -> join the vocabulary -> ordered ``collect_list``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import BOS, EOS, vocab_tokens
from ..session import materialise
from .sampling import ranked_by_ranges

# Special tokens and their ids.
PAD, UNK = "<pad>", "<unk>"
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
SPECIALS = [(PAD, PAD_ID), (UNK, UNK_ID), (BOS, BOS_ID), (EOS, EOS_ID)]
N_SPECIAL = len(SPECIALS)
VOCAB_BROADCAST_BYTES = 64 << 20
TOKEN_OVERHEAD = 64               # bytes that a token's entry takes besides its text


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def build_vocab(texts: DataFrame, text_col: str = "text", min_count: int = 1,
                max_size: int | None = None, materialised: bool = True) -> DataFrame:
    """(token, id INT, count LONG); specials first, then count desc, token asc.

    Words are ranked by sampled ranges of (count, token), so no window or task ever sees the whole vocabulary, and the many
    words of a low count spread like any others.  The result is
    written once to the shared folder (``materialised``): every builder
    reads it several times and it should not be re-derived from the corpus.
    """
    spark = texts.sparkSession
    toks = (texts.select(F.explode(vocab_tokens(text_col)).alias("token"))
                 .where(~F.col("token").isin(BOS, EOS)))
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= min_count)
    ranked = ranked_by_ranges(counts, [F.col("count").desc(), F.col("token").asc()], "_rk")
    words = ranked.select("token", (F.col("_rk") + (N_SPECIAL - 1)).cast("int").alias("id"), "count")
    if max_size is not None:
        words = words.where(F.col("id") < N_SPECIAL + max_size)
    specials = spark.createDataFrame(SPECIALS, "token string, id int").withColumn(
        "count", F.lit(None).cast("long"))
    vocab = specials.unionByName(words)
    return materialise(vocab) if materialised else vocab


def fits(vocab: DataFrame) -> bool:
    """Whether the vocabulary is under the broadcast bound, by its bytes."""
    row = vocab.agg(F.sum(F.octet_length("token") + TOKEN_OVERHEAD)).first()
    return (row[0] or 0) <= VOCAB_BROADCAST_BYTES


def _lists(flat: pa.Array, lens: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), flat)


def _list_lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ids_udf(vocab: DataFrame):
    """Tokens (ARRAY<STRING>) -> ids (ARRAY<INT>); a null array gives an empty one.  The table is looked up per different token."""
    known = vocab.sparkSession.sparkContext.broadcast(dict(vocab.select("token", "id").toArrow().to_pandas().itertuples(index=False, name=None)))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(tokens: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(tokens.flatten())
        table = np.array([known.value.get(t, UNK_ID) for t in coded.dictionary.to_pylist()], np.int32)
        return _lists(pa.array(table[coded.indices.to_numpy(zero_copy_only=False)], pa.int32()), _list_lengths(tokens))
    return ids


def encode_columns(df: DataFrame, columns: dict[str, str], vocab: DataFrame) -> DataFrame:
    """``df`` plus ids of several text columns ({text column: ids column}) in one pass; the vocabulary fits a broadcast."""
    ids = ids_udf(vocab)
    return df.select("*", *[ids(vocab_tokens(text)).alias(out) for text, out in columns.items()])


def encode_tokens(df: DataFrame, key: str, text_col: str, vocab: DataFrame,
                  out: str = "input_ids") -> DataFrame:
    """Text -> (key, ARRAY<INT> of vocabulary ids); unknown tokens -> <unk>.

    Rows whose text is null or has no token get an empty array.
    """
    if fits(vocab):
        return encode_columns(df.select(key, F.col(text_col).alias("_text")), {"_text": out}, vocab).select(key, out)
    return _encode_by_join(df, key, text_col, vocab, out)


def _encode_by_join(df: DataFrame, key: str, text_col: str, vocab: DataFrame, out: str) -> DataFrame:
    """The relational form, for a vocabulary of any size; rows are known by their key."""
    exploded = df.select(key, F.posexplode_outer(vocab_tokens(text_col)).alias("pos", "token"))
    joined = exploded.join(vocab.select("token", F.col("id").alias("_id")), "token", "left").select(
        key, "pos", F.when(F.col("pos").isNull(), None)
                     .otherwise(F.coalesce(F.col("_id"), F.lit(UNK_ID))).alias("tid"))
    grouped = joined.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "tid")))).alias("_p"))
    return grouped.select(key, F.transform("_p", lambda x: x["tid"]).cast("array<int>").alias(out))


def pad_to(ids, length, pad_id: int = PAD_ID) -> Column:
    ids = _c(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), length - F.size(ids))))


def pad_longest(df: DataFrame, ids_col: str, pad_id: int = PAD_ID, mask_col: str | None = None) -> DataFrame:
    """T3 (+T5): pad every row to the longest row of the whole column.

    The maximum is one global aggregate run as a scalar subquery; the ids are written first, so that no text is
    tokenised twice.
    """
    return pad_columns(materialise(df, "ids"), {ids_col: mask_col}, pad_id)


def pad_columns(df: DataFrame, columns: dict[str, str | None], pad_id: int = PAD_ID) -> DataFrame:
    """Pad several columns of a written table ({ids column: mask column or None}), each to its longest row."""
    longest = df.agg(*[F.max(F.size(c)).alias(c) for c in columns])
    out = df
    for c, mask_col in columns.items():
        m = longest.select(c).scalar()
        if mask_col:
            out = out.withColumn(mask_col, attention_mask(F.size(c), m))
        out = out.withColumn(c, pad_to(c, m, pad_id))
    return out


def pad_truncate(df: DataFrame, ids_col: str, max_len: int = 512, pad_id: int = PAD_ID,
                 mask_col: str | None = None) -> DataFrame:
    """T4 (+T5): cut to max_len, then pad to max_len."""
    cut = F.slice(F.col(ids_col), 1, max_len)
    out = df.withColumn(ids_col, cut)
    if mask_col:
        out = out.withColumn(mask_col, attention_mask(F.size(ids_col), F.lit(max_len)))
    return out.withColumn(ids_col, pad_to(ids_col, F.lit(max_len), pad_id))


def attention_mask(n_real, length) -> Column:
    """T5: 1 for real tokens, 0 for padding."""
    n_real = _c(n_real)
    return F.concat(F.array_repeat(F.lit(1), n_real),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(0), length - n_real)))


def token_type_ids(ids) -> Column:
    """Segment ids of a single-segment input: all zero."""
    return F.array_repeat(F.lit(0), F.size(_c(ids)))


def labels_column(ids, mask=None, mask_pad: int | None = None) -> Column:
    """labels = padded target ids; optionally padding -> mask_pad (e.g. -100)."""
    ids = _c(ids)
    if mask_pad is None or mask is None:
        return ids
    return F.zip_with(ids, _c(mask), lambda x, m: F.when(m == 1, x).otherwise(F.lit(mask_pad)))


def decode_tokens(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """Ids -> text, specials dropped, tokens joined by one blank; an unknown id gives <unk>."""
    if not fits(vocab):
        return _decode_by_join(df, key, ids_col, vocab, out)
    rows = vocab.select("id", "token").toArrow()
    words = np.full((pc.max(rows["id"]).as_py() or 0) + 2, UNK, object)
    words[rows["id"].to_numpy()] = rows["token"].to_pylist()
    known = vocab.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf(T.StringType())
    def text(ids: pa.Array) -> pa.Array:
        lens, flat = _list_lengths(ids), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        keep = flat >= N_SPECIAL
        kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(lens)])]
        table = known.value
        tokens = pa.array(table[np.minimum(flat[keep], len(table) - 1)], pa.string())
        return pc.binary_join(_lists(tokens, np.diff(kept)), " ")
    return df.select(key, text(F.col(ids_col)).alias(out))


def _decode_by_join(df: DataFrame, key: str, ids_col: str, vocab: DataFrame, out: str) -> DataFrame:
    exploded = df.select(key, F.posexplode(ids_col).alias("pos", "tid"))
    v = vocab.select(F.col("id").alias("tid"), "token")
    words = exploded.where(F.col("tid") >= N_SPECIAL).join(v, "tid", "left").select(
        key, "pos", F.coalesce("token", F.lit(UNK)).alias("token"))
    agg = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_w"))
    decoded = agg.select(key, F.array_join(F.transform("_w", lambda x: x["token"]), " ").alias(out))
    # rows with only specials decode to the empty string
    return df.select(key).join(decoded, key, "left").select(key, F.coalesce(out, F.lit("")).alias(out))


def answer_tail(ids, prompt_ids) -> Column:
    """Drop the prompt from the front of generated ids (cut by token count)."""
    ids = _c(ids)
    return F.slice(ids, F.size(_c(prompt_ids)) + 1, F.greatest(F.lit(0), F.size(ids) - F.size(_c(prompt_ids))))

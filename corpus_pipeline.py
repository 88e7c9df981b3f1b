"""Training-corpus pipeline over ``documents``: five operators in a row, each stage written before the next one.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.  All but the last return the
columns of ``docs``; the last adds the piece ids.  Rows with null or empty texts have no words, so the quality
rules drop them; repeated rows fall to the near-duplicate stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinespark.llm.common import fresh_names, written
from refinespark.llm.decontaminate import drop_contaminated
from refinespark.llm.pieces import decode, encode
from refinespark.llm.quality import keep_quality
from refinespark.llm.secrets import mask_secrets
from refinespark.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_quality(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; ``n_chars`` follows the text if there is such a column."""
    masked = mask_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the sampled piece ids of their text and their number; a text that they do not give back is an error."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    ids, n_tokens, back = fresh_names(docs, ["ids", "n_tokens", "decoded"])
    found = decode(written(encode(docs, model, "doc_id", out=ids), "pieces"), model, ids_col=ids, out=back)
    changed = F.raise_error(F.concat(F.lit("pieces do not give back the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return found.select(*docs.columns, ids, F.when(F.col(back).eqNullSafe(F.col("text")), F.size(ids)).otherwise(changed.cast("int")).cast("long").alias(n_tokens))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: SQL expresses neither fingerprints nor sampled segmentations; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Sources: pair tables, passage corpus, utterances and vectors.

Every reader selects only the columns it needs right at the scan, so the
Parquet ``ReadSchema`` holds just those (column pruning stops at a Python
stage, so it must be explicit before one).
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_arrow_limits, materialise

PAIR_DDL = "Q string, A string"


# Fixed values of ``turn_id``: turns below SHORT keep the short id; wide ids lie from 2^62 on, numbers of other turns below -2^62.
SHORT, WIDE_CONV, WIDE_TURN, OTHERS = 100, 1 << 32, 1 << 30, -(1 << 63)


def _forms(c: Column, t: Column) -> tuple[Column, Column]:
    """Whether (conversation, turn) has a short id, and whether it has a wide one if not."""
    short = (t >= 0) & (t < SHORT) & (c > -(1 << 55)) & (c < 1 << 55)  # |id| below 2^62
    return short, (t >= SHORT) & (t < WIDE_TURN) & (c >= 0) & (c < WIDE_CONV)


def turn_id(conv_id: str = "conv_id", turn: str = "turn") -> Column:
    """One id per (conv_id, turn): conv_id * 100 + turn below turn 100, else 2^62 + conv_id * 2^30 + turn.

    Both ranges are checked, so that no two turns share an id; a turn that fits neither raises an error.  Tables get ids
    for any turn by ``with_turn_id``; this form is for streams, which have no table to number.
    """
    c, t = F.col(conv_id).cast("long"), F.col(turn).cast("long")
    short, wide = _forms(c, t)
    return (F.when(c.isNull() | t.isNull(), F.lit(None).cast("long"))
            .when(short, c * SHORT + t).when(wide, F.lit(1 << 62) + c * WIDE_TURN + t)
            .otherwise(F.raise_error(F.concat_ws(" ", F.lit("no id for conversation and turn"), c, t)).cast("long")))


def with_turn_id(rows: DataFrame, conv: DataFrame, name: str) -> DataFrame:
    """``rows`` of the table ``conv`` with the id of their (conv_id, turn), whatever 64-bit numbers these are (null: no id).

    Turns that ``turn_id`` has no form for (hashed conversation ids, negative turns) are numbered in the order of
    (conv_id, turn) over the whole table: -2^63 + rank.  So every reader of one table gives a turn the same id.  Their rows meet
    the numbers by (conv_id, turn), a key of one row each; the other rows are not shuffled, and without such turns nothing is.
    """
    c, t = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    short, wide = _forms(c, t)
    fits = c.isNull() | t.isNull() | short | wide
    if not conv.agg(F.bool_or(~fits)).first()[0]:
        return rows.withColumn(name, turn_id())
    from ..operators.sampling import ranked_by_ranges
    others = conv.where(~fits).select(c.alias("_c"), t.alias("_t")).distinct()
    numbers = ranked_by_ranges(others, [F.col("_c"), F.col("_t")], "_n")
    found = rows.where(~fits).join(numbers, (c == F.col("_c")) & (t == F.col("_t")))
    found = found.withColumn(name, F.lit(OTHERS) + F.col("_n") - 1).drop("_c", "_t", "_n")
    return rows.where(fits).withColumn(name, turn_id()).union(found)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def with_position(df: DataFrame, name: str = "pair_id") -> DataFrame:
    """Dense 0..n-1 position in file order (S3 for a file without a key).

    ``monotonically_increasing_id`` is (partition << 33) + row within the
    partition: monotone in file order but not dense.  One small table of row
    counts per partition gives each partition its offset, so the position is
    dense without a single-partition window and without leaving the JVM.
    """
    mid = df.withColumn("_mid", F.monotonically_increasing_id())
    mid = mid.withColumn("_part", F.shiftright("_mid", 33)).withColumn(
        "_row", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = mid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("_part", (F.sum("_n").over(running) - F.col("_n")).alias("_off"))
    # one row per input partition: bounded by the partition count
    out = mid.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_off") + F.col("_row")).cast("long"))
    return out.drop("_mid", "_part", "_row", "_off")


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Question/answer CSV with header ``Q,A`` -> (pair_id, q, a): every record, empty fields as null.

    Quoted fields may hold line breaks and doubled quotes; a file is read by many tasks all the same
    (``quoted_csv``).  ``pair_id`` is the record's position in file order.  Literal ``NA`` or ``null`` stay text.
    """
    from .quoted_csv import csv_records
    parsed = csv_records(spark, path).select(F.col("position").alias("pair_id"), F.from_csv("text", F.lit(PAIR_DDL), {"multiLine": "true", "escape": '"'}).alias("r"))
    return parsed.select("pair_id", F.col("r.Q").alias("q"), F.col("r.A").alias("a"))


def read_pairs_csv(spark: SparkSession, path: str, drop_duplicate_answers: bool = False) -> DataFrame:
    """The records of ``read_csv_records`` that have both a q and an a (``corpus_profile`` of all records counts the others).

    ``drop_duplicate_answers`` keeps the first pair of each answer.
    """
    df = read_csv_records(spark, path).where(F.col("q").isNotNull() & F.col("a").isNotNull())
    if drop_duplicate_answers:  # present but disabled in the original builder
        first = df.groupBy("a").agg(F.min("pair_id").alias("pair_id"))
        df = df.join(first, ["pair_id", "a"]).select("pair_id", "q", "a")
    return df


def next_rows(conv: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, next_role, next_text): every turn with the one that follows it in its conversation.

    Turns are dealt by ranges of (conv_id, turn), so a conversation that holds a large share of all turns is spread over many
    tasks and gaps, repeats or nulls need no form of their own.  A task pairs neighbours in its range; the last turn of a
    range meets the first one of the next range in a table of border rows (two a task).  Null conversations are one
    conversation; turns without a number come last; equal numbers go by role and text.
    """
    spark = conv.sparkSession
    ensure_arrow_limits(spark)
    names = ["part", "border", "conv_id", "turn", "role", "text", "next_role", "next_text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None

        def row(kind: str | None, columns: list[pa.Array], follows: list[pa.Array]) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array([kind] * n, pa.string()), *columns, *follows], names=names)

        def none(n: int) -> list[pa.Array]:
            return [pa.nulls(n, pa.string())] * 2
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.cast(t) for c, t in zip(b.columns, kinds, strict=True)]
            if held is None:
                yield row("first", [c.slice(0, 1) for c in cols], none(1))  # a copy for the range before
            else:
                cols = [pa.concat_arrays([x, c]) for x, c in zip(held, cols, strict=True)]
            n = len(cols[0]) - 1
            if n:
                here, after = cols[0].slice(0, n), cols[0].slice(1)
                same = pc.or_(pc.fill_null(pc.equal(here, after), False), pc.and_(pc.is_null(here), pc.is_null(after)))
                at = pa.array(np.arange(1, n + 1), mask=~same.to_numpy(zero_copy_only=False))  # null where another conversation begins
                yield row(None, [c.slice(0, n) for c in cols], [cols[2].take(at), cols[3].take(at)])
            held = [c.slice(n) for c in cols]
        if held is not None:
            yield row("last", held, none(1))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_last("turn"), F.col("role"), F.col("text")]
    dealt = conv.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    schema = "part int, border string, conv_id long, turn long, role string, text string, next_role string, next_text string"
    found = materialise(dealt.mapInArrow(run, schema), "turns")
    by_part = Window.orderBy("part")  # a row a task
    firsts = found.where("border = 'first'").select("part", F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"))
    after = firsts.select(F.lag("part").over(by_part).alias("part"), "c", "r", "t")
    lasts = found.where("border = 'last'").drop("next_role", "next_text").join(after, "part", "left")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    crossing = lasts.select("conv_id", "turn", "role", "text", F.when(same, F.col("r")).alias("next_role"), F.when(same, F.col("t")).alias("next_text"))
    return found.where("border is null").select(*names[2:]).union(crossing)


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair fixture: a user turn followed at once by an assistant turn -> (pair_id, q, a)."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    t = next_rows(conv).where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    return with_turn_id(t, conv, "pair_id").select("pair_id", F.col("text").alias("q"), F.col("next_text").alias("a"))


def passages(pairs: DataFrame) -> DataFrame:
    """Passage corpus = answers keyed by their pair id (duplicates kept)."""
    return pairs.select(F.col("pair_id").alias("pid"), F.col("a").alias("text"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User lines as a bounded table (the stream form is in ``streaming``)."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return with_turn_id(conv.where(F.col("role") == "user"), conv, "utt_id").select("utt_id", "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved vectors (pid, vec)."""
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("pid"), F.col("embedding").alias("vec"))


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector 2i is the question, 2i+1 its answer, pair id i (equi-join, no pairs search)."""
    v = vectors(spark, sf_dir)
    q = v.where(F.col("pid") % 2 == 0).select((F.col("pid") / 2).cast("long").alias("pair_id"),
                                              F.col("vec").alias("q_vec"))
    a = v.where(F.col("pid") % 2 == 1).select(((F.col("pid") - 1) / 2).cast("long").alias("pair_id"),
                                              F.col("vec").alias("a_vec"))
    return q.join(a, "pair_id")


def corpus_profile(pairs: DataFrame) -> DataFrame:
    """Rows before and after loading, passages, distinct answers: one aggregate over the records as they were read."""
    return pairs.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(F.when(F.col("q").isNotNull() & F.col("a").isNotNull(), 1)).alias("rows_after"),
        F.count("a").alias("passages"),
        F.countDistinct("a").alias("distinct_answers"),
        F.countDistinct("q").alias("distinct_questions"),
    )


def truth_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query table with ground truth: benchmark items found verbatim in a document.

    (id, question, context = first such document text, answers = all of them, sorted).
    """
    from ..operators.textmatch import contains_join
    bench = read_table(spark, sf_dir, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("id"), F.col("text").alias("p_text"))
    docs = read_table(spark, sf_dir, "documents", "text").select(F.col("text").alias("d_text"))
    hits = contains_join(docs, bench)
    truth = (hits.groupBy("id", "p_text")
                 .agg(F.min("d_text").alias("context"), F.array_sort(F.collect_set("d_text")).alias("answers"))
                 .select("id", F.col("p_text").alias("question"), "context", "answers"))
    # a scan of the whole corpus stands behind it and callers read it twice: write it once
    return materialise(truth)

"""Records of quoted CSV files whose fields hold line breaks, read by many tasks per file.

Whether a line begins a record depends on one bit only: the parity of the quotes before it in its file (a doubled quote
inside a field counts twice).  So the files are read as plain lines, which split anywhere:

1. one scan counts quotes and record starts per split (a row a split: file, block start);
2. a prefix over the splits of a file gives each split the state it begins in, and the number of records before it;
3. a second scan cuts each split's lines into records.  A record that runs over the end of its split leaves
   an open piece there and closing pieces in the splits that follow; these few rows (two a split at most) meet by
   the split that owns the record.

Records keep their position in file order (files by name).  The first record of each file is its header.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_arrow_limits, materialise

# Kinds of the rows that a split gives.
WHOLE, OPEN, MIDDLE, CLOSE = 0, 1, 2, 3


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines in order; a carriage return stays part of its line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _split_counts(lines: DataFrame) -> DataFrame:
    """(file, block, quotes, odd0, odd1): parity of the split's quotes, and how many records start in it from either state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parity, starts = None, 0, [0, 0]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([parity], pa.int32()),
                                               pa.array([starts[0]], pa.int64()), pa.array([starts[1]], pa.int64())], names=["file", "block", "quotes", "starts0", "starts1"])
        for b in batches:
            for file, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (file, block):
                    if key is not None:
                        yield row()
                    key, parity, starts = (file, block), 0, [0, 0]
                starts[parity] += 1  # begins a record if the split began in this state
                parity ^= value.count('"') & 1
        if key is not None:
            yield row()
    return lines.mapInArrow(run, "file string, block long, quotes int, starts0 long, starts1 long")


def _states(counts: DataFrame) -> DataFrame:
    """(file, block, state, before): the parity that each split begins in, and the records that start in splits before it."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split of the file
    found = counts.withColumn("state", (F.coalesce(F.sum("quotes").over(order), F.lit(0)) % 2).cast("int"))
    found = found.withColumn("starts", F.when(F.col("state") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    return found.withColumn("before", F.coalesce(F.sum("starts").over(order), F.lit(0))).select("file", "block", "state", "starts", "before")


def _pieces(lines: DataFrame, states: DataFrame) -> DataFrame:
    """(file, block, seq, kind, text): records of each split, and the pieces of those that cross its borders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, seq, held, closing = None, 0, 0, [], False
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                                               pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string())], names=["file", "block", "seq", "kind", "text"])

        def finish() -> None:
            if held:  # the split ends inside a record
                out.append((*key, -1 if closing else seq, MIDDLE if closing else OPEN, "\n".join(held)))
        for b in batches:
            for file, block, state, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (file, block):
                    if key is not None:
                        finish()
                    key, odd, seq, held, closing = (file, block), state, 0, [], state == 1
                held.append(value)
                odd ^= value.count('"') & 1
                if not odd:
                    if closing:
                        out.append((*key, -1, CLOSE, "\n".join(held)))
                    else:
                        out.append((*key, seq, WHOLE, held[0] if len(held) == 1 else "\n".join(held)))
                        seq += 1
                    held, closing = [], False
            if out:
                yield batch()
                out = []
        if key is not None:
            finish()
        if out:
            yield batch()

    cols = lines.join(F.broadcast(states.select("file", "block", "state")), ["file", "block"])  # a row a split
    return cols.select("file", "block", "state", "value").mapInArrow(run, "file string, block long, seq long, kind int, text string")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, position, text): every record as text; ``place`` in its file, ``position`` over all files, headers left out.

    A quote that is never closed makes the rest of its file one record, as for any reader.  Empty lines are no records.
    """
    ensure_arrow_limits(spark)
    states = materialise(_states(materialise(_split_counts(_lines(spark, path)), "splits")), "states")
    pieces = materialise(_pieces(_lines(spark, path), states), "records")
    # border pieces: the owner is the last split before with an open record
    border = pieces.where(F.col("kind") != WHOLE)
    up_to = Window.partitionBy("file").orderBy("block", F.when(F.col("kind") == OPEN, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, 0)
    owner = F.when(F.col("kind") == OPEN, F.struct("block", "seq"))
    owned = border.withColumn("o", F.last(owner, ignorenulls=True).over(up_to))
    joined = (owned.groupBy("file", "o").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
                   .select("file", F.col("o.block").alias("block"), F.col("o.seq").alias("seq"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "block", "seq", "text").unionByName(joined)
    records = whole.join(F.broadcast(states.select("file", "block", "before")), ["file", "block"]).select("file", (F.col("before") + F.col("seq")).alias("place"), "text")
    records = records.withColumn("text", F.regexp_replace("text", "\r$", "")).where((F.col("text") != "") & (F.col("place") > 0))
    sizes = states.groupBy("file").agg(F.sum("starts").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    shifts = sizes.select("file", F.coalesce(F.sum(F.col("n") - 1).over(before), F.lit(0)).alias("shift"))
    return records.join(F.broadcast(shifts), "file").select("file", "place", (F.col("shift") + F.col("place") - 1).alias("position"), "text")

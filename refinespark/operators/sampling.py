"""Global rank, seeded draws, exact splits and batches.

A dense global order number without a single-partition window: in hash order, rows are put
in buckets of the top hash bits; one small table of bucket
counts gives each bucket its offset (prefix sum), and ``row_number`` runs
inside each bucket only.  The bucket table is the only thing ordered as a
whole, and its size is fixed by ``bucket_bits``.  In key order, where buckets may be as uneven as the keys, rows are
dealt by sampled ranges instead (``ranked_by_ranges``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash32
from ..session import materialise

DEFAULT_SEED = 42


def _key(seed: int, key: str, salt: str = "") -> Column:
    return hash32(F.concat(F.lit(f"{seed}:{salt}"), F.col(key).cast("string")))


def ranked_by_buckets(df: DataFrame, bucket: Column, order: list[Column], name: str = "rank",
                      with_total: bool = False) -> DataFrame:
    """Add a dense 1-based rank in (bucket asc, *order) order.

    ``bucket`` must be monotone in ``order``.  The offsets table has one row
    per bucket; it is joined back with a broadcast hint only because its size
    is bounded by the bucket expression (callers keep it in the thousands).
    """
    b = df.withColumn("_bk", bucket)
    counts = b.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [(F.sum("_n").over(running) - F.col("_n")).alias("_off"), "_bk"]
    if with_total:
        cols.append(F.sum("_n").over(Window.partitionBy()).alias("_total"))
    offsets = counts.select(*cols)
    rn = F.row_number().over(Window.partitionBy("_bk").orderBy(*order))
    out = b.join(F.broadcast(offsets), "_bk").withColumn(name, (F.col("_off") + rn).cast("long"))
    return out.drop("_bk", "_off")


def global_rank(df: DataFrame, key: str, seed: int = DEFAULT_SEED, name: str = "rank",
                bucket_bits: int = 12, salt: str = "", with_total: bool = False) -> DataFrame:
    """Dense rank in seeded-hash order (h, key); 2^bucket_bits buckets on the top hash bits."""
    h = _key(seed, key, salt)
    df = df.withColumn("_h", h)
    bucket = F.shiftright(F.col("_h"), 32 - bucket_bits)
    return ranked_by_buckets(df, bucket, [F.col("_h"), F.col(key)], name, with_total).drop("_h")


def ranked_by_ranges(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add a dense 1-based rank in the given order, whatever the distribution of the keys.

    Rows are dealt by sampled ranges of (*order, hash of the row, input place): an outlier key takes no more than its share, and one value that
    many rows have is cut by the hash, equal rows by their place.  The sorted rows are written; one count per
    partition (a row a task) gives each partition its offset.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_tie", F.xxhash64(*df.columns)).withColumn("_place", F.monotonically_increasing_id())
    keys = [*order, F.col("_tie"), F.col("_place")]
    dealt = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie", "_place")
    dealt = materialise(dealt.withColumn("_mid", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_mid", 33))
    counts = sorted(map(tuple, dealt.groupBy("_part").agg(F.count(F.lit(1))).collect()))  # a row a task
    offsets, total = [], 0
    for part, rows in counts:
        offsets.append((part, total))
        total += rows
    shift = df.sparkSession.createDataFrame(offsets, "_part long, _off long")
    row = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    out = dealt.join(F.broadcast(shift), "_part").withColumn(name, (F.col("_off") + row + 1).cast("long"))
    return out.drop("_part", "_mid", "_off")


def key_order_rank(df: DataFrame, key: str, name: str = "rank") -> DataFrame:
    """Dense rank in plain key order."""
    return ranked_by_ranges(df, [F.col(key)], name)


def bernoulli_mix(df: DataFrame, key: str, p: float = 0.3, seed: int = DEFAULT_SEED) -> DataFrame:
    """B1: keep each row with probability p, fixed by (seed, key) on any partitioning."""
    u = _key(seed, key) / F.lit(float(1 << 32))
    return df.where(u < F.lit(p))


def bernoulli_flag(df: DataFrame, key: str, p: float = 0.3, seed: int = DEFAULT_SEED,
                   name: str = "chosen") -> DataFrame:
    u = _key(seed, key) / F.lit(float(1 << 32))
    return df.withColumn(name, u < F.lit(p))


def exact_split(df: DataFrame, key: str, train_fraction: float = 0.8, seed: int = DEFAULT_SEED,
                name: str = "split") -> DataFrame:
    """B2: exactly int(n * fraction) rows are 'train', the rest 'valid'; random but seeded."""
    r = global_rank(df, key, seed, name="_rk", with_total=True)
    cut = F.floor(F.col("_total") * F.lit(train_fraction)).cast("long")
    return (r.withColumn(name, F.when(F.col("_rk") <= cut, F.lit("train")).otherwise(F.lit("valid")))
             .drop("_rk", "_total"))


def sequential_batches(df: DataFrame, key: str, batch_size: int, name: str = "batch_id") -> DataFrame:
    """Fixed-size batches in key order; the last one may be short."""
    r = key_order_rank(df, key, name="_rk")
    return (r.withColumn(name, F.floor((F.col("_rk") - 1) / F.lit(batch_size)).cast("long"))
             .withColumn("pos_in_batch", ((F.col("_rk") - 1) % F.lit(batch_size)).cast("long"))
             .drop("_rk"))


def shuffled_batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0,
                     seed: int = DEFAULT_SEED, name: str = "batch_id") -> DataFrame:
    """As B3 after a seeded shuffle; a new order per epoch."""
    r = global_rank(df, key, seed, name="_rk", salt=f"{epoch}:")
    return (r.withColumn(name, F.floor((F.col("_rk") - 1) / F.lit(batch_size)).cast("long"))
             .withColumn("pos_in_batch", ((F.col("_rk") - 1) % F.lit(batch_size)).cast("long"))
             .drop("_rk"))

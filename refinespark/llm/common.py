"""Shared helpers: Arrow row maps, vectorised words over UTF-8 bytes, files in the shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from refinespark.session import ARROW_MAX_BYTES, ensure_arrow_limits, shared_dir

#: Text bytes that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes and make the package importable in the workers."""
    ensure_arrow_limits(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if now > (8 << 20) or now == ARROW_MAX_BYTES:  # the retrieval library's own bound is smaller
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder (not yet created)."""
    return shared_dir(spark, "llm", f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, wanted: list[str]) -> list[str]:
    """``wanted`` with underscores in front until no column of ``df`` has the name (case-insensitive)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def release() -> None:
    """Give memory that nothing uses back to the system: a worker that is kept for later stages holds what it needs."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim  # GNU C library
except (AttributeError, OSError):
    _TRIM = None


# --- Arrow -----------------------------------------------------------------------------------


def as_binary(column: pa.Array) -> pa.Array:
    if pa.types.is_null(column.type):
        return pa.nulls(len(column), pa.binary())
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def steps(batch: pa.RecordBatch, at: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``limit`` bytes of column ``at`` (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and the n + 1 offsets of its rows (null: empty)."""
    column = as_binary(column)
    if column.null_count:
        column = pc.fill_null(column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField],
                   compute: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """All rows and columns of ``df`` plus ``fields``, which ``compute`` makes from slices of the text column.

    A narrow map: no shuffle, no key, so repeated, null and clashing ids do not matter.
    """
    prepare(df.sparkSession)
    at = df.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part.column(at))], names=names)

    return df.mapInArrow(run, schema)


# --- words over bytes ------------------------------------------------------------------------

#: The white space that separates words, \x20 and \x09-\x0D.
SPACES = b" \t\n\v\f\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


#: Powers of one base that a worker keeps at most (8 bytes each); longer tables are made anew for each use.
_KEPT_POWERS = 1 << 18


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; up to ``_KEPT_POWERS`` are kept per worker."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16, min(2 * len(have), _KEPT_POWERS) if have is not None else 0)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= _KEPT_POWERS:
            _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, offs: np.ndarray, is_sep: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the index of its first word (n + 1 values).

    A word is a longest run of bytes outside ``is_sep`` within one row.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~is_sep[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(word[:-1], out=first[1:])
    first[offs[offs < n]] = True
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(word[1:], out=last[:-1])
    last[offs[offs > 0] - 1] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial of byte values through one prefix sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_INVERSE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_ODD, len(data) + 1)[starts])


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes (len(words) - width + 1 values)."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    base = np.uint64((0xD1342543DE82EF95 + 2 * seed * 0x632BE59BD9B4E019) % (1 << 64) | 1)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    values = mix(words + np.uint64(seed)) if seed else words
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(inverse, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(base, n)[: n - width + 1])


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offs])


def starts_char(data: np.ndarray) -> np.ndarray:
    """Whether each UTF-8 byte begins a code point."""
    return (data & 0xC0) != 0x80


# --- files in the shared folder ----------------------------------------------------------------


def file_system(path: str):
    """pyarrow's file system of a path or URI in the shared folder, and the path on it (driver and workers)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_folder(path: str, columns: list[str]) -> pa.Table:
    """The Parquet files of a small folder in the shared folder (a worker's own read, one bounded part)."""
    import pyarrow.dataset as ds

    system, at = file_system(path)
    return ds.dataset(at, filesystem=system, format="parquet").to_table(columns=columns)

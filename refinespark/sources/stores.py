"""Materialised vectors and index as Parquet under the shared folder.

Nothing stored is ever overwritten.  A store is a folder of generations, each in a folder of its own name; one counts
once its last table is complete (Spark's ``_SUCCESS``), so a reader never sees a half-written generation, a
lost driver leaves an unread folder at most, and two writers at once do not disturb each other.  Only "not there" reads as
absent; any other error of the file system is raised.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ann import IvfIndex, build_index, open_index
from ..session import shared_dir


def _content(df: DataFrame, *cols: str) -> tuple[int, int, int]:
    """(rows, sum, exclusive-or) of 64-bit row hashes: equal for equal multisets of rows, whatever their order."""
    h = F.xxhash64(*[F.col(c) for c in cols])
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return int(row["n"]), int(row["s"] or 0), int(row["x"] or 0)


def fingerprint(df: DataFrame, *cols: str, params: str = "") -> str:
    return hashlib.sha1(f"{_content(df, *cols)}:{params}".encode()).hexdigest()[:16]


def complete_folders(spark: SparkSession, root: str, last: str = "") -> list[str]:
    """Folders in ``root``, in order of their names, whose table ``last`` (default: they themselves) is complete."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    top = path(root)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(top))
    return [f"{root}/{n}" for n in names if fs.exists(path(f"{root}/{n}/{last}/_SUCCESS" if last else f"{root}/{n}/_SUCCESS"))]


class VectorStore:
    """Append-only vectors of one encoder: ``append`` encodes what is new, ``read`` gives the vectors of a corpus.

    A row is known by its key and its text, so a changed text under an old key is encoded anew and never served stale;
    the encoder's name, fitted weights included, is part of the folder.  Each generation has a manifest row of its
    content; a corpus whose content is that of the whole store is read without a join.
    """

    def __init__(self, spark: SparkSession, encoder, name: str = "vectors", root: str | None = None):
        self.spark, self.encoder = spark, encoder
        self.root = root or shared_dir(spark, "stores", f"{name}-{encoder.name}")

    def generations(self) -> list[str]:
        return complete_folders(self.spark, self.root, "manifest")

    def _rows(self, kind: str, generations: list[str]) -> DataFrame:
        schema = f"key {kind}, text_hash long, vec array<float>"
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{g}/vectors" for g in generations]) if generations else self.spark.createDataFrame([], schema)

    @staticmethod
    def _keyed(passages: DataFrame, key: str, text: str) -> DataFrame:
        return passages.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))

    def append(self, passages: DataFrame, key: str = "pid", text: str = "text") -> int:
        """Encode and store the rows that the store does not have; how many these were."""
        rows = self._keyed(passages, key, text)
        kind = passages.schema[key].dataType.simpleString()
        old = self._rows(kind, self.generations()).select(F.col("key").alias("k"), F.col("text_hash").alias("h"))
        new = rows.join(old, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left_anti").dropDuplicates(["key", "text_hash"])
        # the row's identity rides through the encoder as its key
        coded = self.encoder.encode(new.select(F.struct("key", "text_hash").alias("row"), "text"), "row", "text")
        path = f"{self.root}/{len(self.generations()):06d}-{uuid.uuid4().hex}"
        coded.select("row.key", "row.text_hash", "vec").write.parquet(f"{path}/vectors")
        content = _content(self._rows(kind, [path]), "key", "text_hash")
        if content[0]:
            self.spark.createDataFrame([tuple(map(str, content))], "n string, s string, x string").coalesce(1).write.parquet(f"{path}/manifest")
        return content[0]

    def content(self) -> tuple[int, int, int]:
        """(rows, sum, exclusive-or) of the whole store, from the manifests (a row a generation)."""
        generations = self.generations()
        n = s = x = 0
        for row in self.spark.read.schema("n string, s string, x string").parquet(*[f"{g}/manifest" for g in generations]).collect() if generations else []:
            n, s, x = n + int(row["n"]), s + int(row["s"]), x ^ int(row["x"])
        return n, s, x

    def read(self, passages: DataFrame, key: str = "pid", text: str = "text") -> DataFrame:
        """(key, vec) of every row of ``passages``; rows that the store lacks are appended first."""
        kind = passages.schema[key].dataType.simpleString()
        rows = self._keyed(passages, key, text)
        content = _content(rows, "key", "text_hash")
        if content != self.content():
            self.append(passages, key, text)
        stored = self._rows(kind, self.generations())
        if content == self.content():
            return stored.select(F.col("key").alias(key), "vec")
        stored = stored.dropDuplicates(["key", "text_hash"])  # two writers may have stored one row
        found = rows.select(F.col("key").alias("k"), F.col("text_hash").alias("h")).join(
            stored, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
        return found.select(F.col("key").alias(key), "vec")


def embedding_store(passages: DataFrame, encoder, key: str = "pid", text: str = "text") -> DataFrame:
    """Vectors of a corpus: what is stored is read, what is new is encoded and stored."""
    return VectorStore(passages.sparkSession, encoder).read(passages, key, text)


def index_store(vectors: DataFrame, nlist: int = 16, bits: int = 8, iters: int = 2, seed: int = 42,
                method: str = "hash_sample") -> IvfIndex:
    """IVF index of a vector table: read if stored under the same content and parameters, else built and written."""
    spark = vectors.sparkSession
    fp = fingerprint(vectors, "pid", "vec", params=f"ivf:{nlist}:{bits}:{iters}:{seed}:{method}")
    root = shared_dir(spark, "stores", f"ivf-{fp}")
    found = complete_folders(spark, root, "centroids")
    if found:
        return open_index(spark, found[0], bits, nlist)
    return build_index(vectors, nlist, bits, iters, seed, method, path=f"{root}/{uuid.uuid4().hex}")

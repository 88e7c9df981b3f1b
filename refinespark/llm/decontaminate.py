"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, words of the fixed pattern, one space between and around them).  Every
window of ``width`` consecutive words of a benchmark text, or the whole text if it has fewer, is a pattern
``" w1 ... wn "`` of the automaton; each document is scanned once, and each occurrence is mapped back to word
numbers and to code points of the original text.

The patterns are written to the shared folder in blocks of about ``BLOCK_BYTES``, and a task holds the
automaton of one block at a time: one block is built once per worker; with more blocks a task reads
``GROUP_BYTES`` of text and takes the blocks in turn.  So memory does not depend on the size of the
benchmark, and nothing is collected or broadcast.

Null, empty and word-less texts: no words, no hits, on either side.  Benchmark rows with a null id mark words
but name no item.  Repeated benchmark rows and ids count once.  Documents are judged row by row: repeated rows,
null ids, empty tables and extra columns change nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import as_binary, file_system, fresh_names, new_folder, prepare, read_folder, starts_char, steps, word_spans

WIDTH = 10
BLOCK_BYTES = 2 << 20
GROUP_BYTES = 64 << 20

#: A word is [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
_IS_WORD = [b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 for b in range(256)]
IS_SEPARATOR = ~np.array(_IS_WORD)
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if _IS_WORD[b] else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def patterns(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Distinct (window, item) of all benchmark texts; ``item`` is the id as a string."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)).to_pylist(), strict=True):
                words = normal_words(text or b"")
                found = {b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))} if words else set()
                yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.binary()), pa.array([item] * len(found), pa.string())], names=["window", "item"])
    return (benchmark.select(F.col(id_col).cast("string"), F.col(text_col))
            .mapInArrow(run, "window binary, item string").distinct())


def write_patterns(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> tuple[str, int]:
    """Folder of the patterns, one sub-folder a block, and the number of blocks."""
    found = patterns(benchmark, id_col, text_col, width)
    folder = new_folder(benchmark.sparkSession, "patterns")
    found.write.parquet(f"{folder}/all")
    found = benchmark.sparkSession.read.schema(found.schema).parquet(f"{folder}/all")
    size = found.agg(F.sum(F.octet_length("window") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    if blocks:
        (found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)).cast("int"))
         .repartition("block").write.partitionBy("block").parquet(f"{folder}/blocks"))
    return f"{folder}/blocks", blocks


@functools.lru_cache(maxsize=1)
def automaton(folder: str, block: int):
    """The automaton of one block over texts read as Latin-1 of their UTF-8 bytes; None if the block is empty."""
    from pyarrow.fs import FileType

    path = f"{folder}/block={block}"
    system, at = file_system(path)
    if system.get_file_info(at).type == FileType.NotFound:
        return None
    table = read_folder(path, ["window", "item"])
    items: dict[bytes, set[str]] = {}
    for window, item in zip(table.column("window").to_pylist(), table.column("item").to_pylist(), strict=True):
        items.setdefault(window, set()).update([item] if item is not None else [])
    found = ahocorasick.Automaton()
    for window, names in items.items():
        found.add_word(window.decode("latin-1"), (len(window), window.count(b" ") - 1, tuple(names)))
    found.make_automaton()
    return found


class Hits:
    """Occurrences in one text: word ranges and items."""

    __slots__ = ("text", "words", "normal", "ranges", "items")

    def __init__(self, text: bytes):
        self.text = text
        words = normal_words(text)
        self.words, self.normal = len(words), (b" " + b" ".join(words) + b" ").decode("latin-1") if words else ""
        self.ranges: list[tuple[int, int]] = []
        self.items: set[str] = set()

    def scan(self, found) -> None:
        hits = [(end - size + 1, n, names) for end, (size, n, names) in found.iter(self.normal)] if self.normal else []
        if not hits:
            return
        spaces = np.flatnonzero(np.frombuffer(self.normal.encode("latin-1"), np.uint8) == 32)
        at = np.searchsorted(spaces, [x for x, _, _ in hits])
        self.ranges += [(int(a), int(a) + n) for a, (_, n, _) in zip(at, hits, strict=True)]
        for _, _, names in hits:
            self.items.update(names)

    def result(self) -> dict:
        merged: list[list[int]] = []
        for a, b in sorted(self.ranges):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        spans = []
        if merged:
            data = np.frombuffer(self.text, np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), IS_SEPARATOR)
            chars = np.concatenate([[0], np.cumsum(starts_char(data))])
            spans = [{"start": int(chars[starts[a]]), "end": int(chars[ends[b - 1]])} for a, b in merged]
        return {"n_words": self.words, "n_hit": sum(b - a for a, b in merged), "items": sorted(self.items), "spans": spans}


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
])
_ARROW_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                           ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def find_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                   out: str = "benchmark_hits", width: int = WIDTH) -> DataFrame:
    """``docs`` plus a struct: number of words, of words in an occurrence, sorted item ids, spans in code points."""
    prepare(docs.sparkSession)
    folder, blocks = write_patterns(benchmark, item_id_col, item_text_col, width)
    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields] + [T.StructField(out, RESULT)])
    names = schema.names

    def judged(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = [[Hits(x or b"") for x in as_binary(part.column(at)).to_pylist()] for part in parts]
        for block in range(blocks):
            if (found := automaton(folder, block)) is not None:
                for x in (x for rows in hits for x in rows):
                    x.scan(found)
        for part, rows in zip(parts, hits, strict=True):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.result() for x in rows], _ARROW_RESULT)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in steps(batch, at):
                held.append(part)
                size += part.column(at).nbytes
                if blocks < 2 or size >= GROUP_BYTES:
                    yield from judged(held)
                    held, size = [], 0
        yield from judged(held)

    return docs.mapInArrow(run, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` without any occurrence, with the columns of ``docs``."""
    name, = fresh_names(docs, ["benchmark_hits"])
    return find_benchmark(docs, benchmark, text_col, out=name, **options).filter(F.col(name)["n_hit"] == 0).select(*docs.columns)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    hits = F.col("benchmark_hits")
    return find_benchmark(docs, benchmark).select(
        "doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"), F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"), (hits["n_hit"] > 0).alias("contaminated"))

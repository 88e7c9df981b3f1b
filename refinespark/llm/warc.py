"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per page.  Of pages with equal payloads the one with the smallest id is a
``response``, the others are ``revisit`` records that refer to it (payloads of ``min_bytes`` or more; smaller ones
are all responses).  Each task writes files of its own and returns the place of every record; the table of these
captures is written to the shared folder and decides which files count, so lost executors cost a repeat only.

``write_index``: captures are sorted by reversed-host URL key over all tasks, and packed into compressed blocks of
``BLOCK_LINES`` lines in shard files.  The sparse directory has one row per block (its first key), in one
folder a shard; the shard table has one row per shard.  ``lookup`` finds a URL by two binary searches (shards,
then the blocks of that shard), reads the blocks by range, then the records by range.  A URL captured so
often that it fills many blocks or shards is found in all of them.

``read_archives`` reads all records back: the blocks by range, then the records of each archive in order of place.

Null html: empty payload.  Null url: the record has no target and the key is ``-``.  Null page id: written as
``null``, never referred to if another page has the payload; a group without any id has responses only.  Rows that
repeat id and payload are all responses or all revisits.  Extra columns are not carried.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinespark.llm.common import as_binary, file_system, new_folder, prepare, read_folder, steps, written

MIN_BYTES = 0
BLOCK_LINES = 1000
ARCHIVE_BYTES = 256 << 20
#: Bytes between two records up to which one read fetches both.
READ_BYTES = 4 << 20
#: A payload of more than one in so many pages is common (so under ``COMMON`` payloads are); its pages are dealt to ``SPREAD`` keys.
COMMON, SPREAD = 1_000, 1 << 20

#: Fixed values of the format.
VERSION, DATE = b"WARC/1.1", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "key string, page_id bigint, url string, file string, offset bigint, length bigint"
_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, ``)``, path and query, in lower case; ``-`` for none."""
    if not url:
        return "-"
    head, mark, rest = url.partition("://")
    try:
        parts = urlsplit("//" + rest if mark else "//" + head)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + ((parts.path or "/") + ("?" + parts.query if parts.query else "")).lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value on one line: other bytes than printable ASCII are percent-encoded."""
    return "".join(chr(b) if 32 < b < 127 else f"%{b:02X}" for b in text.encode())


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record.  ``size`` and ``digest`` are those of the full payload, which a revisit leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    name = "null" if page_id is None else page_id
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {_line(url)}"] if url else []
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says; a response's payload must have its digest."""
    head, body = data.split(b"\r\n\r\n", 1)
    version, *lines = head.split(b"\r\n")
    if version != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.decode().lower(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines)}
    body = body[: int(fields["content-length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    named = lambda field: None if fields[field][10:-1] == "null" else int(fields[field][10:-1])  # noqa: E731  <urn:page:N>
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if len(payload) != size or digest32(payload) != digest:
            raise ValueError(f"record {fields['warc-record-id']} is damaged")
        size, digest = len(payload), digest32(payload)
    return {"page_id": named("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": named("warc-refers-to") if kind == "revisit" else None, "url": fields.get("warc-target-uri"),
            "payload": payload if kind == "response" else None}


def gzip_member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Output:
    """A new file in the shared folder, written from front to back."""

    def __init__(self, folder: str, suffix: str):
        from pyspark import TaskContext

        self.path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
        system, at = file_system(self.path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self.out, self.place = system.open_output_stream(at, compression=None), 0

    def write(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.place += len(data)
        return self.place - len(data), len(data)


def record_kinds(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(page_id, url, html, refers_to): ``refers_to`` is null for responses.

    Only digests that occur twice or more are joined.  Common ones (under ``COMMON`` of them) are broadcast and their
    pages spread; what is left has no hot digest, and pages meet it from a written table whose size Spark knows.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", F.unhex(F.sha1("html")))
    large = F.octet_length("html") >= min_bytes
    twice = written(rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    hot = F.col("n") * COMMON > pages.count()
    common = twice.filter(hot).select("digest", F.col("first").alias("common_first"))
    others = twice.filter(~hot).select("digest", "first", F.lit(-1).alias("spread"))
    spread = F.when(F.col("common_first").isNull(), -1).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.lit(SPREAD)).cast("int"))
    joined = rows.join(F.broadcast(common), "digest", "left").withColumn("spread", spread).join(others, ["digest", "spread"], "left")
    first = F.coalesce("common_first", "first")
    return joined.select("page_id", "url", "html", F.when(large & ~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write a record for each page; the captures (``CAPTURE``)."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in steps(batch, 2):
                rows = []
                for page_id, url, html, refers_to in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_binary(part.column(2)).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if out is None or out.place >= ARCHIVE_BYTES:
                        if out is not None:
                            out.out.close()
                        out = Output(folder, ".warc.gz")
                    place, size = out.write(gzip_member(record(page_id, url, html, len(html), digest32(html), refers_to)))
                    rows.append({"key": url_key(url), "page_id": page_id, "url": url, "file": out.path, "offset": place, "length": size})
                yield pa.RecordBatch.from_pylist(rows, schema=_CAPTURE)
        if out is not None:
            out.out.close()

    return written(record_kinds(pages, id_col, url_col, html_col, min_bytes).mapInArrow(run, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> str:
    """Write shard files, directory and shard table of the captures below ``folder``; returns ``folder``."""
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, lines, first, last, rows = TaskContext.get().partitionId(), None, [], None, None, []

        def flush() -> None:
            nonlocal out, lines
            out = out or Output(f"{folder}/shards", ".cdx")
            place, size = out.write(zlib.compress("".join(lines).encode()))
            rows.append({"shard": shard, "first": first, "last": last, "file": out.path, "offset": place, "length": size})
            lines = []

        for batch in batches:
            for row in batch.to_pylist():
                first, last = row["key"] if not lines else first, row["key"]
                lines.append(json.dumps(list(row.values())) + "\n")
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.out.close()
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("file", pa.string()),
                                                                 ("offset", pa.int64()), ("length", pa.int64())]))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(n, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    kind = "shard int, first string, last string, file string, offset bigint, length bigint"
    ordered.mapInArrow(run, kind).write.partitionBy("shard").parquet(f"{folder}/directory")
    directory(spark, folder).groupBy("shard").agg(F.min("first").alias("first"), F.max("last").alias("last")).write.parquet(f"{folder}/bounds")
    return folder


def directory(spark, folder: str) -> DataFrame:
    return spark.read.schema("first string, last string, file string, offset bigint, length bigint, shard int").parquet(f"{folder}/directory")


class Ranges:
    """Range reads; the file read last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            system, at = file_system(path)
            self.path, self.file = path, system.open_input_file(at)
        self.file.seek(offset)
        return self.file.read(length)


def _block(ranges: Ranges, file: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(ranges.read(file, offset, length)).decode().splitlines()]


def _captures_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_CAPTURE.names, r, strict=True)) for r in rows], schema=_CAPTURE)


def indexed_captures(spark, folder: str) -> DataFrame:
    """All captures, read from the index blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for row in batch.to_pylist():
                yield _captures_batch(_block(ranges, row["file"], row["offset"], row["length"]))

    return directory(spark, folder).select("file", "offset", "length").mapInArrow(run, CAPTURE)


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read_records(captures: DataFrame) -> DataFrame:
    """The records of the captures: each archive in order of place, neighbouring records in one read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            places = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            while at < len(places):
                file, offset, _ = places[at]
                end = at
                while end < len(places) and places[end][0] == file and (end == at or places[end][1] + places[end][2] - offset <= READ_BYTES):
                    end += 1
                raw = ranges.read(file, offset, places[end - 1][1] + places[end - 1][2] - offset)
                yield pa.RecordBatch.from_pylist([parse(zlib.decompress(raw[a - offset : a - offset + n], 31)) for _, a, n in places[at:end]], schema=_RECORD)
                at = end

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return captures.select("file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def read_archives(spark, folder: str) -> DataFrame:
    """All records (``RECORD``) of the archives that the index in ``folder`` knows."""
    return read_records(indexed_captures(spark, folder))


def lookup(urls: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """Captures of each different URL key in ``urls``: (key, page_id, url, file, offset, length)."""
    spark = urls.sparkSession
    prepare(spark)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted(read_folder(f"{folder}/bounds", ["first", "last", "shard"]).to_pylist(), key=lambda r: (r["first"], r["shard"]))
        firsts = [r["first"] for r in table]
        for batch in batches:
            rows = []
            for key in map(url_key, batch.column(0).to_pylist()):
                k = bisect.bisect_right(firsts, key) - 1
                while k >= 0 and table[k]["last"] >= key:  # a key may fill several shards
                    rows.append((key, table[k]["shard"]))
                    k -= 1
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["key", "shard"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, held, table, firsts, out = Ranges(), None, [], [], []
        known: dict[int, dict[str, list]] = {}  # the captures by key of the blocks read last: keys come in order

        def block(k: int) -> dict[str, list]:
            if k not in known:
                while len(known) >= 2:
                    del known[min(known)]
                by_key: dict[str, list] = {}
                for row in _block(ranges, table[k]["file"], table[k]["offset"], table[k]["length"]):
                    by_key.setdefault(row[0], []).append(row)
                known[k] = by_key
            return known[k]

        for batch in batches:
            for key, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != held:
                    table = sorted(read_folder(f"{folder}/directory/shard={shard}", ["first", "last", "file", "offset", "length"]).to_pylist(), key=lambda r: r["offset"])
                    held, firsts = shard, [r["first"] for r in table]
                    known.clear()
                last = bisect.bisect_right(firsts, key) - 1
                k = last
                while k > 0 and table[k - 1]["last"] >= key:  # a key may fill several blocks
                    k -= 1
                for k in range(max(k, 0), last + 1):
                    out += block(k).get(key, [])
                    if len(out) >= BLOCK_LINES:
                        yield _captures_batch(out)
                        out = []
        if out:
            yield _captures_batch(out)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = written(urls.select(url_col).distinct().mapInArrow(shards, "key string, shard int").distinct(), "asked")
    return asked.repartitionByRange(n, "shard", "key").sortWithinPartitions("shard", "key").mapInArrow(blocks, CAPTURE)


def op3_warc_archives(spark, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, indexed, and read back: its capture found by URL through both binary searches."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    write_index(write_archives(pages, f"{folder}/archives"), folder)
    return read_records(lookup(pages.select("url"), folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

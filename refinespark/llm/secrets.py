"""Secret scan with structural confirmation.

Base kinds (patterns): ``assign`` (a named value), ``access`` (AKIA...), ``hex`` (a long lower-case run).
Confirmed kinds: base64 or hex candidates are decoded, and only those whose bytes parse are reported.  Consecutive
lines are joined, and a key may start inside a run (after a path or a name) and end inside one, as it holds its length:
``pem`` (an armoured private key), ``der`` (a private key in DER: every nested length must close exactly),
``openssh`` (openssh-key-v1 with its length-prefixed strings) and ``jwt`` (a signed token whose header is a
JSON object with ``alg`` and whose payload is a JSON object).

Null text: no spans.  Empty and white-space texts: no spans.  Rows are judged one by one, so repeated rows,
null ids, empty tables and extra columns change nothing.  Spans of one kind do not overlap; spans of two
kinds may.  Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import itertools
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import append_columns, flat, fresh_names, word_spans

#: Kinds in their order of output.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")
BASE_KINDS = KINDS[:3]

#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_NAMES = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Runs without white space of at least so many characters are searched for keys and signed tokens.
LEAST_CANDIDATE = 20
#: Digits or letters of one run, and what follows on the next lines.
_LINE = rb"(?:[ \t]*(?:\r\n|\n|\r)[ \t]*%b)*"
BASE64_CHARS, HEX_CHARS = rb"[A-Za-z0-9+/_-]+", rb"[0-9A-Fa-f]+"
BASE64_BLOCK = re.compile(BASE64_CHARS + _LINE % BASE64_CHARS)
HEX_BLOCK = re.compile(HEX_CHARS + _LINE % HEX_CHARS)
BASE64_RUN, HEX_RUN = re.compile(BASE64_CHARS), re.compile(HEX_CHARS)
#: Where a key can start: the first byte of DER with a short or long length, or the magic of OpenSSH.
BASE64_START = re.compile(rb"(?=M[A-I]|b3BlbnNzaC1rZXktdjEA)")
HEX_START = re.compile(rb"(?=30[0-8]|6[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)")
PADDING = re.compile(rb"={0,2}")
#: The bytes of the shortest key that ``is_private_der`` takes.
LEAST_KEY = 16
#: A token's three parts; its header can start where ``{`` does in base64.
TOKEN_RUN = re.compile(rb"[A-Za-z0-9_.-]+")
HEADER_START = re.compile(rb"(?=e[yw])")
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s:,.\\-]*?)-----END \1-----")

#: The head of a private key in DER: its length, then a version of 0 or 1, or the algorithm of an encrypted key.
_SIZE = rb"(?:[\x00-\x7f]|\x81.|\x82..|\x83...|\x84....)"
DER_HEAD = re.compile(rb"\x30(" + _SIZE + rb")(?:\x02(?:\x01|\x81\x01|\x82\x00\x01|\x83\x00\x00\x01|\x84\x00\x00\x00\x01)[\x00\x01]|\x30"
                      + _SIZE + rb"\x06)", re.S)
HEAD_BYTES = 18
OPENSSH_MAGIC = b"openssh-key-v1\0"

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _decode64(run: bytes) -> bytes | None:
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill ``data[at:end]`` exactly, or None."""
    items = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            size = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def is_private_der(data: bytes) -> bool:
    """An RSA, EC or PKCS#8 private key: one SEQUENCE that fills ``data``, with the items of such a key."""
    if len(data) < LEAST_KEY or data[0] != 0x30:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_items(data, outer[0][1], outer[0][2])
    if not inner:
        return False
    tags = [tag for tag, _, _ in inner]
    version = data[inner[0][1] : inner[0][2]]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # an encrypted PKCS#8 key
        algorithm = der_items(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[0] != 0x02 or version not in (b"\0", b"\1"):
        return False
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    if tags[1:2] == [0x04]:
        return True
    if tags[1:3] == [0x30, 0x04]:
        algorithm = der_items(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return len(tags) == 6 and set(tags) == {0x02}  # DSA


def openssh_size(read: Callable[[int, int], bytes], most: int) -> int | None:
    """Bytes of an openssh-key-v1 (cipher, kdf, kdf options, key count, public keys, private part) within ``most`` bytes."""
    if read(0, len(OPENSSH_MAGIC)) != OPENSSH_MAGIC:
        return None
    at, strings = len(OPENSSH_MAGIC), 3
    for _ in range(strings):
        if at + 4 > most:
            return None
        at += 4 + int.from_bytes(read(at, at + 4), "big")
    if at + 4 > most:
        return None
    keys = int.from_bytes(read(at, at + 4), "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    for _ in range(keys + 1):
        if at + 4 > most:
            return None
        at += 4 + int.from_bytes(read(at, at + 4), "big")
    return at if at <= most else None


def is_openssh(data: bytes) -> bool:
    """openssh-key-v1: cipher, kdf, kdf options, key count, public keys and the private part close exactly."""
    return openssh_size(lambda a, b: data[a:b], len(data)) == len(data)


def is_signed_token(run: bytes) -> bool:
    header, payload, _ = run.split(b".", 2)
    try:
        head, body = (json.loads(_decode64(x) or b"") for x in (header, payload))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


#: Characters that no JSON text holds as they are: control characters, and what stands for a broken byte.
_NOT_JSON = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff]")
#: How an object with a member begins.
_OBJECT = re.compile(r'\{[ \t\r\n]*"(?:[^"\\]|\\.)*"[ \t\r\n]*:', re.S)
_JSON = json.JSONDecoder()


def _ends(data: bytes) -> tuple[int, str]:
    """Where the longest end of ``data`` begins that is UTF-8 without control bytes, and that end."""
    text = data.decode("utf-8", "surrogateescape")
    last = -1
    for m in _NOT_JSON.finditer(text):
        last = m.start()
    clean = text[last + 1 :]
    return len(data) - len(clean.encode()), clean


def header_start(header: bytes) -> int | None:
    """Where a token's header begins in a part: the first place from which the rest decodes to an object with ``alg``.

    The part is decoded once for each of the four alignments, not once for each place; a place before bytes that no JSON text
    holds is passed over, as is one where no object begins, and a parse stops at the first error.
    """
    decoded: dict[int, tuple[int, str, bool]] = {}
    for m in itertools.chain([None], HEADER_START.finditer(header)):
        s = m.start() if m else 0
        if len(header) - s < 8:
            break
        turn = s % 4
        if turn not in decoded:
            data = _decode64(header[turn:])
            found = _ends(data) if data else (0, "")
            decoded[turn] = (*found, data.isascii()) if found[1].rstrip(" \t\r\n").endswith("}") else (1 << 62, "", True)
        clean, text, plain = decoded[turn]
        at = (s - turn) // 4 * 3 - clean
        if at < 0:
            continue
        if not plain:  # bytes to characters
            text, at = text.encode()[at:].decode("utf-8", "replace"), 0
        at += len(text[at : at + 64]) - len(text[at : at + 64].lstrip(" \t\r\n"))
        if not _OBJECT.match(text, at):
            continue
        try:
            head, end = _JSON.raw_decode(text, at)
        except (ValueError, RecursionError):
            continue
        if isinstance(head, dict) and isinstance(head.get("alg"), str) and not text[end:].strip(" \t\r\n"):
            return s
    return None


def _is_object(part: bytes) -> bool:
    try:
        return isinstance(json.loads(_decode64(part) or b""), dict)
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_private_der(data) else "openssh" if is_openssh(data) else None


def base_spans(text: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the base kinds."""
    found = []
    low = text.translate(_LOWER)
    if any(name in low for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found


def key_at(read: Callable[[int, int], bytes], most: int) -> tuple[str, int] | None:
    """Kind and bytes of the key that starts at byte 0 of ``read`` and has ``most`` bytes at most."""
    if m := DER_HEAD.match(read(0, min(HEAD_BYTES, most))):
        size = 1 + len(m[1]) + int.from_bytes(m[1] if len(m[1]) == 1 else m[1][1:], "big")
        if size <= most and is_private_der(read(0, size)):
            return "der", size
    return ("openssh", size) if (size := openssh_size(read, most)) else None


def _hex_bytes(block: bytes, start: int) -> Callable[[int, int], bytes]:
    return lambda a, b: bytes.fromhex(block[start + 2 * a : start + 2 * b].decode())


def _base64_bytes(block: bytes, start: int) -> Callable[[int, int], bytes]:
    def read(a: int, b: int) -> bytes:
        part = block[start + a // 3 * 4 : start + (b + 2) // 3 * 4]
        return (_decode64(part[:-1] if len(part) % 4 == 1 else part) or b"")[a % 3 : a % 3 + b - a]
    return read


def key_spans(text: bytes, runs: list[tuple[int, int]], armour: list[tuple[int, int, str]], run: re.Pattern, block: re.Pattern,
              starts: re.Pattern, reader: Callable[[bytes, int], Callable[[int, int], bytes]], bits: int) -> list[tuple[int, int, str]]:
    """Byte spans of the keys in blocks of digits (``bits`` a digit) that begin in ``runs``; lines are joined outside ``armour``."""
    found, done = [], 0
    for start, end in runs:
        while m := run.search(text, max(start, done), end):
            if not any(a <= m.start() < b for a, b, _ in armour):
                m = block.match(text, m.start())
            done = m.end()
            if (done - m.start()) * bits < 8 * LEAST_KEY:
                continue
            raw = np.frombuffer(text, np.uint8)[m.start() : done]
            place = np.flatnonzero((raw > 32))
            digits, at = raw[place].tobytes(), 0
            for s in starts.finditer(digits):
                left = (len(digits) - s.start()) * bits // 8
                if s.start() < at or left < LEAST_KEY or not (key := key_at(reader(digits, s.start()), left)):
                    continue
                at = s.start() + (8 * key[1] + bits - 1) // bits
                found.append((m.start() + int(place[s.start()]), m.start() + int(place[at - 1]) + 1, key[0]))
    return found


def token_spans(text: bytes, start: int, end: int) -> list[tuple[int, int, str]]:
    """Byte spans of the signed tokens in one run: the payload is a whole part, the header may start inside one."""
    found = []
    for m in TOKEN_RUN.finditer(text, start, end):
        parts = m[0].split(b".")
        at, done = m.start(), 0
        for header, payload, signature in zip(parts, parts[1:], parts[2:]):
            stop = at + len(header) + len(payload) + len(signature) + 2
            if at >= done and len(header) >= 8 and len(payload) >= 2 and signature and _is_object(payload):
                if (s := header_start(header)) is not None:
                    found.append((at + s, stop, "jwt"))
                    done = stop
            at += len(header) + 1
    return found


def run_spans(text: bytes, start: int, end: int) -> list[tuple[int, int, str]]:
    """Byte spans that lie in one run without white space: ``hex``, and signed tokens."""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text, start, end) if m.end() - m.start() >= LEAST_HEX]
    return found + token_spans(text, start, end) if text.count(b".", start, end) >= 2 else found


def armoured_spans(text: bytes) -> list[tuple[int, int, str]]:
    if b"PRIVATE KEY-----" not in text:
        return []
    found = []
    for m in PEM.finditer(text):
        body = m[2].replace(b"\\n", b"\n").replace(b"\\r", b"\n")
        lines = [x.strip() for x in body.split(b"\n") if b":" not in x]
        if (data := _decode64(b"".join(b"".join(lines).split()))) and (b"ENCRYPTED" in m[2] or _key_kind(data)):
            found.append((m.start(), m.end(), "pem"))
    return found


def find_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """All spans of a UTF-8 text in code points, by start, then kind; ``runs``: its long runs without white space."""
    armour = armoured_spans(text)
    found = base_spans(text) + armour
    for start, end in runs:
        found += run_spans(text, start, end)
    found += key_spans(text, runs, armour, HEX_RUN, HEX_BLOCK, HEX_START, _hex_bytes, 4)
    found += [(a, PADDING.match(text, b).end(), kind)
              for a, b, kind in key_spans(text, runs, armour, BASE64_RUN, BASE64_BLOCK, BASE64_START, _base64_bytes, 6)]
    if not found:
        return []
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return sorted({(int(chars[a]), int(chars[b]), kind) for a, b, kind in found}, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def column_spans(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """Spans of each text.  Long runs are found for all texts at once, so that the patterns see few bytes."""
    data, offs = flat(texts)
    starts, ends, first = word_spans(data, offs)
    long = np.flatnonzero(ends - starts >= LEAST_CANDIDATE)
    row = np.searchsorted(first, long, side="right") - 1
    runs: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(row.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        runs.setdefault(r, []).append((a - int(offs[r]), b - int(offs[r])))
    raw = data.tobytes()
    return [find_spans(raw[a:b], runs.get(i, [])) for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))]


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                      T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(df: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``df`` plus an array of (kind, start, end), by start, then kind as listed in ``KINDS``."""
    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in found] for found in column_spans(texts)], _ARROW_SPANS)]
    return append_columns(df, text_col, [T.StructField(out, SPAN_TYPE)], compute)


def mask_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``[secret]``."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for a, b, _ in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        parts += [text[at:a], "[secret]"]
        at = b
    return "".join([*parts, text[at:]])


def mask_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of ``text_col`` masked; other columns and all rows stay as they are."""
    masked, = fresh_names(df, ["masked"])

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([mask_text(t, found) if found else t for t, found in zip(texts.to_pylist(), column_spans(texts), strict=True)], pa.string())]

    return (append_columns(df, text_col, [T.StructField(masked, T.StringType())], compute)
            .withColumn(text_col, F.col(masked)).select(*df.columns))


def joined(kinds: tuple[str, ...] | None = None):
    """SQL-side digest: ``kind:start:end`` of the spans (of ``kinds`` only), comma-joined."""
    spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, all spans."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(docs).select("doc_id", *(count(k) for k in BASE_KINDS),
                                     F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"), joined().alias("spans"))


def base_digest(spans: list[tuple[int, int, str]]) -> str:
    """The digest of ``op9_secret_scan`` for one text, as plain Python (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE_KINDS).encode()).hexdigest()

"""Column expressions for text: markers, blanks, tokens, seeded hashes.

All are built-in Spark functions, so they stay inside whole-stage codegen
(the lambda ones run interpreted but still JVM-side).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Boundary markers used by every example builder and the chat path.
BOS = "<s>"
EOS = "</s>"

# Blank = Unicode White_Space (tab, newline, U+00A0, U+3000 ...), not only ' '.
_EDGE_BLANKS = r"(?U)^\s+|\s+$"
# A token is a marker or a maximal run of letters/digits.
_VOCAB_TOKEN = r"</?s>|[\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]+"
_MARKER = r"</?s>"
_CUT = "\u0001"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wrap(text, bos: str = BOS, eos: str = EOS) -> Column:
    """Bos + text + eos."""
    return F.concat(F.lit(bos), _c(text), F.lit(eos))


def strip_blank(text) -> Column:
    """P2 (first half): drop Unicode blanks at both ends; ``trim`` only drops spaces."""
    return F.regexp_replace(_c(text), _EDGE_BLANKS, "")


def gold_prompt(question, answer, bos: str = BOS, eos: str = EOS) -> Column:
    """Answer first, question second."""
    return F.concat(wrap(answer, bos, eos), wrap(question, bos, eos))


def refine_prompt(question, retrieved, bos: str = BOS, eos: str = EOS) -> Column:
    """Question first, retrieved answer second (reverse of P3)."""
    return F.concat(wrap(question, bos, eos), wrap(retrieved, bos, eos))


def vocab_tokens(text) -> Column:
    """Tokens for the vocabulary: markers kept whole, other text split to letter/digit runs."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(_VOCAB_TOKEN), 0)


def cut_tokens(text, n: int) -> Column:
    """The text up to the end of its n-th vocabulary token (U+0001, used as the cut mark, is removed)."""
    marked = F.regexp_replace(F.translate(_c(text), _CUT, ""), rf"(?i:{_MARKER})|{_WORD}", f"$0{_CUT}")
    return F.array_join(F.slice(F.split(marked, _CUT), 1, n), "")


def encoder_tokens(text) -> Column:
    """Tokens for the hashed encoders: markers removed first, so wrapped and raw text agree."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(_c(text), _MARKER, " ")), F.lit(_WORD), 0)


def hash32(s) -> Column:
    """First 32 bits of md5 as a non-negative BIGINT (same bits as DuckDB's md5)."""
    return F.conv(F.substring(F.md5(_c(s).cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded_unit(seed: int, key) -> Column:
    """Uniform draw in [0, 1) fixed by (seed, key): hash32('seed:key') / 2^32."""
    return hash32(F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))) / F.lit(float(1 << 32))

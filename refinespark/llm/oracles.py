"""DuckDB SQL of the operators on words, over whole tables (fixed patterns of the queries' contracts)."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"
_PLAIN_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _windows(source: str, key: str, size: str) -> str:
    """Rows (key, i, s) of all windows of ``size`` words of ``source`` (key, ws)."""
    return f"""select {key}, i, array_to_string(ws[i : i + {size} - 1], ' ') s
  from (select {key}, ws, unnest(range(1, len(ws) - {size} + 2)) i from {source} where len(ws) >= {size})"""


def _covered(hits: str, key: str, size: str) -> str:
    """Rows (key, w): words that the windows ``hits`` (key, i) cover."""
    return f"select distinct {key}, unnest(range(i, i + {size})) w from {hits}"


DECONTAMINATE = f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_PLAIN_WORD}) ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_PLAIN_WORD}) ws from benchmark),
long_ones as (select * from b where len(ws) >= 10),
wins as materialized (select distinct item_id, 10 n, s from ({_windows('long_ones', 'item_id', '10')})
  union select item_id, len(ws), array_to_string(ws, ' ') from b where len(ws) between 1 and 9),
sizes as (select distinct n from wins),
places as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') s from (
  select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, sizes where len(ws) >= n)),
hits as materialized (select p.doc_id, p.n, p.i, w.item_id from places p join wins w on w.n = p.n and w.s = p.s),
hit as (select doc_id, count(distinct w) n_hit from (select doc_id, unnest(range(i, i + n)) w from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) ids from (
  select distinct doc_id, item_id::varchar x from hits where item_id is not null) group by doc_id)
select d.doc_id, len(ws) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

SUBSTRINGS = f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) ws from documents),
wins as materialized ({_windows('d', 'doc_id', '50')}),
firsts as (select s, min(doc_id) f from wins group by s having count(distinct doc_id) > 1),
later as (select w.doc_id, w.i from wins w join firsts using (s) where f < w.doc_id),
gone as (select doc_id, list(w) g from ({_covered('later', 'doc_id', '50')}) group by doc_id)
select d.doc_id, len(ws) n_words, coalesce(len(g), 0) n_removed,
  sha256(case when g is null then array_to_string(ws, ' ') else (
    select coalesce(string_agg(ws[k], ' ' order by k), '') from (select unnest(range(1, len(ws) + 1)) k) where not list_contains(g, k)) end) kept_sha256
from d left join gone using (doc_id)"""


def _repeated(size: int) -> str:
    """Rows (doc_id, i): windows of ``size`` words that their text has twice or more."""
    return f"""select doc_id, i from (select *, count(*) over (partition by doc_id, s) n from ({_windows('d', 'doc_id', str(size))})) where n > 1"""


QUALITY = f"""with d as materialized (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), {_WORD}) ws from documents),
h5 as ({_repeated(5)}), h10 as ({_repeated(10)}),
c5 as (select doc_id, count(*) n from ({_covered('h5', 'doc_id', '5')}) group by doc_id),
c10 as (select c.doc_id, sum(length(ws[w])) n from ({_covered('h10', 'doc_id', '10')}) c join d using (doc_id) group by c.doc_id),
too_long as (select distinct doc_id from ({_repeated(51)})),
lines as (select doc_id, count(*) - count(distinct x) n from (select doc_id, unnest(string_split(t, chr(10))) x from d)
  where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by doc_id),
counts as (select d.doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    coalesce(lines.n, 0) n_dup_lines, coalesce(c5.n, 0)::bigint n_repeat_words, coalesce(c10.n, 0) covered, too_long.doc_id is not null long_repeat
  from d left join lines using (doc_id) left join c5 using (doc_id) left join c10 using (doc_id) left join too_long using (doc_id)),
judged as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from counts)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and covered <= 0.2 * word_chars and not long_repeat kept
from judged"""


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII string: DuckDB has none, so it goes byte by byte over the table of the polynomial 0xEDB88320."""
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(str(i))
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len({text}) + 1), lambda i: ord(({text})[i])::bigint)), "
            f"lambda a, b: xor(a >> 8, ([{','.join(table)}]::bigint[])[(xor(a, b) & 255) + 1])), 4294967295::bigint)")


ARCHIVES = """with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h, min(page_id) over (partition by coalesce(html, '')) f from pages)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || substr(h, 5 * (j // 4) + 1, 5))::bigint >> (15 - 5 * (j % 4))) & 31) + 1]), '') payload_digest,
  case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from p"""

# Islands of places i with w[i] = w[i + q] are the stretches of period q; the smallest of the periods of one stretch is its own, as a stretch
# four periods long has only multiples of it up to a quarter of its length.
RUNS = f"""with d as (select doc_id, ws, len(ws) n, {crc32('doc_id::varchar')} h from (
  select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) ws from documents)),
e as (select *, h // 10 % greatest(n, 1) a from d),
f as (select *, 1 + (n - a) // (3 + h // 10 % 8) p from e),
t as materialized (select doc_id, n, unnest(range(0, n)) i, unnest(case when h % 10 = 0 and n > 0
  then list_concat(ws[1 : a], list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1])) else ws end) x from f),
same as (select u.doc_id, u.i, v.i - u.i q from t u join t v on u.doc_id = v.doc_id and u.x = v.x and v.i > u.i and 4 * (v.i - u.i) <= u.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) k from same),
long_ones as (select doc_id, q, min(i) s, count(*) + q l from islands group by doc_id, q, k having count(*) + q >= greatest(6, 4 * q)),
runs as materialized (select doc_id, s, l, min(q) q from long_ones group by doc_id, s, l),
best as (select * from runs qualify row_number() over (partition by doc_id order by l / q desc, s, q) = 1),
per as (select doc_id, count(*) n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) lines from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) i from runs),
kept as (select doc_id, string_agg(x, ' ' order by i) words from t anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) n_runs, s "start", l length, q period, 1000 * l // q exponent_milli,
  sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(words, '')) collapsed_sha256
from d left join per using (doc_id) left join best using (doc_id) left join kept using (doc_id)"""

#: Fixed values of XXH64: its five primes.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _mod(x: str) -> str:
    return f"(({x}) & 18446744073709551615::uhugeint)"


def _times(x: str, k: int) -> str:
    return _mod(f"({x}) * {_PRIMES[k - 1]}::uhugeint")


def _turned(x: str, bits: int) -> str:
    return f"({_mod(f'({x}) << {bits}')} | (({x}) >> {64 - bits}))"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_mod(f"{acc} + {_times(lane, 2)}"), 31), 1)


def _number(hexes: str, first: str, size: int) -> str:
    """``size`` bytes from byte ``first`` (from 0) of a hex string, little-endian."""
    return "('0x' || " + " || ".join(f"substr({hexes}, 2 * ({first} + {k}) + 1, 2)" for k in reversed(range(size))) + ")::ubigint::uhugeint"


def _xxh64(source: str, seed: int) -> list[str]:
    """CTEs that end in ``hashed`` (s, h ubigint): the XXH64 of each string of ``source`` (s)."""
    starts = [(seed + _PRIMES[0] + _PRIMES[1]) % 2**64, (seed + _PRIMES[1]) % 2**64, seed, (seed - _PRIMES[0]) % 2**64]

    def fold(first: str, items: str, step: str) -> str:
        return f"list_reduce(list_prepend({first}, {items}), lambda a, b: {step})"
    accs = ", ".join(fold(f"{v}::uhugeint", f"lanes[{j} : n // 32 * 4 : 4]", _round("a", "b")) + f" v{j}" for j, v in enumerate(starts, 1))
    joined = _mod(" + ".join(_turned(f"v{j}", r) for j, r in zip(range(1, 5), (1, 7, 12, 18), strict=True)))
    merged = fold(joined, "[v1, v2, v3, v4]", _mod(f"{_times(f'xor(a, {_round('0::uhugeint', 'b')})', 1)} + {_PRIMES[3]}::uhugeint"))
    lane = _mod(f"{_times(_turned(f'xor(a, {_round('0::uhugeint', 'b')})', 27), 1)} + {_PRIMES[3]}::uhugeint")
    four = _mod(f"{_times(_turned(f'xor(h, {_times(_number('x', 'n // 8 * 8', 4), 1)})', 23), 2)} + {_PRIMES[2]}::uhugeint")
    one = _times(_turned(f"xor(a, {_times('b', 5)})", 11), 1)
    return [f"x0 as (select s, hex(encode(s)) x, strlen(s) n from {source})",
            f"x1 as (select *, list_transform(range(0, n // 8), lambda k: {_number('x', '8 * k', 8)}) lanes from x0)",
            f"x2 as (select *, {accs} from x1)",
            f"x3 as (select s, x, n, lanes, {_mod(f'case when n >= 32 then {merged} else {(seed + _PRIMES[4]) % 2**64}::uhugeint end + n::uhugeint')} h from x2)",
            f"x4 as (select s, x, n, {fold('h', 'lanes[n // 32 * 4 + 1 :]', lane)} h from x3)",
            f"x5 as (select s, x, n, case when n % 8 >= 4 then {four} else h end h from x4)",
            f"x6 as (select s, {fold('h', f'list_transform(range(n // 4 * 4, n), lambda k: {_number('x', 'k', 1)})', one)} h from x5)",
            f"x7 as (select s, {_times('xor(h, h >> 33)', 2)} h from x6)",
            f"x8 as (select s, {_times('xor(h, h >> 29)', 3)} h from x7)",
            "hashed as materialized (select s, xor(h, h >> 32)::ubigint h from x8)"]


_BITS = " | ".join(f"(case when 2 * sum((h >> {k}) & 1) > count(*) then {1 << k}::ubigint else 0::ubigint end)" for k in range(64))
SIMHASH = f"""with recursive d as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) ws from documents),
sh as materialized (select doc_id, array_to_string(ws[i : i + 2], ' ') s from (
  select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) i from d where len(ws) > 0)),
strings as (select distinct s from sh),
{(',' + chr(10)).join(_xxh64('strings', 42))},
prints as (select doc_id, {_BITS} f from sh join hashed using (s) group by doc_id),
every as materialized (select doc_id, coalesce(f, 0::ubigint) f from d left join prints using (doc_id)),
nodes as materialized (select f, min(doc_id) r from every group by f),
links as materialized (select a.f x, b.f y from nodes a join nodes b on a.f <> b.f and bit_count(xor(a.f, b.f)) <= 3),
reach as (select f, r from nodes union select l.y, reach.r from reach join links l on l.x = reach.f),
named as (select f, min(r) component_id from reach group by f)
select doc_id, lpad(lower(to_hex(f)), 16, '0') fingerprint, component_id from every join named using (f)"""

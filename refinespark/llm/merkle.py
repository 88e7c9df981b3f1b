"""Merkle manifest of a table as a persistent tree: proofs, and a version of the tree for every changed row.

A leaf is the SHA-256 of a row's fields, each ``byte count:value`` or ``-`` if null.  Rows of a group are in order of
their id; every ``FAN`` consecutive nodes of a level have one parent until one node, the group's sub-root, remains.
The sub-roots, in order of the group (null first), make a tree of their own whose top is the root.

The tree is held in aligned blocks of ``FAN ** DEPTH`` consecutive nodes, one row a block, so a block is built in
one task whatever the size of its group; the tops of all blocks are the nodes of the next, smaller stage, and so on
(one stage more for every factor ``FAN ** DEPTH`` of the largest group).  A changed leaf makes a version by path
copying: the block copies the leaf's ancestors and shares every other node; the copied top goes on through
the blocks of the upper stages, whose untouched siblings reach it as the block's path (a few hundred bytes a level).

Places in a group come from one range shuffle of digests, not of texts: partitions are counted, the counts are
summed, so neither a group nor the table is ever in one task.  Nothing is collected but the size of the largest group.

Null ids come first and repeated ids follow each other in order of their leaf; rows equal in every field are equal
leaves at neighbouring places, so each row has a proof of its own.  Null groups are a group.  An empty table has no
rows and no root.  Extra columns are not part of a leaf and change nothing.  Long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refinespark.llm import oracles
from refinespark.llm.common import prepare, written

FAN, DEPTH = 8, 4

#: One level of a proof: digests to the left and to the right of the node, end to end as hex text.
PATH = "array<struct<left:string,right:string>>"


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


class Block:
    """The levels of an aligned block over the digests of its nodes."""

    def __init__(self, nodes: list[str], height: int, fan: int = FAN):
        self.fan, self.levels = fan, [nodes]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([parent(below[i : i + fan]) for i in range(0, len(below), fan)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def path(self, place: int) -> list[tuple[str, str]]:
        """The siblings of the node and of its ancestors, left and right of each, from below."""
        found = []
        for level in self.levels[:-1]:
            first = place - place % self.fan
            found.append(("".join(level[first:place]), "".join(level[place + 1 : first + self.fan])))
            place //= self.fan
        return found

    def version(self, place: int, node: str) -> list[str]:
        """Path copying: ``node`` in place of another and the copied ancestors up to the new top; all else is shared."""
        copied = [node]
        for level in self.levels[:-1]:
            first = place - place % self.fan
            run = level[first : first + self.fan]
            run[place - first] = copied[-1]
            copied.append(parent(run))
            place //= self.fan
        return copied


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The top that ``node`` has under the siblings of ``path``."""
    for left, right in path:
        node = parent([left, node, right])
    return node


def height(total: int, fan: int = FAN, depth: int = DEPTH) -> int:
    """Levels that a block of a group of ``total`` nodes has: all if the group is one block."""
    levels, size = 0, 1
    while size < total and levels < depth:
        levels, size = levels + 1, size * fan
    return levels


# --- leaves and places ---------------------------------------------------------------------------


def leaf(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields: ``-`` for null, else UTF-8 byte count, a colon and the value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def placed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``place`` in their group (from 0, by ``order``), and the groups with their ``total``.

    Rows are dealt by ranges of (group, order) and written; their places inside a file are counted a file and group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.asc_nulls_first(group), *(F.asc_nulls_first(c) for c in order)]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt, "ordered").withColumn("part", F.shiftright("at", 33))
    counts = written(dealt.groupBy("part", group).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("rows")), "counts")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file of the group
    shift = counts.select(F.col("part").alias("p"), F.col(group).alias("g"),
                          (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("least")).alias("shift"))
    found = dealt.join(shift, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    found = found.withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "p", "g", "shift")
    return found, counts.groupBy(group).agg(F.sum("rows").alias("total"))


# --- blocks --------------------------------------------------------------------------------------


def packed(nodes: DataFrame, extra: list[str], fan: int, depth: int) -> DataFrame:
    """(grp, block, total, nodes): nodes (grp, total, place, digest and ``extra``) of aligned blocks, in order."""
    size = fan**depth
    row = F.struct("place", "digest", *extra)
    return (nodes.groupBy("grp", F.expr(f"place div {size}").alias("block"))
            .agg(F.first("total").alias("total"), F.array_sort(F.collect_list(row)).alias("nodes")))


def tops(blocks: DataFrame, fan: int, depth: int) -> DataFrame:
    """(grp, total, place, digest): the top of every block as a node of the next stage."""
    size = fan**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp, place, total, nodes = batch.columns
            digests = [Block(x.values.field("digest").to_pylist(), height(t, fan, depth), fan).top
                       for x, t in zip(nodes, total.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([grp, pa.array([-(-t // size) for t in total.to_pylist()], pa.int64()), place, pa.array(digests, pa.string())],
                                             names=["grp", "total", "place", "digest"])

    return blocks.select("grp", "block", "total", "nodes").mapInArrow(run, "grp bigint, total bigint, place bigint, digest string")


_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _as_path(value: list[dict] | None) -> list[tuple[str, str]]:
    return [(x["left"], x["right"]) for x in value or []]


def _path_array(paths: list[list[tuple[str, str]]]) -> pa.Array:
    return pa.array([[{"left": a, "right": b} for a, b in p] for p in paths], _ARROW_PATH)


def node_paths(blocks: DataFrame, above: DataFrame | None, fan: int, depth: int) -> DataFrame:
    """(grp, place, path) of every node: its siblings in the block, then ``above`` (grp, block, path)."""
    joined = blocks.select("grp", "block", "total", "nodes")
    joined = joined.withColumn("path", F.lit(None).cast(PATH)) if above is None else joined.join(above, ["grp", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, total, nodes, path in zip(batch.column("grp").to_pylist(), batch.column("total").to_pylist(), batch.column("nodes"), batch.column("path").to_pylist(), strict=True):
                block = Block(nodes.values.field("digest").to_pylist(), height(total, fan, depth), fan)
                upper = _as_path(path)
                n = len(block.levels[0])
                yield pa.RecordBatch.from_arrays([pa.array([grp] * n, pa.int64()), nodes.values.field("place"), _path_array([block.path(i) + upper for i in range(n)])],
                                                 names=["grp", "place", "path"])

    return joined.mapInArrow(run, f"grp bigint, place bigint, path {PATH}")


@dataclass
class Tree:
    """Stages of blocks from the leaves up, and the top of every group (grp, digest)."""

    stages: list[DataFrame]
    top: DataFrame
    fan: int
    depth: int

    def block_paths(self, above: DataFrame | None = None) -> DataFrame | None:
        """(grp, block, path) of the lowest stage's blocks up to the top of their group and on by ``above`` (grp, path)."""
        paths = None if above is None else above.select("grp", F.lit(0).cast("bigint").alias("block"), "path")
        for blocks in reversed(self.stages[1:]):
            paths = written(node_paths(blocks, paths, self.fan, self.depth).withColumnRenamed("place", "block"), "paths")
        return paths


def tree(nodes: DataFrame, largest: int, extra: list[str] = [], fan: int = FAN, depth: int = DEPTH) -> Tree:
    """The tree of each group of ``nodes`` (grp, total, place, digest, ``extra``); ``largest``: nodes of the largest group."""
    stages = []
    while True:
        stages.append(written(packed(nodes, extra, fan, depth), "blocks"))
        nodes = written(tops(stages[-1], fan, depth), "tops")
        largest, extra = -(-largest // fan**depth), []
        if largest <= 1:
            return Tree(stages, nodes.select("grp", "digest"), fan, depth)


# --- manifest ------------------------------------------------------------------------------------

RESULT = ("id {id}, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, "
          "folded_root string, verified boolean")


def proofs(rows: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every row of (id, grp, leaf, presented).

    ``grp``: the group's own value; ``leaf``: the untouched row's digest; ``presented``: the digest of a changed row, null
    if it is as it was.  ``proof``: siblings level by level, each level's left and right digests end to end.
    ``folded_root``: top of the version that the presented (else the original) leaf makes.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = rows.schema["id"].dataType.simpleString()
    rows = written(rows.select("id", F.col("grp").alias("value"), "leaf", "presented"), "leaves")  # hashed once, not again to find the ranges
    leaves, groups = placed(rows.withColumn("tie", F.monotonically_increasing_id()), "value", ["id", "leaf", "tie"])  # equal rows spread too
    # groups are numbered by the same means: their places in one group of all
    numbered, _ = placed(groups.withColumn("all", F.lit(0)), "all", ["value"])
    numbered = written(numbered.select("value", "total", F.col("place").alias("grp")), "groups")
    leaves = (leaves.join(numbered.select(F.col("value").alias("v"), "total", "grp"), F.col("value").eqNullSafe(F.col("v")))
              .select("grp", "total", "place", F.col("leaf").alias("digest"), "id", "presented"))
    sizes = numbered.agg(F.max("total"), F.count(F.lit(1))).first()
    lower = tree(leaves, sizes[0] or 0, ["id", "presented"], fan, depth)
    one = lower.top.select(F.lit(0).cast("bigint").alias("grp"), F.lit(sizes[1]).cast("bigint").alias("total"), F.col("grp").alias("place"), "digest")
    upper = tree(one, sizes[1], [], fan, depth)
    root = upper.top.select("digest").scalar()  # one row
    group_paths = node_paths(upper.stages[0], upper.block_paths(), fan, depth).select(F.col("place").alias("grp"), "path")
    group_paths = written(group_paths, "group-paths")
    above = lower.block_paths(group_paths)
    tops_of = lower.top.select("grp", F.col("digest").alias("subroot")).withColumn("root", root)
    blocks = (lower.stages[0].join(above, ["grp", "block"]).join(tops_of, "grp")
              .select("total", "nodes", "path", "subroot", "root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for total, nodes, path, subroot, top in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(),
                                                        batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                digests, changed = nodes.values.field("digest").to_pylist(), nodes.values.field("presented").to_pylist()
                block, above = Block(digests, height(total, fan, depth), fan), _as_path(path)
                proof, sums, folded = [], [], []
                for place, digest in enumerate(digests):
                    siblings = [a + b for a, b in block.path(place) + above]
                    proof.append(siblings)
                    sums.append(parent(siblings))
                    folded.append(fold(block.version(place, changed[place] or digest)[-1], above))
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [nodes.values.field("id"), pa.array(digests, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([top] * n, pa.string()),
                     pa.array(proof, pa.list_(pa.string())), pa.array(sums, pa.string()), pa.array(folded, pa.string()), pa.array([x == top for x in folded], pa.bool_())],
                    names=["id", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

    return blocks.mapInArrow(run, RESULT.format(id=kind))


#: A-Z and what tampering makes of them.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAMPER_MOD = 3


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proof of every document, and the root that its tampered (else its own) leaf folds to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_MOD == 0
    presented = F.when(tampered, leaf([*fields, F.translate("text", _UPPER, _LOWER)]))
    rows = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), leaf([*fields, F.col("text")]).alias("leaf"), presented.alias("presented"))
    return proofs(rows).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: Levels unrolled by the SQL: enough for 8 ** 8 documents; further levels change nothing.
_SQL_LEVELS = 8


def _sql_tree(name: str, leaves: str) -> list[str]:
    """CTEs ``{name}0 ..`` (g, p, h) of all levels over ``leaves`` (g, p, h), and ``{name}_s`` (p0, g, k, l, r) with the siblings."""
    found = [f"{name}0 as materialized (select g, p, h from {leaves})"]
    for k in range(_SQL_LEVELS):
        found.append(f"""{name}{k + 1} as materialized (select g, p, case when n = 1 then h1 else sha256(hs) end h from (
  select g, p // {FAN} p, string_agg(h, '' order by p) hs, min(h) h1, any_value(n) n from (select *, count(*) over (partition by g) n from {name}{k})
  group by g, p // {FAN}))""")
    levels = "\n  union all ".join(
        f"""select a.g, a.p, {k} k, coalesce(string_agg(b.h, '' order by b.p) filter (where b.p < a.p), '') l,
    coalesce(string_agg(b.h, '' order by b.p) filter (where b.p > a.p), '') r
  from (select *, count(*) over (partition by g) n from {name}{k}) a join {name}{k} b on b.g = a.g and b.p // {FAN} = a.p // {FAN}
  where a.n > 1 group by a.g, a.p""" for k in range(_SQL_LEVELS))
    return found + [f"{name}_s as materialized ({levels})"]


def _sql_field(x: str) -> str:
    return f"coalesce(strlen({x}::varchar)::varchar || ':' || {x}::varchar, '-')"


def _sql() -> str:
    head = " || ".join(_sql_field(x) for x in ("doc_id", "source", "lang", "n_chars"))
    low = f"translate(text, '{_UPPER}', '{_LOWER}')"
    ctes = [f"""d as materialized (select doc_id, lang, sha256({head} || {_sql_field('text')}) h,
  case when {oracles.crc32('doc_id::varchar')} % {TAMPER_MOD} = 0 then sha256({head} || {_sql_field(low)}) end t from documents)""",
            "gs as (select lang, row_number() over (order by encode(lang) nulls first) - 1 g from (select distinct lang from d))",
            "lv as materialized (select d.*, gs.g, row_number() over (partition by gs.g order by doc_id nulls first, h) - 1 p from d join gs on d.lang is not distinct from gs.lang)",
            *_sql_tree("a", "lv"), f"tops as (select 0 g, g p, h from a{_SQL_LEVELS})", *_sql_tree("b", "tops"),
            f"paths as (select lv.doc_id, lv.p, lv.g, lv.h, lv.t, s.k, s.l, s.r from lv left join a_s s on s.g = lv.g and s.k < {_SQL_LEVELS} and s.p = lv.p // ({FAN} ** s.k)::bigint)"]
    ups = f"(select list({{'l': s.l, 'r': s.r}} order by s.k) from b_s s where s.p = x.g // ({FAN} ** s.k)::bigint)"
    ctes.append(f"""x as (select doc_id, g, p, any_value(h) h, any_value(t) t, coalesce(list({{'l': l, 'r': r}} order by k) filter (where k is not null), []) low
  from paths group by doc_id, g, p)""")
    ctes.append(f"y as (select *, list_concat(low, coalesce({ups}, [])) path from x)")
    step = "list_reduce(list_prepend({'l': coalesce(t, h), 'r': ''}, path), lambda u, v: {'l': sha256(v.l || u.l || v.r), 'r': ''}).l"
    ctes.append(f"z as (select *, {step} folded_root from y)")
    return "with " + ",\n".join(ctes) + f"""
select z.doc_id, z.h leaf, s.h subroot, r.h root, sha256(array_to_string(list_transform(z.path, lambda v: v.l || v.r), '')) proof_sha256,
  z.folded_root, z.folded_root = r.h verified
from z join a{_SQL_LEVELS} s on s.g = z.g, b{_SQL_LEVELS} r"""


ORACLE_SQL = _sql()

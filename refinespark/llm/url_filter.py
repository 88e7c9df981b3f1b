"""URL filters: rules by host and path, then gradient-boosted trees on lexical features.

A rule (host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's;
the longest fitting rule decides.  Every other URL is judged by gradient-boosted trees (Spark ML) trained on the
URLs that rules judge: lengths, depth, digit ratio, entropy, parameter counts, and the smoothed share of
blocked URLs and the frequency of the host's suffix (its last label) and of the path's first segment.

The trees' sample is bounded by ``SAMPLE_ROWS`` labelled URLs (the least hashes of the URL text, equal URLs once).  Suffixes
and segments are counted over all rows, their shares over all rows that rules judge; the table of these counts is broadcast
when it has ``BROADCAST_ROWS`` at most, else only its common entries are.  Rules and model are applied to every row.

Null URL or one without ``://``: host and path are empty.  No labelled URL: everything else is allowed; one class
only: that class.  Every row is judged by its URL alone, so repeated rows, null ids, empty tables and very long
URLs need nothing special; extra columns stay, and columns with the names of the results get in nobody's way
because ``judge_urls`` chooses free ones.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import append_columns, flat, fresh_names, prepare, written

SAMPLE_ROWS = 20_000
#: Counts of suffixes and segments (32 bytes each) that may be broadcast; of a larger table those with a COMMON-th of the rows.
BROADCAST_ROWS, COMMON = 100_000, 10_000
TREES, DEPTH, BINS, RATE = 20, 4, 32, 0.2
PRIOR_ROWS = 10.0


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (name, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tried first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def entropies(texts: pa.Array) -> np.ndarray:
    """Entropy (bits a byte) of the bytes of each text; empty: 0."""
    data, offs = flat(texts)
    size = np.diff(offs)
    row = np.repeat(np.arange(len(size)), size)
    keys, counts = np.unique(row * 256 + data, return_counts=True)
    row = keys >> 8
    share = counts / size[row]
    return np.bincount(row, -share * np.log2(share), len(size)) if len(keys) else np.zeros(len(size))


def _count(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("double")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Feature columns of a URL, its entropy apart."""
    url = F.coalesce(url, F.lit(""))
    size = F.char_length(url).cast("double")
    return {
        "url_length": size,
        "host_length": F.char_length(host).cast("double"),
        "path_length": F.char_length(path).cast("double"),
        "depth": _count(path, "[^/]"),
        "labels": _count(host, r"[^.]"),
        "hyphens": _count(host, "[^-]"),
        "digit_ratio": _count(url, "[^0-9]") / F.greatest(size, F.lit(1.0)),
        "host_digits": _count(host, "[^0-9]"),
        "parameters": F.when(F.instr(url, "?") > 0, 1 + _count(F.regexp_extract(url, r"\?([^#]*)", 1), "[^&]")).otherwise(0.0),
        "fragment": (F.instr(url, "#") > 0).cast("double"),
        "secure": F.lower(F.substr(url, F.lit(1), F.lit(6))).eqNullSafe("https:").cast("double"),
    }


FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "parameters", "fragment",
            "secure", "entropy", "suffix_block", "suffix_count", "segment_block", "segment_count")


def suffix_of(host: Column) -> Column:
    """Hash of the host's last label."""
    return F.xxhash64(F.regexp_extract(F.regexp_replace(host, r":[0-9]*$", ""), r"([^.]*)\.?$", 1))


def segment_of(path: Column) -> Column:
    """Hash of the path's first segment."""
    return F.xxhash64(F.lit("path"), F.regexp_extract(path, "^/?([^/]*)", 1))


def described(df: DataFrame, url_col: str, rules: tuple[Rule, ...], out: str) -> DataFrame:
    """``df`` plus a struct: host, path, rule, suffix hash and the lexical features."""
    entropy, = fresh_names(df, ["url_entropy"])
    df = append_columns(df, url_col, [T.StructField(entropy, T.DoubleType())], lambda texts: [pa.array(entropies(texts), pa.float64())])
    host, path = host_and_path(F.col(url_col))
    columns = df.columns[:-1]
    base, = fresh_names(df, ["url_base"])
    df = df.withColumn(base, F.struct(host.alias("host"), path.alias("path")))
    host, path = F.col(base)["host"], F.col(base)["path"]
    found = F.struct(host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"),
                     suffix_of(host).alias("suffix"), segment_of(path).alias("segment"),
                     F.col(entropy).alias("entropy"), *(c.alias(n) for n, c in lexical(F.col(url_col), host, path).items()))
    return df.select(*columns, found.alias(out))


class Counts(NamedTuple):
    """Rows, judged rows and blocked rows of every suffix and segment; ``common`` is small, ``rare`` the others (None: none)."""

    table: DataFrame
    common: DataFrame
    rare: DataFrame | None


class UrlModel(NamedTuple):
    """Trees (None: all get the share ``constant``), the counts of suffixes and segments and the share of blocked URLs."""

    trees: GBTClassificationModel | None
    counts: Counts
    constant: float


def counted(urls: DataFrame, url_col: str, rules: tuple[Rule, ...]) -> tuple[Counts, float]:
    """Counts of suffixes and segments over all rows, and the share of blocked rows among those that rules judge."""
    host, path = host_and_path(F.col(url_col))
    base = urls.select(F.struct(host.alias("host"), path.alias("path")).alias("u"))
    host, path = F.col("u")["host"], F.col("u")["path"]
    found = base.select(rule_of(host, path, rules)["verdict"].alias("verdict"), F.explode(F.array(suffix_of(host), segment_of(path))).alias("hash"))
    table = written(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("judged"),
                                              F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")), "suffixes")
    size, rows, judged, blocked = table.agg(F.count(F.lit(1)), F.sum("n"), F.sum("judged"), F.sum("blocked")).first()
    share = blocked / judged if judged else 0.0
    if size <= BROADCAST_ROWS:
        return Counts(table, table, None), share
    common = F.col("n") * (2 * COMMON) >= F.lit(rows)  # every row has a suffix and a segment: 2 * COMMON entries at most
    return Counts(table, table.filter(common), table.filter(~common)), share


def looked_up(df: DataFrame, key: Column, counts: Counts) -> tuple[DataFrame, list[Column]]:
    """``df`` joined to the counts of ``key``: rows, judged rows and blocked rows, 0 if unknown."""
    names = fresh_names(df, ["url_hash", "url_n", "url_judged", "url_blocked"])
    df = df.join(F.broadcast(counts.common.toDF(*names)), key == F.col(names[0]), "left")
    if counts.rare is None:
        return df, [F.coalesce(F.col(n), F.lit(0)) for n in names[1:]]
    spread, = fresh_names(df, ["url_spread"])  # rows of common keys stay spread and match nothing
    unknown = F.col(names[0]).isNull()
    df = df.withColumn(spread, F.when(unknown, key).otherwise(F.monotonically_increasing_id()))
    rare = fresh_names(df, ["url_hash", "url_n", "url_judged", "url_blocked"])
    df = df.join(counts.rare.toDF(*rare), (F.col(spread) == F.col(rare[0])) & unknown, "left")
    return df, [F.coalesce(F.col(n), F.col(r), F.lit(0)) for n, r in zip(names[1:], rare[1:], strict=True)]


def with_suffix(df: DataFrame, at: str, counts: Counts, share: float, out: str) -> DataFrame:
    """``df`` plus the feature vector."""
    columns, joined, extra = df.columns, df, {}
    for part in ("suffix", "segment"):
        joined, (count, judged, bad) = looked_up(joined, F.col(at)[part], counts)
        extra |= {f"{part}_block": (bad + PRIOR_ROWS * share) / (judged + PRIOR_ROWS), f"{part}_count": F.log1p(count.cast("double"))}
    names = fresh_names(df, [f"url_{f}" for f in FEATURES])
    wide = joined.select(*columns, *((extra[f] if f in extra else F.col(at)[f]).cast("double").alias(x) for f, x in zip(FEATURES, names, strict=True)))
    return VectorAssembler(inputCols=names, outputCol=out).transform(wide).select(*columns, out)


def fit(urls: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> UrlModel:
    """Counts over all rows, and trees from at most ``rows`` different URLs that rules judge."""
    spark = urls.sparkSession
    prepare(spark)
    host, path = host_and_path(F.col("url"))
    labelled = (urls.select(F.col(url_col).alias("url")).filter(rule_of(host, path, rules).isNotNull())
                .groupBy(F.xxhash64("url").alias("h")).agg(F.min("url").alias("url")).orderBy("h").limit(rows).select("url"))
    found = described(labelled, "url", rules, "u").withColumn("label", (F.col("u.rule.verdict") == "block").cast("double"))
    found = written(found, "urls")
    n, blocked = found.agg(F.count(F.lit(1)), F.sum("label")).first()
    counts, share = counted(urls, url_col, rules)
    if not n or blocked in (0, n):
        return UrlModel(None, counts, share)
    train = written(with_suffix(found, "u", counts, share, "features").select("features", "label"), "features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, stepSize=RATE, seed=7, checkpointInterval=-1).fit(train)
    return UrlModel(trees, counts, share)


def judge_urls(df: DataFrame, model: UrlModel, url_col: str = "url", rules: tuple[Rule, ...] = RULES, out: str = "judged") -> DataFrame:
    """``df`` plus a struct: host, path, rule (null if none fits), verdict, and the method's share for block."""
    info, = fresh_names(df, ["url_info"])
    found = described(df, url_col, rules, info)
    if model.trees is None:
        share = F.lit(model.constant)
    else:
        vector, raw, probability, guess = fresh_names(found, ["url_vector", "url_raw", "url_probability", "url_guess"])
        found = with_suffix(found, info, model.counts, model.constant, vector)
        trees = model.trees.setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(probability).setPredictionCol(guess)
        found = trees.transform(found)
        share = vector_to_array(F.col(probability))[1]
    i = F.col(info)
    result = F.struct(i["host"].alias("host"), i["path"].alias("path"), i["rule"]["name"].alias("rule"),
                      F.coalesce(i["rule"]["verdict"], F.when(share >= 0.5, "block").otherwise("allow")).alias("verdict"), share.alias("block_share"))
    return found.select(*df.columns, result.alias(out))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, fit(pages)).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.block_share")

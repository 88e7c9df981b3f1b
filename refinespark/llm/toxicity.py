"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offsets.

Labels are per document, so the words of the training sample are labelled first: a mark is a word or word
beginning that is at least ``RATIO`` times as frequent among toxic texts as among others, in ``SUPPORT`` toxic texts
or more.  Words of toxic texts that carry a mark are labelled 1, words of other texts 0; toxic texts without
any mark are left out.  Near copies count once (least hash of their word shingles), so that a group of
copies makes no marks.

The field has two states.  Emissions are hashed features of the word, its beginnings and its neighbours;
transitions and a start vector are learnt too.  Training cuts the sample in parts of about ``PART_BYTES``, climbs
``LOCAL_STEPS`` steps in each and merges the parameters (each weighted by how much the part saw of it), ``ROUNDS``
times; the merge is a tree over the parts' numbers.  The sample is bounded by ``SAMPLE_ROWS`` labelled rows (the least hashes
of ids) and ``SAMPLE_BYTES`` of text (the least hashes again); a labelled text over ``LONGEST`` bytes is not fitted on, but scored
like any other.  A part of the sample is kept apart to calibrate document scores from the marginals.  Every choice is by hashes
of ids and texts and every sum is taken in a fixed order, so a model depends on the tables, not on how their rows are dealt.

Scoring maps every row: forward-backward over the whole text, in both directions exact, marginals aggregated to
a score, and the words whose marginal exceeds one half are reported as spans in code points.

Null, empty and word-less texts: no words, no spans, the score of a text without evidence.  One class of labels
only, or none: all scores are the share of toxic labels (0 without any label).  A label row without id or label is ignored; of several the
largest label counts.  Repeated rows, null ids, empty tables and extra columns: every row is scored by its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinespark.llm.common import (_BYTE_VALUES, _INVERSE, _ODD, append_columns, flat, mix, powers, prepare, starts_char, steps,
                                    window_hashes, word_spans, written)
from refinespark.llm.decontaminate import IS_SEPARATOR

SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 16_000, 12 << 20, 1 << 20
PART_BYTES, ROUNDS, LOCAL_STEPS = 512 << 10, 2, 10
#: The sample is cut by bytes at one of so many ranges of hashes; parts merged at once.
RANGES, MERGED = 1_024, 8
RATIO, SUPPORT = 10.0, 5
BITS = 18
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
RATE, RIDGE, SHINGLE = 0.5, 1e-3, 5
HELD_OUT_MOD = 5
#: Evidence weights before any calibration row is seen (the log-odds of the largest marginal), and how much they count.
PRIOR, KEEP = np.array([0.0, 1.0, 0.0, 0.0]), 0.1


class Words(NamedTuple):
    """Words of many texts: byte spans, first word of each text, and per word the hashes of the word and its beginnings."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    keys: np.ndarray  # (1 + len(PREFIXES), n); 0 where the word is no longer than the beginning


def words_of(texts: pa.Array) -> Words:
    data, offs = flat(texts)
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends, first = word_spans(low, offs, IS_SEPARATOR)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[low] * powers(_INVERSE, len(low)), out=total[1:])
    scale = powers(_ODD, len(low) + 1)[starts]
    keys = np.zeros((1 + len(PREFIXES), len(starts)), np.uint64)
    keys[0] = mix((total[ends] - total[starts]) * scale)
    for k, size in enumerate(PREFIXES, 1):
        longer = ends - starts > size
        keys[k] = np.where(longer, mix((total[np.minimum(starts + size, ends)] - total[starts]) * scale + np.uint64(k)), 0)
    return Words(starts, ends, first, keys)


def features(words: Words) -> np.ndarray:
    """(features, n) places in the weight vector; place 0 is the bias, also for what a word does not have."""
    n, text_start = words.keys.shape[1], np.zeros(words.keys.shape[1] + 1, bool)
    text_start[words.first] = True
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n:
        before[1:] = np.where(text_start[1:n], 0, mix(words.keys[0, :-1] + np.uint64(101)))
        after[:-1] = np.where(text_start[1:n], 0, mix(words.keys[0, 1:] + np.uint64(102)))
    all_keys = np.vstack([np.zeros((1, n), np.uint64), words.keys, before[None], after[None]])
    return np.where(all_keys == 0, 0, all_keys >> np.uint64(64 - BITS)).astype(np.int32)


class Model(NamedTuple):
    weights: np.ndarray  # 2 ** BITS emission weights of state 1
    links: np.ndarray  # (3, 2) log weights: from state 0, from state 1, at the start

    @staticmethod
    def zero() -> Model:
        return Model(np.zeros(1 << BITS), np.zeros((3, 2)))


def emissions(model: Model, places: np.ndarray) -> np.ndarray:
    score = np.full(places.shape[1], model.weights[0])
    for row in places[1:]:
        score += np.where(row == 0, 0.0, model.weights[row])
    return np.clip(score, -30, 30)


def _running(steps_: np.ndarray) -> np.ndarray:
    """Running products of row vectors with the 2x2 matrices ``steps_`` (n, 2, 2), each scaled to sum 1; (n, 2).

    The sequence is cut in about sqrt(n) blocks; all blocks advance together, then the values at the
    block borders are passed on, then all blocks advance again from their own.
    """
    n = len(steps_)
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    padded = np.empty((blocks * size, 2, 2))
    padded[:n], padded[n:] = steps_, np.eye(2)
    grid = padded.reshape(blocks, size, 2, 2).transpose(1, 0, 2, 3)
    whole = np.broadcast_to(np.eye(2), (blocks, 2, 2))
    for step in grid:
        whole = whole @ step
        whole = whole / whole.sum(axis=(1, 2), keepdims=True)
    carry, now = np.empty((blocks, 2)), np.array([0.5, 0.5])
    for k in range(blocks):
        carry[k] = now
        now = now @ whole[k]
        now = now / now.sum()
    out = np.empty((size, blocks, 2))
    for i, step in enumerate(grid):
        carry = carry[:, :1] * step[:, 0] + carry[:, 1:] * step[:, 1]
        carry = carry / carry.sum(axis=1, keepdims=True)
        out[i] = carry
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def forward_backward(model: Model, score: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 (n) and of pairs of states (n, 2, 2; entry t: words t - 1 and t) of texts end to end.

    At the first word of a text both rows of its matrix are the start vector, so nothing passes from text to text.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    move = np.exp(np.where(begins[:, None, None], model.links[2][None, None, :], model.links[None, :2]))
    move = move * np.exp(np.stack([np.minimum(0, -score), np.minimum(0, score)], axis=1))[:, None, :]
    alpha = _running(move)
    beta = np.ones((n, 2)) / 2
    if n > 1:
        beta[:-1] = _running(move[:0:-1].transpose(0, 2, 1))[::-1]
    both = alpha * beta
    marginal = both[:, 1] / both.sum(axis=1)
    pair = np.empty((n, 2, 2))
    pair[0] = 0
    pair[1:] = alpha[:-1, :, None] * move[1:] * beta[1:, None, :]
    pair[1:] /= pair[1:].sum(axis=(1, 2), keepdims=True)
    return marginal, pair


def _begins(first: np.ndarray, n: int) -> np.ndarray:
    found = np.zeros(n + 1, bool)
    found[first] = True
    return found[:n]


def gradient(model: Model, places: np.ndarray, begins: np.ndarray, labels: np.ndarray) -> Model:
    """Gradient of the log-likelihood of the labels."""
    marginal, pair = forward_backward(model, emissions(model, places), begins)
    rest = labels - marginal
    weights = np.zeros(1 << BITS)
    for row in places[1:]:
        weights += np.bincount(row, rest, 1 << BITS)
    weights[0] = rest.sum()
    links = np.zeros((3, 2))
    inner = np.flatnonzero(~begins)
    np.add.at(links, (labels[inner - 1], labels[inner]), 1)
    links[:2] -= pair[inner].sum(axis=0)
    at = np.flatnonzero(begins)
    links[2] = [(1 - labels[at]).sum() - (1 - marginal[at]).sum(), labels[at].sum() - marginal[at].sum()]
    return Model(weights, links)


def climb(model: Model, slices: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rounds: int) -> tuple[Model, Model]:
    """Steps up the likelihood of all slices, each parameter with a rate of its own; and the squared gradients seen."""
    seen_w, seen_l = np.full(1 << BITS, 1e-8), np.full((3, 2), 1e-8)
    for _ in range(rounds):
        parts = [gradient(model, *x) for x in slices]
        grad_w = sum(p.weights for p in parts) - RIDGE * model.weights
        grad_l = sum(p.links for p in parts) - RIDGE * model.links
        seen_w, seen_l = seen_w + grad_w**2, seen_l + grad_l**2
        model = Model(model.weights + RATE * grad_w / np.sqrt(seen_w), model.links + RATE * grad_l / np.sqrt(seen_l))
    return model, Model(seen_w, seen_l)


# --- training ------------------------------------------------------------------------------------


def _bucket(id_col):
    return F.pmod(F.coalesce(F.crc32(id_col.cast("string").cast("binary")), F.lit(0)), F.lit(HELD_OUT_MOD))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows plus the least hash of the text's word shingles: the same for most near copies."""
    for batch in batches:
        for part in steps(batch, 1):
            words = words_of(part.column(1))
            found = []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                found.append(int(window_hashes(words.keys[0, a:b], min(SHINGLE, b - a)).min().view(np.int64)) if b > a else 0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=["id", "text", "toxic", "sketch"])


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, toxic, sketch): texts of at most ``rows`` labelled ids that are not held out, near copies once."""
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
              .filter(_bucket(F.col("id")) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(rows))
    chosen = written(chosen, "labels")  # at most ``rows`` ids and labels: bounded for the broadcast
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "toxic")
    texts = texts.filter(F.octet_length("text") <= LONGEST)
    one = F.min(F.struct(F.xxhash64("id").alias("h"), "id", "text")).alias("row")  # the same of each group, however the rows lie
    once = texts.mapInArrow(_sketches, f"id {kind}, text string, toxic int, sketch bigint").groupBy("sketch", "toxic").agg(one)
    once = written(once.select("row.id", "row.text", "toxic", "sketch", F.shiftrightunsigned("row.h", 64 - RANGES.bit_length() + 1).alias("range")), "once")
    sizes = sorted(once.groupBy("range").agg(F.sum(F.octet_length("text").cast("long"))).collect())  # ``RANGES`` rows at most
    upto = np.cumsum([n for _, n in sizes])
    within = [r for (r, _), n in zip(sizes, upto.tolist(), strict=True) if n <= SAMPLE_BYTES]
    return once.filter(F.col("range") <= (within[-1] if within else RANGES)).drop("range")


def marks(train: DataFrame) -> np.ndarray:
    """Sorted hashes of the words and beginnings that mark toxic texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                words, toxic = words_of(part.column(0)), part.column(1).to_numpy()
                sides: list[tuple[np.ndarray, np.ndarray]] = []
                for side in (0, 1):
                    keys = [np.unique(words.keys[:, a:b]) for a, b, t in zip(words.first[:-1], words.first[1:], toxic, strict=True) if t == side]
                    sides.append(np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                for side, (keys, counts) in enumerate(sides):
                    zero = np.zeros(len(keys), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(zero if side else counts), pa.array(counts if side else zero)],
                                                     names=["key", "clean", "toxic"])

    clean, toxic = (train.filter(F.col("toxic") == k).count() for k in (0, 1))
    if not clean or not toxic:
        return np.zeros(0, np.uint64)
    counted = (train.select("text", "toxic").mapInArrow(run, "key bigint, clean bigint, toxic bigint").filter("key != 0")
               .groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    often = (F.col("toxic") + 0.5) / (toxic + 1) >= RATIO * (F.col("clean") + 0.5) / (clean + 1)
    found = counted.filter(often & (F.col("toxic") >= SUPPORT)).select("key").collect()  # words of the bounded sample
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _labelled(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, text begins, word labels) of the training texts, in slices; toxic texts without a mark are left out."""
    found = []
    for batch in batches:
        for part in steps(batch, 0):
            words, toxic = words_of(part.column(0)), part.column(1).to_numpy()
            n = len(words.starts)
            if not n:
                continue
            place = np.minimum(np.searchsorted(known, words.keys), max(0, len(known) - 1))
            carries = (known[place] == words.keys).any(axis=0) if len(known) else np.zeros(n, bool)
            text = np.repeat(np.arange(len(toxic)), np.diff(words.first))
            y = (carries & (toxic[text] == 1)).astype(np.int64)
            usable = ((toxic == 0) | (np.bincount(text, y, len(toxic)) > 0))[text]
            found.append((features(words)[:, usable], _begins(words.first, n)[usable], y[usable]))
    return [x for x in found if len(x[2])]


_STATE = "part int, weights binary, links binary, seen_weights binary, seen_links binary"
_ARROW_STATE = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("weights", "links", "seen_weights", "seen_links"))])


def _state_row(part: int, model: Model, seen: Model) -> pa.Table:
    return pa.table({"part": [part], "weights": [model.weights.tobytes()], "links": [model.links.tobytes()],
                     "seen_weights": [seen.weights.tobytes()], "seen_links": [seen.links.tobytes()]}, schema=_ARROW_STATE)


def _state(row: dict) -> tuple[Model, Model]:
    w, k, sw, sk = (np.frombuffer(row[c]) for c in ("weights", "links", "seen_weights", "seen_links"))
    return Model(w, k.reshape(3, 2)), Model(sw, sk.reshape(3, 2))


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Parts in order of their numbers as one: parameters weighted by the squared gradients seen."""
    total, mass = Model.zero(), Model.zero()
    for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
        model, seen = _state(row)
        total = Model(total.weights + model.weights * seen.weights, total.links + model.links * seen.links)
        mass = Model(mass.weights + seen.weights, mass.links + seen.links)
    return _state_row(key[0].as_py(), Model(total.weights / mass.weights, total.links / mass.links), mass)


def fit_field(train: DataFrame, known: np.ndarray, part_bytes: int = PART_BYTES, rounds: int = ROUNDS, local_steps: int = LOCAL_STEPS) -> Model:
    """The field's parameters: climbed in parts and merged, ``rounds`` times."""
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    part = F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")
    train = written(train.select(part.alias("part"), "text", "toxic"), "train")
    model = Model.zero()
    for _ in range(rounds):
        state = spark.sparkContext.broadcast((model, known))  # 2 MB of weights, hashes of the sample's marks

        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            now, marked = state.value
            table = table.select(["text", "toxic"]).sort_by([("text", "ascending"), ("toxic", "ascending")]).combine_chunks()
            slices = _labelled(iter(table.to_batches()), marked)
            now, seen = climb(now, slices, local_steps) if slices else (now, Model(np.full(1 << BITS, 1e-8), np.full((3, 2), 1e-8)))
            return _state_row(key[0].as_py(), now, seen)

        found, left = written(train.groupBy("part").applyInArrow(run, _STATE), "parts"), parts
        while left > 1:
            step = found.withColumn("group", F.floor(F.col("part") / MERGED).cast("int")).groupBy("group")
            found, left = written(step.applyInArrow(lambda key, table: _merged(key, table.drop(["group"])), _STATE), "merged"), -(-left // MERGED)
        got = found.collect()  # one row
        state.unpersist()
        if not got:
            return model
        model = _state(got[0].asDict())[0]
    return model


def tag(model: Model, texts: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their marginals, and per text the evidence: a constant, the log-odds of its largest marginal, the log of their sum, the log of its words."""
    words = words_of(texts)
    n = len(words.starts)
    marginal, _ = forward_backward(model, emissions(model, features(words)), _begins(words.first, n))
    count = np.diff(words.first)
    most, total = np.full(len(count), 1e-6), np.full(len(count), 1e-6)
    full = np.flatnonzero(count)
    if len(full):
        most[full] = np.clip(np.maximum.reduceat(marginal, words.first[full]), 1e-6, 1 - 1e-6)
        total[full] += np.add.reduceat(marginal, words.first[full])
    return words, marginal, np.stack([np.ones(len(count)), np.log(most / (1 - most)), np.log(total), np.log1p(count)], axis=1)


def calibrate(train: DataFrame, model: Model) -> np.ndarray:
    """Weights of the evidence, by logistic regression over the sample's rows kept apart (four numbers a row)."""
    state = train.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0):
                evidence = tag(state.value, part.column(0))[2]
                yield pa.RecordBatch.from_arrays([pa.array(evidence[:, k]) for k in range(1, 4)] + [part.column(1)], names=["a", "b", "c", "toxic"])

    rows = sorted(map(tuple, train.select("text", "toxic").mapInArrow(run, "a double, b double, c double, toxic int").collect()))
    rows = np.array(rows, float).reshape(-1, 4)
    x, y = np.hstack([np.ones((len(rows), 1)), rows[:, :3]]), rows[:, 3]
    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + KEEP / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(50):  # Newton steps, halved until the loss falls; the ridge towards ``PRIOR`` keeps separable classes and small samples finite
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + KEEP * np.eye(4), x.T @ (y - p) - KEEP * (w - PRIOR))
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: int = SAMPLE_ROWS) -> tuple[Model, np.ndarray]:
    """The field and the weights of the evidence, from rows whose crc32(id) modulo ``HELD_OUT_MOD`` is not 0."""
    prepare(docs.sparkSession)
    train = written(sample(docs, labels, id_col, text_col, label_col, rows), "sample")
    counts = dict(train.groupBy("toxic").count().collect())
    if not counts.get(0) or not counts.get(1):  # one class or none: the share of toxic labels, whatever the text
        odds = 30.0 if counts.get(1) else -30.0
        return Model.zero(), np.array([odds, 0.0, 0.0, 0.0])
    apart = _bucket(F.col("id")) == 1
    learn = train.filter(~apart)
    model = fit_field(learn, marks(learn))
    return model, calibrate(train.filter(apart), model)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def score_texts(df: DataFrame, model: Model, evidence_weights: np.ndarray, text_col: str = "text", out: str = "toxicity",
                spans_out: str = "toxic_spans") -> DataFrame:
    """``df`` plus a score from 0 to 1 and the spans (code points) of runs of toxic words."""
    state = df.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def compute(texts: pa.Array) -> list[pa.Array]:
        words, marginal, evidence = tag(state.value, texts)
        score = 1 / (1 + np.exp(-np.clip(evidence @ evidence_weights, -30, 30)))
        bad = np.flatnonzero(marginal > 0.5)
        spans: list[list[dict]] = [[] for _ in range(len(texts))]
        if len(bad):
            data, offs = flat(texts)
            chars = np.concatenate([[0], np.cumsum(starts_char(data))])
            text = np.searchsorted(words.first, bad, side="right") - 1
            last = (-1, -1)
            for w, t in zip(bad.tolist(), text.tolist(), strict=True):
                end = int(chars[words.ends[w]] - chars[offs[t]])
                if last == (w - 1, t):
                    spans[t][-1]["end"] = end
                else:
                    spans[t].append({"start": int(chars[words.starts[w]] - chars[offs[t]]), "end": end})
                last = (w, t)
        return [pa.array(score, pa.float64()), pa.array(spans, _ARROW_SPANS)]

    return append_columns(df, text_col, [T.StructField(out, T.DoubleType()), T.StructField(spans_out, SPANS)], compute)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score, prediction and toxic spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, weights = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, model, weights).select(
        "doc_id", (_bucket(F.col("doc_id")) == 0).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), F.col("toxic_spans").alias("spans"))

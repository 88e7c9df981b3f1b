"""Stored vectors behind chat, data sets and the stream; token ids in one pass against the relational form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from refinespark.operators import vocab as voc
from refinespark.operators.encode import BatchEncoder, HashedEncoder
from refinespark.plans import chat, datasets
from refinespark.plans.registry import QUERIES
from refinespark.sources import tables as src
from refinespark.sources.stores import complete_folders
from refinespark.streaming import chat_stream


def logged(path, name):
    """An encoder that writes down how many texts it saw."""
    def factory():
        def model(texts):
            with open(path, "a") as f:
                f.write("x" * len(texts))
            return np.array([[t.count("a") + 1.0, t.count("e") + 0.5, len(t) % 7] for t in texts])
        return model
    return BatchEncoder(factory, name)


def test_stream_over_several_files_encodes_the_answers_once(spark, tmp_path):
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    conv.repartition(4).write.parquet(str(tmp_path / "in"))
    enc = logged(tmp_path / "log", f"logged-{tmp_path.name}")
    pairs = src.conversation_pairs(spark, SF_SMALL)
    batch = {tuple(r) for r in chat.chat_retriever(src.utterances(spark, SF_SMALL), pairs, enc).collect()}
    n_answers, n_utts = pairs.count(), len(batch)
    before = len((tmp_path / "log").read_text())
    sink = chat_stream.run_chat_stream(spark, chat_stream.utterance_stream(spark, str(tmp_path / "in")), pairs, enc, f"s-{tmp_path.name}", sink=str(tmp_path / "sink"))
    assert {tuple(r) for r in chat_stream.read_replies(spark, sink).collect()} == batch
    assert len(list((tmp_path / "sink" / "manifest").iterdir())) == 4  # a file a micro-batch
    assert before >= n_answers + n_utts and len((tmp_path / "log").read_text()) - before <= 2 * n_utts  # no answer was encoded again


def test_empty_sink_reads_as_an_empty_table(spark, tmp_path):
    got = chat_stream.read_replies(spark, str(tmp_path / "nothing"))
    assert got.columns == ["utt_id", "pid", "score", "reply"] and got.collect() == []
    spark.createDataFrame([], chat_stream.UTTERANCE_SCHEMA).write.parquet(str(tmp_path / "in"))
    sink = chat_stream.run_chat_stream(spark, chat_stream.utterance_stream(spark, str(tmp_path / "in")), src.conversation_pairs(spark, SF_SMALL),
                                       HashedEncoder(16), f"e-{tmp_path.name}", sink=str(tmp_path / "sink"))
    assert chat_stream.read_replies(spark, sink).collect() == []


def test_replies_without_a_manifest_do_not_count(spark, tmp_path):
    row = spark.createDataFrame([(1, 2, 0.5, "lost")], chat_stream.REPLY_SCHEMA)
    row.write.parquet(f"{tmp_path}/replies/0000000000-lost")
    assert chat_stream.read_replies(spark, str(tmp_path)).collect() == []


def test_exclude_self_needs_the_pairs_own_answers(spark):
    pairs = spark.createDataFrame([(1, "red apple", "red apple"), (2, "blue sky", "blue sky pie")], "pair_id long, q string, a string")
    vocab = voc.build_vocab(pairs.selectExpr("q as text"))
    with pytest.raises(ValueError):
        datasets.refine_prompts(pairs, HashedEncoder(16), corpus=pairs.selectExpr("pair_id as pid", "a as text"), exclude_self=True)
    rows = datasets.refine_dataset(pairs, vocab, HashedEncoder(16), p=1.0, exclude_self=True).collect()
    plain = datasets.refine_dataset(pairs, vocab, HashedEncoder(16), p=1.0).collect()
    assert {r.pair_id for r in rows} == {1, 2} and sorted(map(str, rows)) != sorted(map(str, plain))


TEXTS = [(1, "Red <s>apple</s> red!"), (2, None), (3, ""), (4, "... !"), (5, "unseen words, red"), (6, "ÉPÉE épée 12 x1")]


@pytest.mark.parametrize("limit", [voc.VOCAB_BROADCAST_BYTES, 0])
def test_ids_by_lookup_equal_ids_by_join(spark, monkeypatch, limit):
    monkeypatch.setattr(voc, "VOCAB_BROADCAST_BYTES", limit)
    df = spark.createDataFrame(TEXTS, "k long, t string")
    vocab = voc.build_vocab(df.where("k in (1, 6)"), "t")
    ids = {r.token: r.id for r in vocab.collect()}
    got = {r.k: r.ids for r in voc.encode_tokens(df, "k", "t", vocab, out="ids").collect()}
    assert got[1] == [ids["red"], ids["<s>"], ids["apple"], ids["</s>"], ids["red"]]
    assert got[2] == got[3] == got[4] == [] and got[5] == [voc.UNK_ID, voc.UNK_ID, ids["red"]]
    assert got[6] == [ids["épée"], ids["épée"], ids["12"], ids["x1"]]
    back = {r.k: r.text for r in voc.decode_tokens(voc.encode_tokens(df, "k", "t", vocab, out="ids"), "k", "ids", vocab).collect()}
    assert back == {1: "red apple red", 2: "", 3: "", 4: "", 5: "red", 6: "épée épée 12 x1"}
    beyond = spark.createDataFrame([(1, [0, 999, ids["red"]])], "k long, ids array<int>")
    assert voc.decode_tokens(beyond, "k", "ids", vocab).first()["text"] == "<unk> red"
    assert voc.encode_tokens(df.limit(0), "k", "t", vocab).collect() == []


@pytest.mark.parametrize("limit", [voc.VOCAB_BROADCAST_BYTES, 0])
def test_data_sets_do_not_depend_on_the_form(spark, monkeypatch, limit):
    pairs = src.conversation_pairs(spark, SF_SMALL)
    vocab = voc.build_vocab(pairs.selectExpr("q as text").union(pairs.selectExpr("a as text")), min_count=2)
    plain = sorted(map(tuple, datasets.generator_dataset(pairs, vocab).collect()), key=str)
    monkeypatch.setattr(voc, "VOCAB_BROADCAST_BYTES", limit)
    assert sorted(map(tuple, datasets.generator_dataset(pairs, vocab).collect()), key=str) == plain


def test_generator_dataset_reads_the_texts_once(spark):
    pairs = src.conversation_pairs(spark, SF_SMALL)
    vocab = voc.build_vocab(pairs.selectExpr("q as text"))
    plan = datasets.generator_dataset(pairs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "regexp" not in plan.lower() and "conversations" not in plan


def test_a_micro_batch_takes_files_by_bytes(spark, tmp_path):
    """Small files are answered in one micro-batch, a bound of bytes or files splits them, and the replies are the same."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"word{c} word{t}") for c in range(8) for t in range(4)]
    conv = spark.createDataFrame(rows, chat_stream.UTTERANCE_SCHEMA)
    conv.repartition(4, "conv_id").write.parquet(str(tmp_path / "in"))
    pairs = spark.createDataFrame([(i, f"word{i}", f"word{i} word{i % 4}") for i in range(8)], "pair_id long, q string, a string")
    side, replies, batches = chat.serve(pairs, HashedEncoder(16)), [], []
    for name, kw in (("all", {"max_bytes_per_trigger": 256 << 20}), ("bytes", {"max_bytes_per_trigger": 1}), ("files", {"max_files_per_trigger": 2})):
        stream = chat_stream.utterance_stream(spark, str(tmp_path / "in"), **kw)
        sink = chat_stream.run_chat_stream(spark, stream, side, HashedEncoder(16), f"{name}-{tmp_path.name}", sink=str(tmp_path / name))
        replies.append(sorted(tuple(r) for r in chat_stream.read_replies(spark, sink).collect()))
        batches.append(len(complete_folders(spark, f"{sink}/manifest")))
    n = len(list((tmp_path / "in").glob("part-*.parquet")))
    assert replies[0] == replies[1] == replies[2] and len(replies[0]) == 16
    assert n > 1 and batches == [1, n, -(-n // 2)]


def test_registered_stream_answers_small_files_in_one_micro_batch(spark, tmp_path):
    """The number of searches of the whole corpus does not follow the number of input files."""
    spark.read.parquet(f"{SF_SMALL}/conversations.parquet").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["chat_stream"](spark, str(tmp_path))
    want = QUERIES["chat_retriever"](spark, SF_SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) == 1  # a folder a micro-batch

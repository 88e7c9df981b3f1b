"""Vocabulary, padding and masks; in-batch measures; decoding constraints."""

import math

from pyspark.sql import functions as F

from refinespark.operators import evaluate, generate, vocab as voc
from refinespark.plans import chat


def test_vocab_specials_and_order(spark):
    df = spark.createDataFrame([("b a a",), ("a c b <s>",)], "text string")
    v = {r.token: r.id for r in voc.build_vocab(df).collect()}
    assert v == {"<pad>": 0, "<unk>": 1, "<s>": 2, "</s>": 3, "a": 4, "b": 5, "c": 6}


def test_encode_pad_mask(spark):
    texts = spark.createDataFrame([(1, "<s>a b zz</s>"), (2, "c"), (3, "!!!")], "id long, t string")
    v = voc.build_vocab(spark.createDataFrame([("a b c",)], "text string"))
    ids = voc.encode_tokens(texts, "id", "t", v)
    got = {r.id: r.input_ids for r in ids.collect()}
    assert got == {1: [2, 4, 5, 1, 3], 2: [6], 3: []}
    padded = voc.pad_longest(ids, "input_ids", mask_col="m").collect()
    for r in padded:
        assert len(r.input_ids) == 5 and sum(r.m) == len(got[r.id])
    cut = {r.id: r.input_ids for r in voc.pad_truncate(ids, "input_ids", max_len=3).collect()}
    assert cut == {1: [2, 4, 5], 2: [6, 0, 0], 3: [0, 0, 0]}


def test_decode_drops_specials(spark):
    v = voc.build_vocab(spark.createDataFrame([("a b",)], "text string"))
    ids = spark.createDataFrame([(1, [2, 4, 1, 5, 3, 0])], "id long, ids array<int>")
    assert voc.decode_tokens(ids, "id", "ids", v).first().text == "a b"


def _batch(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, pos_in_batch long, q_vec array<float>, a_vec array<float>")


def test_one_row_batch_loss_zero_acc_one(spark):
    out = evaluate.evaluate_batches(_batch(spark, [(0, 0, [1.0, 2.0], [0.5, 0.1])])).first()
    assert out.loss == 0.0 and out.acc == 1.0 and out.batches == 1


def test_log_softmax_sums_to_one(spark):
    rows = [(0, i, [float(i), 1.0], [1.0, float(i % 2)]) for i in range(5)]
    lp = evaluate.inbatch_log_softmax(evaluate.inbatch_logits(_batch(spark, rows)))
    sums = lp.groupBy("i").agg(F.sum(F.exp("logp")).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0, rel_tol=1e-12) for r in sums)


def test_constraints(spark):
    v = voc.build_vocab(spark.createDataFrame([("one two three four five six",)], "text string"))
    cands = spark.createDataFrame([
        (1, 0, "one two one two five", 0.0),     # repeated bigram
        (1, 1, "one two", -1.0),                 # under min_length
        (1, 2, "one two three four five", -2.0),  # good
        (1, 3, "six five four three two", -3.0),  # good, lower score
    ], generate.CAND_SCHEMA)
    kept = generate.constrain_candidates(cands, v, min_length=5, n_best=1).collect()
    assert [r.cand for r in kept] == [2]
    banned = spark.createDataFrame([(1, 0, "x", 0.0, [4, 1, 0, 5]), (1, 1, "y", -1.0, [1, 1, 1])],
                                   generate.CAND_SCHEMA + ", ids array<int>")
    kept = generate.constrain_candidates(banned, None, n_best=5).collect()
    assert [r.cand for r in kept] == [1]  # only-unk passes: the ban is the sequence unk, pad


def test_long_replies_are_cut_and_no_query_is_lost(spark):
    cands = spark.createDataFrame([
        (1, 0, "One, two; three... four!", 0.0),      # cut after the third token
        (2, 0, "a", 0.0), (2, 1, "b b b", -1.0),      # all break a rule: the best stays
        (3, 0, None, 0.0),
    ], generate.CAND_SCHEMA)
    kept = generate.constrain_candidates(cands, None, min_length=2, max_length=3, n_best=5)
    rows = {r.qid: (r.cand, r.reply, r.reason) for r in kept.collect()}
    assert rows == {1: (0, "One, two; three", None), 2: (0, "a", "min_length"), 3: (0, None, "min_length")}


def test_every_utterance_is_answered(spark):
    utts = spark.createDataFrame([(1, "hello there"), (2, "?!"), (3, "word " * 200), (4, "")], "utt_id long, text string")
    pairs = spark.createDataFrame([(1, "hello", "hello to you my dear friend"), (2, "x", "word " * 100)], "pair_id long, q string, a string")
    refined = chat.chat_refine(utts, pairs).collect()
    assert {r.utt_id for r in refined} == {1, 2, 3, 4}
    assert {r.utt_id for r in refined if r.pid is None} == {2, 4}
    generated = chat.chat(utts, pairs, mode="generator", model=lambda: lambda prompts, n: [[] for _ in prompts])
    assert {(r.utt_id, r.reason) for r in generated.collect()} == {(i, "no_candidate") for i in (1, 2, 3, 4)}


def test_prompt_is_cut_off_the_reply(spark):
    prompts = spark.createDataFrame([(1, "<s>q</s>")], "qid long, prompt string")
    out = generate.generate_batch(prompts, lambda: lambda texts, n: [[(t + " tail", 0.0)] for t in texts], cut_prompt=True)
    assert [r.reply for r in out.collect()] == [" tail"]


def test_copy_generator(spark):
    prompts = spark.createDataFrame([(7, "<s>q</s><s>First. Second\nthird</s>")], "qid long, prompt string")
    out = generate.generate_batch(prompts, generate.CopyGenerator(), "prompt", 5).orderBy("cand").collect()
    assert [r.reply for r in out] == ["First. Second\nthird", "First. Second"]


def test_dedup_in_batch(spark):
    rows = [(0, 0, [1.0, 0.0], [1.0, 0.0], 7), (0, 1, [1.0, 0.0], [1.0, 0.0], 7)]
    df = spark.createDataFrame(rows, "batch_id long, pos_in_batch long, q_vec array<float>, a_vec array<float>, k long")
    plain = evaluate.evaluate_batches(df).first()
    dedup = evaluate.evaluate_batches(df, dedup_key="k").first()
    assert plain.loss > 0.69 and dedup.loss == 0.0 and dedup.acc == 1.0

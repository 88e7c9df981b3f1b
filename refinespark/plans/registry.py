"""Catalogue of the registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; nothing is capped, sampled or filtered by id to make it cheap.  The
fixtures are: pairs = a user turn answered at once by an assistant turn;
passages = their answers; utterances = all user turns; vectors = the
``embeddings`` table; vector pairs = vector 2i (question) with 2i+1 (answer).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import gold_prompt, refine_prompt, wrap
from ..functions.vectors import SCORE_DECIMALS
from ..operators import ann, encode, evaluate, exact, generate, retrieve, sampling, vocab as voc
from ..session import shared_dir
from ..sources import stores
from ..sources import tables as src
from ..streaming import chat_stream
from . import chat, datasets

# Fixed values of the registered (oracle-checked) queries.
DIM = 64            # hashed encoder width
SEED = 42
VOCAB_MIN_COUNT = 2
MAX_LEN = 512       # tokens of a padded and cut text
NLIST, BITS, IVF_ITERS = 16, 8, 2
Query = Callable[[SparkSession, str], DataFrame]


def _enc() -> encode.HashedEncoder:
    return encode.HashedEncoder(DIM)


def _pairs(spark, sf):
    return src.conversation_pairs(spark, sf)


def _passages(spark, sf):
    return src.passages(_pairs(spark, sf))


def _vocab(spark, sf):
    conv = src.read_table(spark, sf, "conversations", "text")
    return voc.build_vocab(conv, "text", min_count=VOCAB_MIN_COUNT)


def _mean_query(spark, sf):
    """One query that depends on the whole table: the mean of all vectors."""
    v = src.vectors(spark, sf)
    per_dim = v.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return per_dim.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))),
                                   lambda s: s["m"]).cast("array<float>").alias("vec"))


def _index(spark, sf) -> ann.IvfIndex:
    return stores.index_store(src.vectors(spark, sf), NLIST, BITS, IVF_ITERS, SEED)


def _queries_from_vectors(spark, sf):
    return src.vectors(spark, sf).select(F.col("pid").alias("qid"), "vec")


# ---------------------------------------------------------------- sources (S)
def q_read_pairs(spark, sf):
    return _pairs(spark, sf)


def q_read_pairs_csv(spark, sf):
    """The pairs written as CSV files (quoted, with line breaks) in their order, and read back with their positions."""
    import uuid
    path = shared_dir(spark, "csv", uuid.uuid4().hex)
    pairs = _pairs(spark, sf).orderBy("pair_id").select(F.col("q").alias("Q"), F.col("a").alias("A"))
    pairs.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return src.read_pairs_csv(spark, path)


def q_corpus_profile(spark, sf):
    return src.corpus_profile(_pairs(spark, sf))


def q_passage_ids(spark, sf):
    p = _passages(spark, sf)
    r = sampling.key_order_rank(p, "pid", name="pos")
    return r.select("pid", (F.col("pos") - 1).alias("pos"), "text")


def q_embedding_store(spark, sf):
    return stores.embedding_store(_passages(spark, sf), _enc())


def q_index_store(spark, sf):
    return _index(spark, sf).codes.select("pid", "cell", "code")


def q_utterances(spark, sf):
    return src.utterances(spark, sf)


# ---------------------------------------------------------- projections (P)
def q_wrap_special(spark, sf):
    return _pairs(spark, sf).select("pair_id", wrap("q").alias("q"), wrap("a").alias("a"))


def q_normalize_utterance(spark, sf):
    return chat.normalize_utterance(src.utterances(spark, sf)).select("utt_id", "prompt")


def q_gold_prompt(spark, sf):
    return _pairs(spark, sf).select("pair_id", gold_prompt("q", "a").alias("prompt"))


def q_refine_prompt(spark, sf):
    """Every question with its top-1 answer (wrapped question searched, raw answers indexed)."""
    pairs = _pairs(spark, sf)
    passages = src.passages(pairs)
    qv = encode.guard_zero_vector(encode.encode_queries(pairs.select(F.col("pair_id").alias("qid"), "q"),
                                                        "qid", "q", _enc()), "vec", "quarantine")
    hits = exact.topk_exact_bulk(qv, encode.encode_passages(passages, "pid", "text", _enc()), k=1, dim=DIM)
    top = retrieve.lookup_passage(hits, passages, "retrieved")
    return (pairs.join(top.withColumnRenamed("qid", "pair_id"), "pair_id")
                 .select("pair_id", refine_prompt("q", "retrieved").alias("prompt")))


def q_join_context(spark, sf):
    pairs = _pairs(spark, sf)
    passages = src.passages(pairs)
    qv = encode.guard_zero_vector(encode.encode_queries(pairs.select(F.col("pair_id").alias("qid"), "q"),
                                                        "qid", "q", _enc(), wrap_markers=False), "vec", "quarantine")
    hits = exact.topk_exact_bulk(qv, encode.encode_passages(passages, "pid", "text", _enc()), k=3, dim=DIM)
    return retrieve.join_context(hits, passages)


def q_decode_tokens(spark, sf):
    pairs = _pairs(spark, sf)
    v = _vocab(spark, sf)
    ids = voc.encode_tokens(pairs.select("pair_id", wrap("a").alias("wa")), "pair_id", "wa", v)
    return voc.decode_tokens(ids, "pair_id", "input_ids", v)


def q_answer_tail(spark, sf):
    """Ids of prompt + reply, then the reply cut back out by the prompt's token count."""
    pairs = _pairs(spark, sf)
    v = _vocab(spark, sf)
    full = voc.encode_tokens(pairs.select("pair_id", F.concat(wrap("q"), wrap("a")).alias("t")), "pair_id", "t", v,
                             out="ids")
    prompt = voc.encode_tokens(pairs.select("pair_id", wrap("q").alias("t")), "pair_id", "t", v, out="prompt_ids")
    return full.join(prompt, "pair_id").select("pair_id", voc.answer_tail("ids", "prompt_ids").alias("tail_ids"))


def q_example_rows(spark, sf):
    ex = datasets.generator_dataset(_pairs(spark, sf), _vocab(spark, sf))
    return ex.agg(F.count(F.lit(1)).alias("n_examples"),
                  F.max(F.size("input_ids")).alias("input_len"), F.max(F.size("labels")).alias("label_len"))


# ------------------------------------------------------------ tokens (T)
def q_build_vocab(spark, sf):
    return _vocab(spark, sf)


def q_encode_tokens(spark, sf):
    return voc.encode_tokens(_pairs(spark, sf), "pair_id", "q", _vocab(spark, sf))


def q_pad_longest(spark, sf):
    ids = voc.encode_tokens(_pairs(spark, sf), "pair_id", "q", _vocab(spark, sf))
    return voc.pad_longest(ids, "input_ids", mask_col="attention_mask")


def q_pad_truncate(spark, sf):
    ids = voc.encode_tokens(_pairs(spark, sf), "pair_id", "q", _vocab(spark, sf))
    return voc.pad_truncate(ids, "input_ids", max_len=MAX_LEN, mask_col="attention_mask")


def q_attention_mask(spark, sf):
    ids = voc.encode_tokens(_pairs(spark, sf), "pair_id", "a", _vocab(spark, sf))
    return voc.pad_longest(ids, "input_ids", mask_col="attention_mask").select("pair_id", "attention_mask")


def q_token_type_ids(spark, sf):
    ids = voc.encode_tokens(_pairs(spark, sf), "pair_id", "q", _vocab(spark, sf))
    return ids.select("pair_id", voc.token_type_ids("input_ids").alias("token_type_ids"))


def q_labels_column(spark, sf):
    return datasets.generator_dataset(_pairs(spark, sf), _vocab(spark, sf)).select("pair_id", "labels")


# ---------------------------------------------------------- sampling (B)
def q_global_rank(spark, sf):
    return sampling.global_rank(_pairs(spark, sf).select("pair_id"), "pair_id", SEED)


def q_bernoulli_mix(spark, sf):
    return sampling.bernoulli_mix(_pairs(spark, sf).select("pair_id", "q"), "pair_id", 0.3, SEED)


def q_exact_split(spark, sf):
    return sampling.exact_split(_pairs(spark, sf).select("pair_id"), "pair_id", 0.8, SEED)


def q_sequential_batches(spark, sf):
    return sampling.sequential_batches(_pairs(spark, sf).select("pair_id"), "pair_id", 20)


def q_shuffled_batches(spark, sf):
    return sampling.shuffled_batches(_pairs(spark, sf).select("pair_id"), "pair_id", 64, epoch=0, seed=SEED)


# ---------------------------------------------------------- encoding (E)
def q_encode_passages(spark, sf):
    return encode.encode_passages(_passages(spark, sf), "pid", "text", _enc())


def q_encode_incremental(spark, sf):
    """A corpus that grows: one language stored first, then all documents; only what is new is encoded."""
    import uuid
    docs = src.read_table(spark, sf, "documents", "doc_id", "text", "lang")
    store = stores.VectorStore(spark, _enc(), root=shared_dir(spark, "stores", f"grown-{uuid.uuid4().hex}"))
    store.append(docs.where(F.col("lang") == "en"), key="doc_id")
    return store.read(docs, key="doc_id").withColumnRenamed("doc_id", "pid")


def q_encode_queries(spark, sf):
    u = chat.normalize_utterance(src.utterances(spark, sf))
    return encode.encode_queries(u.select(F.col("utt_id").alias("qid"), "prompt"), "qid", "prompt", _enc(),
                                 wrap_markers=False)


def q_guard_zero_vector(spark, sf):
    u = chat.normalize_utterance(src.utterances(spark, sf))
    qv = _enc().encode(u.select(F.col("utt_id").alias("qid"), "prompt"), "qid", "prompt")
    return encode.guard_zero_vector(qv, "vec", "flag").select("qid", "zero_vector")


def q_tfidf_encoder(spark, sf):
    passages = _passages(spark, sf)
    enc = encode.TfidfEncoder(DIM).fit(passages, "text")
    return enc.encode(passages, "pid", "text")


# --------------------------------------------------------- retrieval (R)
def q_score_pairs(spark, sf):
    return exact.score_pairs(src.vector_pairs(spark, sf), "a_vec", "q_vec").select("pair_id", "score")


def q_topk_exact(spark, sf):
    return exact.topk_exact(_mean_query(spark, sf), src.vectors(spark, sf), k=10)


def q_topk_exact_bulk(spark, sf):
    v = src.vectors(spark, sf)
    return exact.topk_exact_bulk(v.withColumnRenamed("pid", "qid"), v, k=10)


def q_topk_l2(spark, sf):
    v = src.vectors(spark, sf)
    return exact.topk_exact_bulk(v.withColumnRenamed("pid", "qid"), v, k=10, metric="l2")


def q_ivf_train(spark, sf):
    c = ann.ivf_train(src.vectors(spark, sf), NLIST, IVF_ITERS, SEED)
    return c.select("cell", F.transform("vec", lambda x: F.round(x, SCORE_DECIMALS)).alias("vec"))


def q_sq_encode(spark, sf):
    v = src.vectors(spark, sf)
    lo, hi = ann.sq_train(v)
    return ann.sq_encode(v, "vec", lo, hi, BITS).select("pid", "code")


def q_ivf_add(spark, sf):
    return _index(spark, sf).codes.select("pid", "cell")


def q_ann_search(spark, sf):
    return ann.ann_search(_mean_query(spark, sf), _index(spark, sf), k=10)


def q_ann_search_bulk(spark, sf):
    return ann.ann_search_bulk(_queries_from_vectors(spark, sf), _index(spark, sf), k=10)


def q_ann_search_l2(spark, sf):
    return retrieve.search(_queries_from_vectors(spark, sf), None, k=10, metric="l2", index=_index(spark, sf))


def q_retrieve_table(spark, sf):
    pairs = _pairs(spark, sf)
    side = chat.serve(pairs, _enc())
    return retrieve.retrieve_table(pairs.select("pair_id", "q", "a"), side.passages, _enc(), k=1,
                                   qkey="pair_id", passage_vecs=side.vectors)


def q_retrieve_table_ids(spark, sf):
    pairs = _pairs(spark, sf)
    ds = pairs.select(F.col("pair_id").alias("id"), F.col("q").alias("question"))
    side = chat.serve(pairs, _enc())
    return retrieve.retrieve_table_ids(ds, side.passages, _enc(), k=2, passage_vecs=side.vectors)


def q_retrieve_with_truth(spark, sf):
    docs = src.read_table(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("pid"), "text")
    truth = src.truth_queries(spark, sf)
    return retrieve.retrieve_table_ids(truth, docs, _enc(), k=1, passage_vecs=stores.embedding_store(docs, _enc()))


def q_search_passages(spark, sf):
    # the question of the R13 call is one string; it is searched over the whole corpus
    side = chat.serve(_pairs(spark, sf), _enc())
    return retrieve.search_passages(spark, "Que la vie est belle, et le monde aussi.", side.passages,
                                    _enc(), k=10, passage_vecs=side.vectors)


def q_lookup_passage(spark, sf):
    pairs = _pairs(spark, sf)
    passages = src.passages(pairs)
    qv = encode.guard_zero_vector(encode.encode_queries(pairs.select(F.col("pair_id").alias("qid"), "q"),
                                                        "qid", "q", _enc()), "vec", "quarantine")
    hits = exact.topk_exact_bulk(qv, encode.encode_passages(passages, "pid", "text", _enc()), k=1, dim=DIM)
    return retrieve.lookup_passage(hits, passages, "text")


# ------------------------------------------------------- evaluation (V)
def _batched_vectors(spark, sf):
    vp = src.vector_pairs(spark, sf)
    b = sampling.shuffled_batches(vp.select("pair_id"), "pair_id", 64, epoch=0, seed=SEED)
    return b.join(vp, "pair_id")


def q_inbatch_logits(spark, sf):
    lg = evaluate.inbatch_logits(_batched_vectors(spark, sf))
    return lg.withColumn("logit", F.round("logit", SCORE_DECIMALS))


def q_inbatch_log_softmax(spark, sf):
    lp = evaluate.inbatch_log_softmax(evaluate.inbatch_logits(_batched_vectors(spark, sf)))
    return lp.select("batch_id", "i", "j", F.round("logp", SCORE_DECIMALS).alias("logp"))


def q_inbatch_predict(spark, sf):
    return evaluate.inbatch_predict(evaluate.inbatch_logits(_batched_vectors(spark, sf)))


def q_inbatch_loss(spark, sf):
    lp = evaluate.inbatch_log_softmax(evaluate.inbatch_logits(_batched_vectors(spark, sf)))
    return evaluate.inbatch_loss(lp).withColumn("loss", F.round("loss", SCORE_DECIMALS))


def q_epoch_loss(spark, sf):
    lp = evaluate.inbatch_log_softmax(evaluate.inbatch_logits(_batched_vectors(spark, sf)))
    return evaluate.epoch_loss(evaluate.inbatch_loss(lp)).withColumn("loss", F.round("loss", SCORE_DECIMALS))


def q_epoch_accuracy(spark, sf):
    acc = evaluate.epoch_accuracy(evaluate.inbatch_predict(evaluate.inbatch_logits(_batched_vectors(spark, sf))))
    return acc.withColumn("acc", F.round("acc", SCORE_DECIMALS))


# ------------------------------------------------------- generation (G)
def _refine_top1_prompts(spark, sf):
    return chat.refine_prompts(chat._top1(src.utterances(spark, sf), _pairs(spark, sf), _enc(), "quarantine"))


def q_generate_batch(spark, sf):
    return generate.generate_batch(_refine_top1_prompts(spark, sf), generate.CopyGenerator(), "prompt", 5)


def q_constrain_candidates(spark, sf):
    """Candidates = the lines of every assistant turn, scored by line order; ids padded past the maximum, so that
    a line whose last token is unknown holds the banned sequence."""
    conv = src.read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    lines = conv.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("cand", "reply"))
    lines = lines.withColumn("line", F.struct("conv_id", "turn", "cand"))
    ids = voc.pad_truncate(voc.encode_tokens(lines, "line", "reply", _vocab(spark, sf), out="ids"), "ids", 37)
    cands = src.with_turn_id(lines.join(ids, "line"), conv, "qid").select(
        "qid", F.col("cand").cast("int"), "reply",
        (-F.col("cand")).cast("double").alias("score"), "ids")
    return generate.constrain_candidates(cands, None, min_length=5, max_length=36, n_best=5).drop("ids")


# -------------------------------------------------------- pipelines (L)
def q_refine_dataset(spark, sf):
    return datasets.refine_dataset(_pairs(spark, sf), _vocab(spark, sf), _enc(), 0.3, SEED)


def q_generator_dataset(spark, sf):
    return datasets.generator_dataset(_pairs(spark, sf), _vocab(spark, sf))


def q_dpr_dataset(spark, sf):
    return datasets.dpr_dataset(_pairs(spark, sf), _vocab(spark, sf))


def q_chat_retriever(spark, sf):
    return chat.chat_retriever(src.utterances(spark, sf), _pairs(spark, sf), _enc())


def q_chat_generator(spark, sf):
    return chat.chat_generator(src.utterances(spark, sf))


def q_chat_refine(spark, sf):
    return chat.chat_refine(src.utterances(spark, sf), _pairs(spark, sf), _enc())


def q_chat_modes(spark, sf):
    """The mode choice: any value but the two named ones means refine."""
    utts, side = src.utterances(spark, sf), chat.serve(_pairs(spark, sf), _enc())
    found = None
    for mode in ("generator", "retriever", "anything else"):
        kw = {} if mode == "generator" else {"encoder": _enc()}
        part = chat.chat(utts, side, mode, **kw)
        cand = F.col("cand") if "cand" in part.columns else F.lit(None)
        part = part.select(F.lit(mode).alias("mode"), "utt_id", cand.cast("int").alias("cand"), "reply")
        found = part if found is None else found.union(part)
    return found


def q_chat_stream(spark, sf):
    import uuid
    # a micro-batch searches the whole corpus, so their number follows the bytes and not the number of files
    stream = chat_stream.utterance_stream(spark, f"{sf.rstrip('/')}/conversations*.parquet", max_bytes_per_trigger=chat_stream.TRIGGER_BYTES)
    sink = chat_stream.run_chat_stream(spark, stream, _pairs(spark, sf), _enc(), f"chat-{uuid.uuid4().hex[:8]}")
    return chat_stream.read_replies(spark, sink)


def q_evaluate_retriever(spark, sf):
    return datasets.evaluate_retriever(_pairs(spark, sf), _enc(), 0.8, 20, SEED)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

"""DuckDB twins of the registered queries (the correctness gate).

Each string runs on DuckDB with the driver's tables registered as views.
Shared pieces (fixtures, hashed encoder, seeded hash) are composed here once.
Fixed values repeated from the library: markers <s> </s>; special ids
<pad>=0 <unk>=1 <s>=2 </s>=3; seed 42; 64 hashed dimensions; 6 decimals.
"""

from __future__ import annotations

DIM = 64

# ids of turns: short, wide, and the place among all turns that fit neither form (fixed values of the library)
_SHORT = "(turn between 0 and 99 and conv_id > -(1::bigint << 55) and conv_id < (1::bigint << 55))"
_WIDE = "(turn >= 100 and turn < 1 << 30 and conv_id >= 0 and conv_id < (1::bigint << 32))"
TURNS = f"""(select *, case when {_SHORT} then conv_id * 100 + turn when {_WIDE} then (1::bigint << 62) + conv_id * (1 << 30) + turn
  when conv_id is not null and turn is not null
  then (-9223372036854775808::hugeint + dense_rank() over (partition by conv_id is null or turn is null or {_SHORT} or {_WIDE} order by conv_id, turn) - 1)::bigint end turn_id
  from conversations)"""
PAIRS = f"""select turn_id pair_id, text q, a
from (select conv_id, turn, turn_id, role, text,
             lead(text) over (partition by conv_id order by turn) a,
             lead(role) over (partition by conv_id order by turn) nr
      from {TURNS}) t
where role = 'user' and nr = 'assistant'"""

UTTERANCES = f"select turn_id utt_id, text from {TURNS} where role = 'user'"

VECTORS = "select vec_id pid, embedding vec from embeddings"


def hash32(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 8))::bigint)"


def unit(seed: int, key: str, salt: str = "") -> str:
    inner = f"'{seed}:{salt}' || cast({key} as varchar)"
    return f"({hash32(inner)} / 4294967296.0)"


def strip_blank(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x0B\x85]+|[\s\p{{Z}}\x0B\x85]+$', '', 'g')"


def wrap(x: str) -> str:
    return f"('<s>' || {x} || '</s>')"


def enc_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({x}, '</?s>', ' ', 'g')), '[\p{{L}}\p{{N}}]+')"


def vocab_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '</?s>|[\p{{L}}\p{{N}}]+')"


def hashed_sparse(src: str, prefix: str, dim: int = DIM) -> str:
    """CTEs ``{prefix}_sp(id, dim, w)`` for a CTE ``src(id, t)``: hashed counts, L2-normalised, float."""
    return f"""{prefix}_tok as (select id, unnest({enc_tokens('t')}) tok from {src}),
{prefix}_cnt as (select id, ({hash32('tok')} % {dim})::int dim, count(*)::double c from {prefix}_tok group by all),
{prefix}_sp as (select id, dim, (c / sqrt(sum(c * c) over (partition by id)))::float w from {prefix}_cnt)"""


def hashed_dense(prefix: str, dim: int = DIM) -> str:
    """CTE ``{prefix}_vec(id, vec FLOAT[])`` from ``{prefix}_sp`` and ``{prefix}_ids(id)``."""
    return f"""{prefix}_vec as (
  select i.id, list(coalesce(s.w, 0::float) order by g.dim) vec
  from {prefix}_ids i cross join (select range::int dim from range({dim})) g
  left join {prefix}_sp s on s.id = i.id and s.dim = g.dim
  group by i.id)"""


def hashed_scores(q: str, p: str, p_ids: str) -> str:
    """CTE ``scores(qid, pid, score)``: every non-zero query against every passage."""
    return f"""sc_sparse as (select a.id qid, b.id pid, sum(a.w::double * b.w::double) s
  from {q}_sp a join {p}_sp b using (dim) group by all),
scores as (select q.qid, p.id pid, round(coalesce(s.s, 0), 6) score
  from (select distinct id qid from {q}_sp) q cross join {p_ids} p
  left join sc_sparse s on s.qid = q.qid and s.pid = p.id)"""


def topk(scores: str, k: int, desc: bool = True) -> str:
    order = "score desc" if desc else "score asc"
    return f"""select qid, rk::int rk, pid, score from (
  select *, row_number() over (partition by qid order by {order}, pid) rk from {scores}) where rk <= {k}"""


CHAT_RETRIEVER = f"""with pairs as ({PAIRS}),
utt as ({UTTERANCES}),
uq as (select utt_id id, {wrap(strip_blank('text'))} t from utt),
pp as (select pair_id id, a t from pairs),
{hashed_sparse('uq', 'q')},
{hashed_sparse('pp', 'p')},
{hashed_scores('q', 'p', '(select id from pp)')},
top as ({topk('scores', 1)})
select u.utt_id, t.pid, t.score, p.a reply
from utt u left join top t on t.qid = u.utt_id left join pairs p on p.pair_id = t.pid"""


# ----------------------------------------------------------------- shared CTEs
SEED = 42
VOCAB = r"""vt as (select unnest(regexp_extract_all(lower(text), '</?s>|[\p{L}\p{N}]+')) token from conversations),
vc as (select token, count(*) cnt from vt where token not in ('<s>', '</s>') group by token having count(*) >= 2),
vocab as (
  select * from (values ('<pad>', 0, NULL::bigint), ('<unk>', 1, NULL::bigint), ('<s>', 2, NULL::bigint),
                        ('</s>', 3, NULL::bigint)) s(token, id, count)
  union all
  select token, (row_number() over (order by cnt desc, token) + 3)::int id, cnt count from vc)"""


def token_ids(src: str, key: str, text: str, name: str) -> str:
    """CTE ``name(key, ids INT[])``: vocabulary ids of ``text`` (unknown -> 1), empty list for no token."""
    return f"""{name}_t as (select {key}, unnest(tk) token, generate_subscripts(tk, 1) pos
    from (select {key}, {vocab_tokens(text)} tk from {src})),
{name} as (select s.{key}, coalesce(list(coalesce(v.id, 1) order by t.pos) filter (where t.pos is not null),
                                     []::int[]) ids
    from {src} s left join {name}_t t on t.{key} = s.{key} left join vocab v on v.token = t.token
    group by s.{key})"""


def padded(name: str) -> str:
    """Columns ``ids_p`` and ``mask_p`` of CTE ``name`` padded to the longest row of the column."""
    return f"""{name}_p as (select *, list_resize(ids, m, 0) ids_p,
    list_transform(range(m), lambda i: case when i < len(ids) then 1 else 0 end)::int[] mask_p
    from {name}, (select max(len(ids)) m from {name}))"""


def hash_rank(key: str, salt: str = "") -> str:
    """Dense rank in seeded-hash order (h, key), as B0 defines it."""
    h = hash32(f"'{SEED}:{salt}' || cast({key} as varchar)")
    return f"row_number() over (order by {h}, {key})"


# ------------------------------------------------------------------ oracles
def _with(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


P = f"pairs as ({PAIRS})"
U = f"utt as ({UTTERANCES})"
V = f"v as ({VECTORS})"

Q: dict[str, str] = {}

# sources
Q["read_pairs"] = PAIRS
Q["utterances"] = UTTERANCES
Q["read_pairs_csv"] = _with(P) + """select row_number() over (order by pair_id) - 1 pair_id, q, a from pairs
  where q is not null and a is not null"""
Q["corpus_profile"] = _with(P) + """select count(*) rows_before, count(*) filter (where q is not null and a is not null) rows_after,
  count(a) passages, count(distinct a) distinct_answers, count(distinct q) distinct_questions from pairs"""
Q["passage_ids"] = _with(P) + "select pair_id pid, row_number() over (order by pair_id) - 1 pos, a text from pairs"

# projections
Q["wrap_special"] = _with(P) + f"select pair_id, {wrap('q')} q, {wrap('a')} a from pairs"
Q["normalize_utterance"] = _with(U) + f"select utt_id, {wrap(strip_blank('text'))} prompt from utt"
Q["gold_prompt"] = _with(P) + f"select pair_id, {wrap('a')} || {wrap('q')} prompt from pairs"

# tokens
Q["build_vocab"] = _with(VOCAB) + "select token, id, count from vocab"
Q["encode_tokens"] = _with(P, VOCAB, token_ids("pairs", "pair_id", "q", "qi")) + \
    "select pair_id, ids input_ids from qi"
Q["pad_longest"] = _with(P, VOCAB, token_ids("pairs", "pair_id", "q", "qi"), padded("qi")) + \
    "select pair_id, ids_p input_ids, mask_p attention_mask from qi_p"
Q["pad_truncate"] = _with(P, VOCAB, token_ids("pairs", "pair_id", "q", "qi")) + \
    """select pair_id, list_resize(ids[1:512], 512, 0) input_ids,
  list_transform(range(512), lambda i: case when i < len(ids[1:512]) then 1 else 0 end)::int[] attention_mask from qi"""
Q["attention_mask"] = _with(P, VOCAB, token_ids("pairs", "pair_id", "a", "ai"), padded("ai")) + \
    "select pair_id, mask_p attention_mask from ai_p"
Q["token_type_ids"] = _with(P) + f"""select pair_id, list_transform({vocab_tokens('q')}, lambda x: 0)::int[] token_type_ids from pairs"""
_GEN = [P, "pw as (select pair_id, " + wrap("q") + " wq, " + wrap("a") + " wa from pairs)", VOCAB,
        token_ids("pw", "pair_id", "wq", "qi"), padded("qi"), token_ids("pw", "pair_id", "wa", "ai"), padded("ai")]
Q["labels_column"] = _with(*_GEN) + "select pair_id, ids_p labels from ai_p"
Q["generator_dataset"] = _with(*_GEN) + """select q.pair_id, q.ids_p input_ids, q.mask_p attention_mask, a.ids_p labels
from qi_p q join ai_p a using (pair_id)"""
Q["example_rows"] = _with(*_GEN) + """select count(*) n_examples, max(len(q.ids_p))::int input_len, max(len(a.ids_p))::int label_len
from qi_p q join ai_p a using (pair_id)"""
Q["dpr_dataset"] = _with(P, VOCAB, token_ids("pairs", "pair_id", "q", "qi"), padded("qi"),
                         token_ids("pairs", "pair_id", "a", "ai"), padded("ai")) + \
    """select q.pair_id, q.ids_p q_input_ids, q.mask_p q_attention_mask, a.ids_p a_input_ids, a.mask_p a_attention_mask
from qi_p q join ai_p a using (pair_id)"""
Q["decode_tokens"] = _with(P, "pw as (select pair_id, " + wrap("a") + " wa from pairs)", VOCAB) + \
    f"""select p.pair_id, coalesce(string_agg(v.token, ' ' order by t.pos) filter (where v.id >= 4), '') text
from pw p left join (select pair_id, unnest(tk) token, generate_subscripts(tk, 1) pos
                     from (select pair_id, {vocab_tokens('wa')} tk from pw)) t on t.pair_id = p.pair_id
left join vocab v on v.token = t.token
group by p.pair_id"""
Q["answer_tail"] = _with(P, "pw as (select pair_id, " + wrap("q") + " || " + wrap("a") + " t, " + wrap("q") +
                         " wq from pairs)", VOCAB, token_ids("pw", "pair_id", "t", "fi"),
                         token_ids("pw", "pair_id", "wq", "pi")) + \
    "select f.pair_id, f.ids[len(p.ids) + 1:] tail_ids from fi f join pi p using (pair_id)"

# sampling
Q["global_rank"] = _with(P) + f"select pair_id, {hash_rank('pair_id')} rank from pairs"
Q["bernoulli_mix"] = _with(P) + f"select pair_id, q from pairs where {unit(SEED, 'pair_id')} < 0.3"
Q["exact_split"] = _with(P, f"r as (select pair_id, {hash_rank('pair_id')} rk, count(*) over () n from pairs)") + \
    "select pair_id, case when rk <= floor(n * 0.8) then 'train' else 'valid' end split from r"
Q["sequential_batches"] = _with(P, "r as (select pair_id, row_number() over (order by pair_id) rk from pairs)") + \
    "select pair_id, (rk - 1) // 20 batch_id, (rk - 1) % 20 pos_in_batch from r"
Q["shuffled_batches"] = _with(P, f"r as (select pair_id, {hash_rank('pair_id', '0:')} rk from pairs)") + \
    "select pair_id, (rk - 1) // 64 batch_id, (rk - 1) % 64 pos_in_batch from r"

# encoding
Q["encode_passages"] = _with(P, "pp as (select pair_id id, a t from pairs)", hashed_sparse("pp", "p"),
                             "p_ids as (select id from pp)", hashed_dense("p")) + "select id pid, vec from p_vec"
Q["embedding_store"] = Q["encode_passages"]
Q["encode_incremental"] = _with("pp as (select doc_id id, text t from documents)", hashed_sparse("pp", "p"),
                                "p_ids as (select id from pp)", hashed_dense("p")) + "select id pid, vec from p_vec"
Q["encode_queries"] = _with(U, f"uq as (select utt_id id, {wrap(strip_blank('text'))} t from utt)",
                            hashed_sparse("uq", "q"), "q_ids as (select id from uq)", hashed_dense("q")) + \
    "select id qid, vec from q_vec"
Q["guard_zero_vector"] = _with(U) + f"select utt_id qid, len({enc_tokens(wrap(strip_blank('text')))}) = 0 zero_vector from utt"
Q["tfidf_encoder"] = _with(
    P, "pp as (select pair_id id, a t from pairs)",
    f"p_tok as (select id, unnest({enc_tokens('t')}) tok from pp)",
    f"p_cnt as (select id, ({hash32('tok')} % {DIM})::int dim, count(*)::double c from p_tok group by all)",
    "dfc as (select dim, count(*) df from p_cnt group by dim)",
    "n as (select count(*) n from pp)",
    "p_w as (select id, dim, c * ln((n + 1)::double / (df + 1)) w from p_cnt join dfc using (dim), n)",
    "p_sp as (select id, dim, (w / sqrt(sum(w * w) over (partition by id)))::float w from p_w)",
    "p_ids as (select id from pp)", hashed_dense("p")) + "select id pid, vec from p_vec"

# retrieval with the hashed encoder
_PP = ["pp as (select pair_id id, a t from pairs)", hashed_sparse("pp", "p")]


def _pair_hits(k: int, wrapped: bool = True) -> list[str]:
    qt = wrap("q") if wrapped else "q"
    return [P, f"pq as (select pair_id id, {qt} t from pairs)", hashed_sparse("pq", "q"), *_PP,
            hashed_scores("q", "p", "(select id from pp)"), f"hits as ({topk('scores', k)})"]


Q["refine_prompt"] = _with(*_pair_hits(1)) + f"""select h.qid pair_id, {wrap('q.q')} || {wrap('p.a')} prompt
from hits h join pairs q on q.pair_id = h.qid join pairs p on p.pair_id = h.pid"""
Q["lookup_passage"] = _with(*_pair_hits(1)) + \
    "select h.qid, h.pid, h.score, p.a text from hits h join pairs p on p.pair_id = h.pid"
Q["join_context"] = _with(*_pair_hits(3, wrapped=False)) + \
    """select h.qid, list(h.pid order by h.rk) context_id, string_agg(p.a, ' ' order by h.rk) context
from hits h join pairs p on p.pair_id = h.pid group by h.qid"""
Q["retrieve_table"] = _with(*_pair_hits(1, wrapped=False)) + \
    """select q.pair_id, q.q, q.a, c.context retrieve from pairs q left join (
  select h.qid, string_agg(p.a, ' ' order by h.rk) context from hits h join pairs p on p.pair_id = h.pid group by h.qid
) c on c.qid = q.pair_id"""
Q["retrieve_table_ids"] = _with(*_pair_hits(2, wrapped=False)) + \
    """select q.pair_id id, q.q question, c.context_id, c.context from pairs q left join (
  select h.qid, list(h.pid order by h.rk) context_id, string_agg(p.a, ' ' order by h.rk) context
  from hits h join pairs p on p.pair_id = h.pid group by h.qid
) c on c.qid = q.pair_id"""
Q["search_passages"] = _with(
    P, *_PP, "sq as (select 0::bigint id, 'Que la vie est belle, et le monde aussi.' t)", hashed_sparse("sq", "q"),
    hashed_scores("q", "p", "(select id from pp)"), f"hits as ({topk('scores', 10)})") + \
    "select h.rk, h.pid, h.score, p.a text from hits h join pairs p on p.pair_id = h.pid"
TRUTH = """truth as (
  select b.item_id id, b.text question, min(d.text) context, list_sort(array_agg(distinct d.text)) answers
  from benchmark b join documents d on contains(d.text, b.text) group by b.item_id, b.text)"""
Q["retrieve_with_truth"] = _with(
    TRUTH, "tq as (select id, question t from truth)", hashed_sparse("tq", "q"),
    "dd as (select doc_id id, text t from documents)", hashed_sparse("dd", "p"),
    hashed_scores("q", "p", "(select id from dd)"), f"hits as ({topk('scores', 1)})") + \
    """select t.id, t.question, c.context_id, c.context, t.context original_context, t.answers
from truth t left join (
  select h.qid, list(h.pid order by h.rk) context_id, string_agg(d.text, ' ' order by h.rk) context
  from hits h join documents d on d.doc_id = h.pid group by h.qid
) c on c.qid = t.id"""

# exact search on the given vectors
_DOT = "round(list_dot_product(a.vec::double[], b.vec::double[]), 6)"
_L2 = "round(pow(list_distance(a.vec::double[], b.vec::double[]), 2), 6)"
MEAN = """mq as (select list(m order by pos)::float[] vec from (
  select pos, avg(x::double) m from (select unnest(vec) x, generate_subscripts(vec, 1) pos from v) group by pos))"""
Q["score_pairs"] = _with(V) + f"""select a.pid // 2 pair_id, round(list_dot_product(a.vec::double[], b.vec::double[]), 6) score
from v a join v b on b.pid = a.pid - 1 where a.pid % 2 = 1"""
Q["topk_exact_bulk"] = _with(V, f"scores as (select a.pid qid, b.pid, {_DOT} score from v a, v b)") + topk("scores", 10)
Q["topk_l2"] = _with(V, f"scores as (select a.pid qid, b.pid, {_L2} score from v a, v b)") + topk("scores", 10, desc=False)
Q["topk_exact"] = _with(V, MEAN, f"scores as (select 0 qid, b.pid, {_DOT} score from mq a, v b)") + \
    f"select rk, pid, score from ({topk('scores', 10)})"

# clustered index: hash-sample centroids + 2 Lloyd steps, 8-bit codes
_ASSIGN = "round(pow(list_distance(x.vec::double[], c.vec), 2), 9)"


def _assign(cents: str, name: str) -> str:
    return f"""{name} as (select pid, cell, vec from (
  select x.pid, c.cell, x.vec, row_number() over (partition by x.pid order by {_ASSIGN}, c.cell) r
  from v x, {cents} c) where r = 1)"""


def _step(prev: str, assigned: str, name: str) -> str:
    return f"""{name}_m as (select cell, list(m order by pos) vec from (
  select cell, pos, avg(x::double) m from (select cell, unnest(vec) x, generate_subscripts(vec, 1) pos from {assigned})
  group by cell, pos) group by cell),
{name} as (select o.cell, coalesce(m.vec, o.vec) vec from {prev} o left join {name}_m m using (cell))"""


IVF = [V,
       f"c0 as (select (rk - 1)::int cell, vec::double[] vec from (select pid, vec, {hash_rank('pid')} rk from v) where rk <= 16)",
       _assign("c0", "a0"), _step("c0", "a0", "c1"), _assign("c1", "a1"), _step("c1", "a1", "c2"),
       _assign("c2", "a2"),
       """el as (select pid, unnest(vec)::double x, generate_subscripts(vec, 1) pos from v)""",
       """bounds as (select pos, min(x) lo, max(x) hi from el group by pos)""",
       """codes as (select pid, list(case when hi = lo then 0 else
    least(255, greatest(0, floor((x - lo) / (hi - lo) * 255.0 + 0.5))) end::smallint order by pos) code
  from el join bounds using (pos) group by pid)""",
       """dec as (select pid, list(lo + (c::double * (hi - lo)) / 255.0 order by pos) dvec from (
  select pid, unnest(code) c, generate_subscripts(code, 1) pos from codes) join bounds using (pos) group by pid)"""]
Q["ivf_train"] = _with(*IVF) + "select cell, list_transform(vec, lambda x: round(x, 6)) vec from c2"
Q["sq_encode"] = _with(*IVF) + "select pid, code from codes"
Q["ivf_add"] = _with(*IVF) + "select pid, cell from a2"
Q["index_store"] = _with(*IVF) + "select a2.pid, a2.cell, codes.code from a2 join codes using (pid)"


def _ann(queries: str, score: str) -> str:
    """Every vector as its code decodes to: bounded probing gives what reading all cells gives."""
    return f"scores as (select q.qid, d.pid, round({score}, 6) score from {queries} q, dec d)"


_ANN_DOT, _ANN_L2 = "list_dot_product(q.vec::double[], d.dvec)", "pow(list_distance(q.vec::double[], d.dvec), 2)"
Q["ann_search_bulk"] = _with(*IVF, "qs as (select pid qid, vec from v)", _ann("qs", _ANN_DOT)) + topk("scores", 10)
Q["ann_search_l2"] = _with(*IVF, "qs as (select pid qid, vec from v)", _ann("qs", _ANN_L2)) + topk("scores", 10, desc=False)
Q["ann_search"] = _with(*IVF, MEAN, "qs as (select 0 qid, vec from mq)", _ann("qs", _ANN_DOT)) + \
    f"select rk, pid, score from ({topk('scores', 10)})"

# in-batch evaluation on vector pairs, batches of 64 in seeded order (epoch 0)
VB = [V, """vp as (select q.pid // 2 pair_id, q.vec q_vec, a.vec a_vec from v q join v a on a.pid = q.pid + 1
  where q.pid % 2 = 0)""",
      f"b as (select *, ({hash_rank('pair_id', '0:')} - 1) // 64 batch_id, ({hash_rank('pair_id', '0:')} - 1) % 64 pos from vp)",
      """lg as (select x.batch_id, x.pos i, y.pos j, list_dot_product(x.a_vec::double[], y.q_vec::double[]) logit
  from b x join b y using (batch_id))""",
      """lp as (select *, logit - m - ln(sum(exp(logit - m)) over (partition by batch_id, i)) logp from (
  select *, max(logit) over (partition by batch_id, i) m from lg))""",
      """pr as (select batch_id, i, j pred from (select *, row_number() over (partition by batch_id, i
  order by logit desc, j) r from lg) where r = 1)""",
      """bl as (select batch_id, avg(-logp) loss, count(*) n from lp where i = j group by batch_id)"""]
Q["inbatch_logits"] = _with(*VB) + "select batch_id, i, j, round(logit, 6) logit from lg"
Q["inbatch_log_softmax"] = _with(*VB) + "select batch_id, i, j, round(logp, 6) logp from lp"
Q["inbatch_predict"] = _with(*VB) + "select batch_id, i, pred from pr"
Q["inbatch_loss"] = _with(*VB) + "select batch_id, round(loss, 6) loss, n from bl"
Q["epoch_loss"] = _with(*VB) + "select round(avg(loss), 6) loss, count(*) batches from bl"
Q["epoch_accuracy"] = _with(*VB) + "select round(sum(case when pred = i then 1 else 0 end) / count(*), 6) acc from pr"

# retriever evaluation on text pairs: exact 80/20 split, validation batches of 20
Q["evaluate_retriever"] = _with(
    P, f"r as (select pair_id, q, a, {hash_rank('pair_id')} rk, count(*) over () n from pairs)",
    "valid as (select pair_id, q, a from r where rk > floor(n * 0.8))",
    "vq as (select pair_id id, q t from valid)", hashed_sparse("vq", "q"), "q_ids as (select id from vq)",
    hashed_dense("q"),
    "va as (select pair_id id, a t from valid)", hashed_sparse("va", "p"), "p_ids as (select id from va)",
    hashed_dense("p"),
    f"""b as (select v.pair_id, ({hash_rank('v.pair_id', '0:')} - 1) // 20 batch_id,
  ({hash_rank('v.pair_id', '0:')} - 1) % 20 pos, q.vec q_vec, a.vec a_vec
  from valid v join q_vec q on q.id = v.pair_id join p_vec a on a.id = v.pair_id)""",
    *VB[3:]) + """select round(avg(loss), 6) loss,
  (select round(sum(case when pred = i then 1 else 0 end) / count(*), 6) from pr) acc, count(*) batches from bl"""

# decoding constraints on the lines of every assistant turn
def _constrained(src: str, min_len: int, max_len: int, n_best: int, banned: str = "false") -> str:
    """CTE ``kept``: replies cut at the maximum; passing candidates first, else the best one with its reason."""
    cut = f"""array_to_string(string_split(regexp_replace(replace(reply, chr(1), ''),
      '((?i:</?s>)|[\\p{{L}}\\p{{N}}]+)', '\\1' || chr(1), 'g'), chr(1))[1:{max_len}], '')"""
    return f"""kept as (select qid, cand, reply, score, reason from (
  select *, row_number() over (partition by qid order by reason is not null, score desc, cand) r from (
    select *, case when len(t) < {min_len} then 'min_length' when len(list_distinct(bg)) < len(bg) then 'repeated_bigram'
      when {banned} then 'banned' end reason from (
      select * exclude (t, reply), t[1:{max_len}] t, case when len(t) > {max_len} then {cut} else reply end reply,
        list_transform(range(1, least(len(t), {max_len})), lambda i: t[i] || ' ' || t[i + 1]) bg
      from (select *, {vocab_tokens('reply')} t from {src}))))
  where r <= {n_best} and (reason is null or r = 1))"""


Q["constrain_candidates"] = _with(
    VOCAB,
    f"""lines as (select {{'c': conv_id, 't': turn, 'l': cand}} line, turn_id qid, cand, reply, (-cand)::double score
  from (select conv_id, turn, turn_id, (generate_subscripts(ls, 1) - 1)::int cand, unnest(ls) reply
    from (select conv_id, turn, turn_id, string_split(text, chr(10)) ls from {TURNS} where role = 'assistant')))""",
    token_ids("lines", "line", "reply", "li"),
    "cands as (select l.*, i.ids from lines l join li i using (line))",
    _constrained("cands", 5, 36, 5, "len(ids) between 1 and 35 and ids[-1] = 1")) + \
    "select qid, cand, reply, score, reason from kept"

# pipelines
Q["chat_retriever"] = CHAT_RETRIEVER
Q["chat_stream"] = CHAT_RETRIEVER
Q["refine_dataset"] = _with(
    P, VOCAB, f"ch as (select pair_id, {wrap('q')} t from pairs where {unit(SEED, 'pair_id')} < 0.3)",
    "chq as (select pair_id id, t from ch)", hashed_sparse("chq", "q"), *_PP,
    hashed_scores("q", "p", "(select id from pp)"), f"hits as ({topk('scores', 1)})",
    f"""pr as (select q.pair_id, case when p.a is not null then {wrap('q.q')} || {wrap('p.a')}
    else {wrap('q.a')} || {wrap('q.q')} end prompt, {wrap('q.a')} target
  from pairs q left join hits h on h.qid = q.pair_id left join pairs p on p.pair_id = h.pid)""",
    token_ids("pr", "pair_id", "prompt", "xi"), padded("xi"), token_ids("pr", "pair_id", "target", "yi"),
    padded("yi")) + """select x.pair_id, x.ids_p input_ids, x.mask_p attention_mask, y.ids_p labels
from xi_p x join yi_p y using (pair_id)"""


# generation with the copy model: candidates = stripped last segment, then its stripped first line
def py_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x0B\x1C-\x1F\x85]+|[\s\p{{Z}}\x0B\x1C-\x1F\x85]+$', '', 'g')"


CHAT_TOP = [P, U, f"uq as (select utt_id id, {wrap(strip_blank('text'))} t from utt)", hashed_sparse("uq", "q"),
            *_PP, hashed_scores("q", "p", "(select id from pp)"), f"top as ({topk('scores', 1)})",
            f"""pr as (select u.utt_id qid, t.pid, {wrap(strip_blank('u.text'))} || coalesce({wrap('p.a')}, '') prompt,
  coalesce(p.a, {strip_blank('u.text')}) base_raw
  from utt u left join top t on t.qid = u.utt_id left join pairs p on p.pair_id = t.pid)"""]


def _copy_cands(src: str, base: str) -> list[str]:
    return [f"cb as (select qid, {py_strip(base)} b from {src})",
            f"""cands as (select qid, 0::int cand, b reply, 0.0::double score from cb
  union all select qid, 1::int, {py_strip("split_part(b, chr(10), 1)")}, -1.0::double from cb
  where {py_strip("split_part(b, chr(10), 1)")} <> b)"""]


Q["generate_batch"] = _with(*CHAT_TOP, *_copy_cands("pr", "base_raw")) + "select qid, cand, reply, score from cands"
Q["chat_refine"] = _with(*CHAT_TOP, *_copy_cands("pr", "base_raw"), _constrained("cands", 5, 36, 5)) + \
    "select k.qid utt_id, p.pid, p.prompt, k.cand, k.reply, k.reason from kept k join pr p using (qid)"
Q["chat_generator"] = _with(U, f"gp as (select utt_id qid, {strip_blank('text')} base_raw from utt)",
                            *_copy_cands("gp", "base_raw"), _constrained("cands", 0, 128, 1)) + \
    "select qid utt_id, cand, reply, reason from kept"


Q["chat_modes"] = f"""select 'generator' mode, utt_id, cand, reply from ({Q['chat_generator']})
union all select 'retriever', utt_id, null::int, reply from ({Q['chat_retriever']})
union all select 'anything else', utt_id, cand, reply from ({Q['chat_refine']})"""


def oracle_sql() -> dict[str, str]:
    return dict(Q)

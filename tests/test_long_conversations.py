"""Conversations of more than 100 turns next to others: every utterance, pair and line keeps a row of its own."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import digest
from refinespark.sources import tables as src

TURNS = {1: 251, 2: 60, 3: 4}


def text_of(conv, turn):
    return f"turn {turn} of talk {conv}\nsecond line w{conv}x{turn} is here now"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", text_of(c, t)) for c, n in TURNS.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def asked(n):
    return sum((turns + 1) // 2 for turns in n.values())


def test_every_utterance_is_answered(spark, folder):
    texts = sorted(text_of(c, t) for c, n in TURNS.items() for t in range(0, n, 2))
    utts = {r.utt_id: r.text for r in src.utterances(spark, folder).collect()}
    assert sorted(utts.values()) == texts and len(utts) == asked(TURNS)
    pairs = {r.pair_id: (r.q, r.a) for r in src.conversation_pairs(spark, folder).collect()}
    assert sorted(pairs.values()) == sorted((text_of(c, t), text_of(c, t + 1)) for c, n in TURNS.items() for t in range(0, n - 1, 2))
    generated = E.queries()["chat_generator"](spark, folder).collect()
    assert sorted(r.utt_id for r in generated) == sorted(utts)
    assert all(r.reply == utts[r.utt_id] for r in generated)
    refined = E.queries()["chat_refine"](spark, folder).collect()
    assert {r.utt_id for r in refined} == set(utts)
    assert len({(r.utt_id, r.cand) for r in refined}) == len(refined)
    for r in refined:
        assert r.prompt == f"<s>{utts[r.utt_id]}</s><s>{pairs[r.pid][1]}</s>"
        assert pairs[r.pid][1].startswith(r.reply)


def test_every_turn_keeps_its_lines(spark, folder):
    kept = E.queries()["constrain_candidates"](spark, folder).collect()
    ids = {r.qid for r in kept}
    assert len(ids) == sum(n // 2 for n in TURNS.values())
    assert {r.reply for r in kept} == {x for c, n in TURNS.items() for t in range(1, n, 2) for x in text_of(c, t).split("\n")}


def test_ids_are_checked(spark):
    rows = [(1, 99), (0, 199), (1, 100), (2, 0), (-1, 5), ((1 << 32) - 1, (1 << 30) - 1), ((1 << 55) - 1, 99), (None, 3)]
    ids = [r[0] for r in spark.createDataFrame(rows, "conv_id long, turn long").select(src.turn_id()).collect()]
    assert len(set(ids)) == len(rows) and ids[0] == 199 and ids[4] == -95 and ids[-1] is None
    for conv, turn in ((1, -1), (1 << 32, 100), (1, 1 << 30), (1 << 55, 0), (-1, 100)):
        with pytest.raises(Exception, match="no id for conversation and turn"):
            spark.createDataFrame([(conv, turn)], "conv_id long, turn long").select(src.turn_id()).collect()


ODD = [(-(1 << 63), 0), (-(1 << 63), 1), ((1 << 63) - 1, 0), ((1 << 63) - 1, 1), (1 << 55, 0), (1 << 55, 1), (-7, 100), (-7, 101), (5, -2), (5, -1), (5, 0), (5, 1),
       (1 << 32, 99), (1 << 32, 100), (2, 1 << 30), (2, (1 << 30) + 1), (4, 200), (4, 201)]


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Hashed 64-bit conversation ids, negative and very large turns, nulls."""
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(c, t, "user" if i % 2 == 0 else "assistant", f"line {i} of\na talk with {c} at {t} here") for i, (c, t) in enumerate(ODD)]
    rows += [(None, 1, "user", "no talk"), (3, None, "user", "no turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def test_any_64_bit_ids_have_ids_of_their_own(spark, odd_folder):
    utts = {r.utt_id: r.text for r in src.utterances(spark, odd_folder).where("utt_id is not null").collect()}
    pairs = {r.pair_id: r.q for r in src.conversation_pairs(spark, odd_folder).collect()}
    assert len(utts) == len(pairs) == len(ODD) // 2
    assert pairs == utts  # both readers give a turn the same id
    assert src.utterances(spark, odd_folder).where("utt_id is null").count() == 2


@pytest.mark.parametrize("name", ["utterances", "read_pairs", "constrain_candidates", "passage_ids"])
def test_twins_know_any_id(spark, folder, odd_folder, name):
    for path in (folder, odd_folder):
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
        df = E.queries()[name](spark, path)
        result = con.execute(E.oracle_sql()[name])
        assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest([d[0] for d in result.description], result.fetchall())

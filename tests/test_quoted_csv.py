"""Quoted CSV over many splits of a file, against the reader that takes a file whole."""

import csv
import random

import pytest

from refinespark.sources.quoted_csv import csv_records
from refinespark.sources.tables import read_pairs_csv


@pytest.fixture()
def small_splits(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in keep.items():
        spark.conf.set(k, v)


def odd_text(rng):
    parts = ["plain", "two words", "line\nbreak", "\n\n", 'a "quoted" word', "comma, here", "NA", "null", " ", "é", "cr\r\nlf", '"', "x" * 150]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_equals_the_python_reader_over_split_files(spark, small_splits, tmp_path, ending):
    rng = random.Random(len(ending))
    expected = []
    for name in ("a.csv", "b.csv", "c.csv"):
        rows = [(odd_text(rng), odd_text(rng)) for _ in range(rng.randrange(5, 40))]
        expected += rows
        with open(tmp_path / name, "w", newline="") as f:
            out = csv.writer(f, lineterminator=ending, quoting=csv.QUOTE_ALL)
            out.writerows([("Q", "A"), *rows])
    got = read_pairs_csv(spark, str(tmp_path)).orderBy("pair_id").collect()
    assert [r.pair_id for r in got] == list(range(len(expected)))
    assert [(r.q, r.a) for r in got] == expected
    assert csv_records(spark, str(tmp_path)).rdd.getNumPartitions() >= 1


def test_a_record_over_many_splits_and_files_without_records(spark, small_splits, tmp_path):
    long = "\n".join(f"line {i} of a very long answer" for i in range(200))
    with open(tmp_path / "1.csv", "w", newline="") as f:
        csv.writer(f).writerows([("Q", "A"), ("before", long), ("after", "short")])
    (tmp_path / "2.csv").write_text("Q,A\n")
    (tmp_path / "3.csv").write_text('Q,A\nunquoted,text\n\n,empty question\n"","quoted empty"\nlast,one')
    got = [tuple(r) for r in read_pairs_csv(spark, str(tmp_path)).orderBy("pair_id").collect()]
    assert got[:2] == [(0, "before", long), (1, "after", "short")]
    whole = spark.read.schema("Q string, A string").option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path))
    assert sorted(r[1:] for r in got) == sorted(tuple(r) for r in whole.collect() if r.Q is not None and r.A is not None)


def test_first_pair_of_each_answer(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Q,A\nq0,same\nq1,other\nq2,same\n")
    got = sorted(tuple(r) for r in read_pairs_csv(spark, str(tmp_path), drop_duplicate_answers=True).collect())
    assert got == [(0, "q0", "same"), (1, "q1", "other")]


def test_profile_counts_what_loading_drops(spark, tmp_path):
    from refinespark.sources.tables import corpus_profile, read_csv_records
    (tmp_path / "p.csv").write_text("Q,A\nq0,same\n,no question\nno answer,\nq2,same\n")
    row = corpus_profile(read_csv_records(spark, str(tmp_path))).first()
    assert (row.rows_before, row.rows_after, row.passages, row.distinct_answers) == (4, 2, 3, 2)


def test_job_scope_removes_its_intermediates(spark):
    import os
    from refinespark.session import job_scope, materialise, shared_dir
    with job_scope(spark) as path:
        df = materialise(spark.range(5), "five")
        assert df.count() == 5 and os.path.isdir(path) and shared_dir(spark, "tables").startswith(path)
        assert not shared_dir(spark, "stores").startswith(path)
    assert not os.path.exists(path) and not shared_dir(spark, "tables").startswith(path)

"""Sequences that a task holds whole, against plain Python, SQL, and the operators that cut sequences over tasks."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runframe.operators import lookup, navigate, recover, whole

DATA = "/root/testdata/sf0.001"
ON_BWT = ["bwt", "phi", "phi_inv", "phi_rank", "phi_inv_rank", "phi_move", "phi_inv_move", "text_lf", "text_fl", "sa_phi", "sa_phi_inv", "cycle_order", "single_cycle"]


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def documents(spark, tmp_path, table, key, text):
    """A folder whose documents are the texts of another table, for which there is SQL."""
    spark.read.parquet(f"{DATA}/{table}.parquet").select(F.col(key).alias("doc_id"), F.col(text).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def by_sql(name):
    con = duckdb.connect()
    for table in ("part", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.sql(entry.oracle_sql()[name])
    return sorted(con.sql("SELECT " + ", ".join(f'"{c}"' for c in sorted(found.columns)) + " FROM found").fetchall(), key=repr)


@pytest.mark.parametrize("name", ON_BWT)
def test_documents_need_no_shuffle(spark, tmp_path, name):
    found = entry.queries()[f"doc_{name}"](spark, documents(spark, tmp_path, "part", "p_partkey", "p_name"))
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert rows_of(found) == by_sql(f"q_{name}")


@pytest.mark.parametrize("name", ["suffix_array", "bwt_long"])
def test_suffixes_need_no_shuffle(spark, tmp_path, name):
    found = entry.queries()[f"doc_{name}"](spark, documents(spark, tmp_path, "benchmark", "item_id", "text"))
    assert "Exchange" not in found._jdf.queryExecution().toString()
    assert rows_of(found) == by_sql(f"q_{name}")


def test_longer_texts_are_cut(spark, tmp_path, monkeypatch):
    folder = documents(spark, tmp_path, "part", "p_partkey", "p_name")
    cut, sort = [], recover.suffix_array
    monkeypatch.setattr(whole, "LONGEST", 10)  # some names are longer
    monkeypatch.setattr(recover, "suffix_array", lambda texts: cut.append(texts.count()) or sort(texts))
    for name in ("bwt", "phi_inv"):
        assert rows_of(entry.queries()[f"doc_{name}"](spark, folder)) == by_sql(f"q_{name}")
    assert len(cut) == 2 and all(0 < n < 200 for n in cut)


def test_suffixes_of_odd_texts(monkeypatch):
    rnd = random.Random(5)
    texts = ["banana", "", "a" * 70, "abcab" * 20, "\0a\1\0", "é😀a😀é\1", *("".join(rnd.choice("ab\0\1é") for _ in range(rnd.randrange(50))) for _ in range(200))]
    held = whole.laid_out(np.arange(len(texts)) + 7, texts)
    keys, places, before, suffixes = (c.to_pylist() if hasattr(c, "to_pylist") else c.tolist() for c in whole.bwt_rows(held))
    at = 0
    for number, text in enumerate(t + chr(1) for t in texts):
        order = sorted(range(len(text)), key=lambda p: text[p:])  # noqa: B023
        own = slice(at, at + len(text))
        assert (keys[own], places[own], suffixes[own], before[own]) == ([number + 7] * len(text), list(range(len(text))), order, [text[p - 1] for p in order])
        at += len(text)


@pytest.mark.parametrize("name", ["q_phi_rank", "q_phi_inv_rank", "q_cycle_order_any", "q_single_cycle_any", "q_phi_move_repeats", "q_phi_inv_move_repeats"])
def test_names_are_joined_with_nothing(spark, name):
    found = entry.queries()[name](spark, DATA)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert rows_of(found) == by_sql(name)


def test_work_is_dealt_out(spark, monkeypatch):
    names = spark.createDataFrame([(i, "abc") for i in range(100)] + [(100, None)], "seq_id long, text string").coalesce(1)
    monkeypatch.setattr(whole, "TASK", 200)
    assert whole.dealt(names, 5).rdd.getNumPartitions() == 11


@pytest.mark.parametrize("name", ["q_cycle_order_any", "q_single_cycle_any", "q_phi_inv_rank"])
def test_longer_names_are_cut(spark, monkeypatch, name):
    monkeypatch.setattr(whole, "LONGEST", 10)
    assert rows_of(entry.queries()[name](spark, DATA)) == by_sql(name)


def test_cycles_of_many_permutations():
    rnd = random.Random(6)
    perms = [rnd.sample(range(n), n) for n in (1, 2, 3, 9, 9, 30) for _ in range(20)]
    bounds = np.cumsum([0, *map(len, perms)])
    held = whole.Held(np.arange(len(perms)), bounds, np.zeros(bounds[-1], np.int64), None)
    found = sorted(zip(*(c.tolist() for c in whole.cycle_rows(held, np.concatenate([np.array(p) + b for p, b in zip(perms, bounds, strict=False)]))), strict=True))
    wanted = []
    for key, perm in enumerate(perms):
        at = 0
        for step in range(len(perm)):
            wanted.append((key, step, at))
            at = perm[at]
    assert found == wanted


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_search_sends_few_intervals(spark, monkeypatch, batch):
    rnd = random.Random(8)
    rows = [(s, k, start, length) for s in range(5) for k, (start, length) in enumerate(zip(range(0, 60, 3), [3, 2, 0, 1] * 5, strict=True))] + [(9, 0, 0, 200)]
    move = spark.createDataFrame(rows, "seq_id long, interval long, start long, length long")
    points = spark.createDataFrame([(rnd.choice([*range(6), 9, None]), rnd.choice([None, *range(-3, 70), 150, 1 << 40]), str(i)) for i in range(400)], "seq_id long, idx long, note string")
    monkeypatch.setattr(lookup, "MOST_BYTES", 0)
    wanted = sorted(map(repr, lookup.searched(points, move, "idx").collect()))
    monkeypatch.setattr(lookup, "searched", None)
    monkeypatch.setattr(lookup, "fits", lambda move: False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted(map(repr, navigate.locate(points, move, strategy="search").collect())) == wanted
        assert sorted(map(repr, lookup.searched_in_blocks(points, move, "idx", 7).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("text", ["", "a", "aa", "ba\0"])
def test_a_batch_of_one_short_text(text):
    marked = text + chr(1)
    assert whole.sorted_suffixes(whole.laid_out(np.arange(1), [text])).tolist() == sorted(range(len(marked)), key=lambda p: marked[p:])

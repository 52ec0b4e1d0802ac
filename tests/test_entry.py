"""The registry, and some queries held against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    names, sql = set(entry.queries()), set(entry.oracle_sql())
    assert sql <= names
    assert {n for n in names if n.startswith("q_")} <= sql
    assert {n for n in names if n.startswith("doc_")} - sql == {"doc_" + n for n in ("bwt", "bwt_long", "suffix_array", "phi", "phi_inv", "phi_rank", "phi_inv_rank", "phi_move", "phi_inv_move", "sa_phi", "sa_phi_inv", "cycle_order")}  # suffix sorting in SQL is too slow


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["i", "next_i", "interval", "off"]
    assert found.count() == 1500


@pytest.mark.parametrize("name", ["q_move_table", "q_split_move", "q_next_k", "q_pred", "q_succ_char", "q_fl_move", "q_phi_inv", "q_text_fl", "q_sa_phi", "q_store_roundtrip", "q_violations_broken", "q_pred_split", "q_cycle_order_any", "q_single_cycle_any", "q_phi_next", "q_power_table", "q_position_search", "q_chunks_fl", "q_store_points", "q_store_about", "q_file_bytes", "q_violations_null", "q_split_callback_python"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("orders", "events", "part", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    mine = sorted(map(tuple, found.select(*columns).collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(con.sql(f"SELECT {names} FROM ({entry.oracle_sql()[name]})").fetchall(), key=repr)
    assert mine == theirs

"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("PANELSTAT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

# the rest runs with tools/check_oracle.py or PANELSTAT_ALL_QUERIES=1
SAMPLE = ["a1_run_summary", "a5_agreement_matrix", "a13_fleiss_kappa", "a21_value_weights", "a24_uniform_null_p_values", "k5_gate_of_odd_vectors", "k4_top_k_similar", "r2_bootstrap_preference", "t1_live_tally", "t2_response_upsert", "v5_validate_cases"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("PANELSTAT_ALL_QUERIES") else SAMPLE)
def test_query(spark, duck, name):
    from tools.check_oracle import rows_of

    df = entry.queries()[name](spark, FOLDER)
    res = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, res.fetchall())


def test_entry_and_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    numbered = [n for n in entry.queries() if n.startswith("op")]
    assert len(numbered) in (0, 13) and ("pipeline" in entry.queries()) == bool(numbered)

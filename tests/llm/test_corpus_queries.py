"""The numbered queries on the smallest tables: their columns, and their SQL or figures of the whole result."""

import os

import pytest

from panelstat.llm.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("PANELSTAT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    1: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    2: {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    3: {"doc_id": "bigint", "bin_id": "bigint", "words": "bigint"},
    4: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    5: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    6: {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    7: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    8: {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    9: {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    10: {"doc_id": "bigint", "shard": "string", "shard_bytes": "bigint"},
    12: {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    13: {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
    11: {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}
NAMES = {int(n[2:].split("_")[0]): n for n in QUERIES}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    return con


def test_all_are_there():
    assert sorted(NAMES) == list(range(1, 1 + len(COLUMNS))) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("n", sorted(NAMES))
def test_columns_and_rows(spark, duck, n):
    df = QUERIES[NAMES[n]](spark, FOLDER)
    types = dict(df.dtypes)
    assert COLUMNS[n].items() <= types.items()
    rows = [r.asDict() for r in df.collect()]
    if n in (2, 4, 6, 7, 8, 9, 10, 11, 13):
        assert sorted(r["doc_id"] for r in rows) == sorted(x for (x,) in duck.execute("select doc_id from documents").fetchall())
    if NAMES[n] in ORACLES:
        res = duck.execute(ORACLES[NAMES[n]])
        names = [d[0] for d in res.description]
        assert set(names) == set(df.columns)
        key = lambda r: str([r[c] for c in sorted(names)])
        assert sorted(map(key, rows)) == sorted(key(dict(zip(names, r))) for r in res.fetchall())

import os
import random

import pytest
from pyspark.sql import functions as F
from test_ppm import brute, same, trained

from panelstat.llm import catalog, ppm
from panelstat.llm.common import table

FOLDER = os.environ.get("PANELSTAT_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("order", [6, 3, 2])
def test_every_gram_as_plain_model(docs, rows, order):
    same(ppm.scores(docs, trained(), order).collect(), brute(rows, order))


def test_rare_grams_stay_in_a_larger_corpus(spark):
    """What training texts say once is known however much else they say."""
    rnd = random.Random(4)
    rare = " ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(60))
    filler = "some words that come again and again in all of these texts " * 9000
    rows = [(0, rare), (1, rare)] + [(10 + i, filler) for i in range(12)]  # over 6 MB
    out = {r["doc_id"]: r for r in ppm.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") != 1).collect()}
    assert out[1]["held_out"] and out[1]["score"] == pytest.approx(out[0]["score"]) and out[1]["score"] > -0.5 * len(rare)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_takes_six_bytes_of_context(spark):
    got = {r["doc_id"]: r["score"] for r in catalog.op6_ppm_scores(spark, FOLDER).collect()}
    want = {r["doc_id"]: r["score"] for r in ppm.scores(table(spark, FOLDER, "documents"), ~catalog._held_out(5), 6).collect()}
    assert got == pytest.approx(want, rel=1e-9)

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.operators import hooks as H
from panelstat.operators import merge as J
from panelstat.operators import similarity as SIM


def cos(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(1)
    vec = {f"v{i:02}": rng.normal(size=8).astype(np.float32) for i in range(40)}
    vec |= {f"copy{i:02}": vec["v00"] for i in range(20)}  # a third of all rows are copies
    vec["zero"] = np.zeros(8, dtype=np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in vec.items()]
    return {k: v.astype(np.float64) for k, v in vec.items()}, spark.createDataFrame(rows, "case_id string, embedding array<float>").cache()


@pytest.mark.parametrize("blocks", [(1, 1), (1, 5), (3, 4)])
def test_nearest_is_exact(store, blocks):
    vec, df = store
    got = {}
    for r in SIM.top_k_similar(df, df, 4, q_blocks=blocks[0], c_blocks=blocks[1]).collect():
        got.setdefault(r.query, []).append((r["rank"], r.other, r.similarity))
    assert len(got) == len(vec)
    for q, hits in got.items():
        want = sorted(((-round(cos(vec[q], v), 12), k) for k, v in vec.items() if k != q))[:4]
        assert [h[1] for h in sorted(hits)] == [k for _, k in want]
        assert [h[2] for h in sorted(hits)] == pytest.approx([-s for s, _ in want], abs=1e-9)


def test_zero_query_honours_k(store):
    _, df = store
    hits = SIM.top_k_similar(df.filter("case_id = 'zero'"), df, 3).collect()
    assert len(hits) == 3 and all(h.similarity == 0 for h in hits)
    with pytest.raises(ValueError):
        SIM.top_k_similar(df, df, 0)


def test_gate(spark, store):
    vec, df = store
    new = spark.createDataFrame([("n1", [float(x) for x in vec["v05"] * 3]), ("n2", [float(x) for x in -vec["v05"]]), ("n3", None)], "case_id string, embedding array<float>")
    got = {r.id: r for r in SIM.diversity_gate(new, df, 0.95).collect()}
    assert not got["n1"].is_diverse and got["n1"].similar_id == "v05" and got["n1"].max_similarity == pytest.approx(1)
    assert got["n2"].is_diverse and got["n2"].similar_id is None
    assert got["n3"].is_diverse and got["n3"].max_similarity == 0
    empty = {r.id: (r.is_diverse, r.similar_id, r.max_similarity) for r in SIM.diversity_gate(new, df.limit(0)).collect()}
    assert set(empty.values()) == {(True, None, 0.0)}


def test_near_duplicates_of_a_large_copy_group(store):
    vec, df = store
    got = {r.id: r for r in SIM.near_duplicates(df, 0.999, q_blocks=2, c_blocks=3).collect()}
    assert set(got) == {"v00"} | {f"copy{i:02}" for i in range(20)}
    assert all(r.n_similar == 20 for r in got.values()) and got["v00"].nearest_id == "copy00"


def test_cosine_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r.s for r in df.select(SIM.cosine("a", "b").alias("s")).collect()] == pytest.approx([2**-0.5, 0])


def test_odd_vectors_are_like_nothing(spark):
    rows = [("a", [float("inf"), 1.0]), ("b", [1.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0, 0.1])]
    df = spark.createDataFrame(rows, "case_id string, embedding array<double>")
    best = {r.query: (r.other, round(r.similarity, 3)) for r in SIM.top_k_similar(df, df, 1).collect()}
    assert best == {"a": ("b", 0.0), "b": ("d", 0.995), "c": ("a", 0.0), "d": ("b", 0.995)}
    both = df.crossJoin(df.select(F.col("embedding").alias("o"), F.col("case_id").alias("k"))).filter("case_id in ('a', 'c') and k <> case_id")
    assert {r.s for r in both.select(SIM.cosine("embedding", "o").alias("s")).collect()} == {0.0}
    ragged = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("b", [1.0])], "case_id string, embedding array<double>")
    with pytest.raises(Exception, match="different lengths"):
        SIM.top_k_similar(ragged, ragged, 1, c_blocks=1).collect()


def test_projection(store):
    vec, df = store
    got = {r.case_id: (r.x, r.y) for r in SIM.project_2d(df).collect()}
    m = np.array([vec[k] for k in got])
    c = m - m.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = c @ vt[:2].T
    have = np.array(list(got.values()))
    assert all(np.allclose(have[:, j], want[:, j], atol=1e-5) or np.allclose(have[:, j], -want[:, j], atol=1e-5) for j in range(2))


def test_store_maintenance(spark, store):
    _, df = store
    cases = spark.createDataFrame([("v00", "approved"), ("v01", "needs_review"), ("new", "needs_review")], "case_id string, status string")
    few = df.filter("case_id in ('v00', 'v01', 'v02')")
    assert {r.case_id: r.reason for r in J.prune_plan(few, cases, ["needs_review"]).collect()} == {"v00": "status:approved", "v02": "deleted"}
    assert [r.case_id for r in SIM.missing_embeddings(cases, df).collect()] == ["new"]
    assert SIM.missing_embeddings(cases, df, force=True).count() == 3
    changed = spark.createDataFrame([("v00", [1.0]), ("new", [2.0])], "case_id string, embedding array<float>")
    after = {r.case_id: r.embedding for r in SIM.upsert_embeddings(few, changed).collect()}
    assert len(after) == 4 and after["v00"] == [1.0]
    assert SIM.remove_embeddings(few, changed).count() == 2
    assert SIM.store_statistics(df, "m").first().total_embeddings == 61


def test_hooks(spark):
    items = spark.createDataFrame([("a", "one two"), ("b", "one"), ("c", "")], "id string, t string")
    got = {r.case_id: r.embedding for r in H.embed(items, H.hashing_embedder(4), F.col("id"), F.col("t"), batch_size=2).collect()}
    assert sum(got["a"]) == 2 and sum(got["c"]) == 0
    with pytest.raises(Exception, match="vectors"):
        H.embed(items, lambda t: [], F.col("id"), F.col("t")).collect()
    work = spark.createDataFrame([("a", "m", 0), ("a", "n", 0)], "case_id string, rater string, run bigint")
    ans = H.respond(work, lambda pdf: ["x" if r == "m" else None for r in pdf["rater"]]).collect()
    assert [(r.rater, r.response_text) for r in ans] == [("m", "x")]


def test_choice_parsing(spark):
    rows = [("Wait ", "choice_1"), ("I recommend Choice 2 here", "choice_2"), ("operate now", "choice_2"), ("I cannot recommend either", "REFUSAL"),
            ("choice 1 or choice 2", None), ("no idea", None)]
    df = spark.createDataFrame([(t, "wait", "operate") for t, _ in rows], "response_text string, choice_1 string, choice_2 string")
    assert [r.parsed_choice for r in H.parse_choices(df).collect()] == [w for _, w in rows]
    own = H.parse_choices(df, lambda pdf: [None] * (len(pdf) - 1) + ["REFUSAL"])
    assert "REFUSAL" in [r.parsed_choice for r in own.coalesce(1).collect()]
    with pytest.raises(Exception, match="unknown choices"):
        H.parse_choices(df, lambda pdf: ["maybe"] * len(pdf)).collect()


def test_every_odd_vector_is_a_query(spark, tmp_path):
    """All vectors are searched for all; kinds change with the last digit of the id."""
    from panelstat.plans.catalog import QUERIES

    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=4).tolist(), 0) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["k4_top_k_of_odd_vectors"](spark, str(tmp_path)).collect()
    assert sorted({int(r["query"]) for r in out}) == list(range(200)) and len(out) == 1000
    assert {r["rank"] for r in out} == {1, 2, 3, 4, 5}
    assert {int(r["query"]) for r in out if r["similarity"] != 0} == {i for i in range(200) if i % 10 > 2}

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import neighbours, registry


def exact(ids, vectors, every, k=20):
    """{query: [(vec_id, score)]} by all pairs, in double precision."""
    vectors = np.asarray(vectors, dtype=np.float32).astype(np.float64)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            scores = vectors @ vectors[i]
            order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-scores[j], ids[j]))
            out[q] = [(ids[j], scores[j]) for j in order[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    return np.mean([len(set(found.get(q, [])) & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items()])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, sf, monkeypatch):
    """With leaves so small that the trees alone do not compare all pairs."""
    monkeypatch.setattr(neighbours, "LEAF", 256)
    rows = registry.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()
    want = exact([r[0] for r in rows], [r[1] for r in rows], 20)
    got = registry.QUERIES["op5_nearest_neighbours"](spark, sf).collect()
    assert len(got) == 20 * len(want) and recall(got, want) > 0.9
    scores = {(q, i): s for q, w in want.items() for i, s in w}
    for r in got:
        if (r["query_id"], r["vec_id"]) in scores:
            assert abs(r["score"] - scores[r["query_id"], r["vec_id"]]) < 1e-12


def test_awkward_rows(spark):
    v = [1.0, 2.0, 0.5]
    rows = [(i, v) for i in range(30)] + [(30 + i, [float(i), 1.0, 0.0]) for i in range(10)]
    bad = [(100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (200, [1.0]), (None, v)]
    df = spark.createDataFrame(rows + bad + rows[:2], "vec_id long, embedding array<float>").withColumns({"id": F.lit(0), "score": F.lit("x")})
    got = neighbours.nearest(df).orderBy("query_id", "rank").collect()
    want = exact([r[0] for r in rows], [r[1] for r in rows], 20)
    assert {r["query_id"] for r in got} == {0, 20}
    for q, w in want.items():
        assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q] == [(i, pytest.approx(s)) for i, s in w]
    assert neighbours.nearest(df.limit(0)).collect() == []
    one = spark.createDataFrame([(0, v)], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one).collect() == []


def test_recall_beside_a_few_large_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 256)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 32))[rng.integers(0, 200, 3000)] + rng.normal(size=(3000, 32)) * 0.5
    vectors[[5, 105, 205]] *= 100
    vectors[[7, 1007]] *= 1000
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors.astype(np.float32))]
    want = exact([r[0] for r in rows], vectors, 20)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert recall(got, want) > 0.9

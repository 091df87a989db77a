import numpy as np

from docloom.operators import vector_index


def test_many_codes_to_refine_are_not_broadcast(spark, tmp_path, monkeypatch):
    """beyond a bound the keys to be refined are joined by a shuffle, with the same results; queries' vectors don't go along with them."""
    x = np.random.default_rng(2).normal(size=(200, 8))
    vectors = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "doc_id long, embedding array<double>")
    index = vector_index.build(vectors, f"{tmp_path}/v", lists=4, parts=4)
    asked = vectors.where("doc_id % 50 = 0").selectExpr("doc_id as query", "embedding")
    want = sorted(tuple(r) for r in vector_index.search(index, asked, 5, 4, 40).collect())
    monkeypatch.setattr(vector_index, "BROADCAST_KEYS", 10)
    got = vector_index.search(index, asked, 5, 4, 40)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 20
    assert "ShuffledHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_centres_by_blocks(monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 7)
    rng = np.random.default_rng(3)
    x, at = rng.normal(size=(40, 5)), rng.normal(size=(6, 5))
    assert (vector_index._near(x, at)[0] == ((x[:, None] - at[None]) ** 2).sum(2).argmin(1)).all()

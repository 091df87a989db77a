import functools
import math
import operator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from docloom.operators import vector_index
from docloom.plans import catalogue


def test_true_neighbours_among_more_near_copies_than_are_refined(spark, tmp_path):
    """of 3,000 near copies that codes can't tell apart, the query finds the ten nearest, as its SQL does."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=64) + rng.normal(size=(3000, 64)) * 1e-4, rng.normal(size=(300, 64))])
    x[60:90] = x[7]  # equals, told apart by their ids
    x = x[rng.permutation(len(x))].astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([0] * len(x), pa.int32())}), f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query"], r.doc_id) for r in catalogue.QUERIES["dense_index_whole"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
        want = sorted(db.sql(f"select query, doc_id from ({catalogue.ORACLE['dense_index_whole']})").fetchall())
    assert len(want) == 660 and got == want


def test_whole_by_small_blocks(spark, tmp_path, monkeypatch):
    """blocks of queries and of rows, equals in many of them, vectors without a direction, those that went, and allowed ones."""
    for name, n in (("PASS", 3), ("BLOCK", 2), ("ROWS", 4)):
        monkeypatch.setattr(vector_index, name, n)
    rng = np.random.default_rng(6)
    x = rng.integers(-1, 2, size=(90, 3)).astype(float)
    rows = [(k // 2, k % 2, [float(c) for c in v]) for k, v in enumerate(x)] + [(90, 0, None), (91, 0, [1.0]), (92, 0, [float("nan")] * 3)]
    vectors = spark.createDataFrame(rows, "doc_id long, chunk_index int, embedding array<double>")
    index = vector_index.updated(vector_index.build(vectors, f"{tmp_path}/v", lists=3), gone=vectors.where("doc_id % 3 = 1"))
    asked = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(rng.normal(size=(7, 3)))] + [(7, [0.0] * 3), (8, [1.0, 1.0, 0.0])], "query long, embedding array<double>")
    for most in (99, 20):
        live = [(d, c, v) for d, c, v in rows[:90] if d % 3 != 1 and any(v) and d < most]
        got: dict = {}
        for r in vector_index.search_whole(index, asked, 6, None if most == 99 else vectors.where(f"doc_id < {most}").select("doc_id").distinct()).orderBy("query", "distance", "doc_id", "chunk_index").collect():
            got.setdefault(r["query"], []).append((r.doc_id, r.chunk_index))
        # In order, as the query's SQL adds up.
        dot = lambda a, b: functools.reduce(operator.add, map(operator.mul, a, b), 0.0)
        want = {r["query"]: [n[1:] for n in sorted((1 - dot(v, r.embedding) / (math.sqrt(dot(v, v)) * math.sqrt(dot(r.embedding, r.embedding))), d, c) for d, c, v in live)[:6]] for r in asked.collect() if any(r.embedding)}
        assert got == want and len(got) == 8
    assert vector_index.search_whole(index, asked.where("query = 7"), 6).count() == 0
    assert vector_index.search_whole(vector_index.build(vectors.where("false"), f"{tmp_path}/none"), asked, 6).count() == 0

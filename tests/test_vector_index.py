import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import dense, fusion, vector_index
from docloom.sources.versions import Conflict


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * 0.6
    x[300:600] = x[0] + rng.normal(size=(300, 24)) * 0.01  # a third of all in one place
    return [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0])]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>")


def true(rows, query, k, without=()):
    q = np.array(query)
    near = sorted((1 - float(np.dot(q, v)) / np.linalg.norm(q) / np.linalg.norm(v), d) for d, v in rows if v and len(v) == 24 and d < 1000 and d not in without)
    return [d for _, d in near[:k]]


def test_recall_and_exactness(spark, rows, vectors, tmp_path):
    index = vector_index.build(vectors, f"{tmp_path}/v", lists=30, parts=8)
    asked = vectors.where("doc_id % 50 = 0 and doc_id < 900").select(vectors.doc_id.alias("query"), "embedding")
    got = vector_index.search(index, asked, 10)
    want = vector_index.exact(vectors.where("doc_id < 900"), asked, 10)
    apart = "query < 300 or query >= 600"  # of the others, hundreds of neighbours are as near as can be
    r = vector_index.recall(got.where(apart), want.where(apart)).first()
    assert r.queries == 12 and r.recall >= 0.95
    far = lambda df: {x["query"]: x.d for x in df.groupBy("query").agg(F.max("distance").alias("d")).collect()}
    found, due = far(got), far(want)
    assert all(found[q] <= due[q] + 1e-3 for q in range(300, 600, 50)) and got.groupBy("query").count().where("count <> 10").count() == 0
    whole = {}
    for x in vector_index.search(index, asked, 5, probes=30, refined=400).orderBy("query", "distance", "doc_id").collect():
        whole.setdefault(x["query"], []).append(x.doc_id)
    for d, v in rows[:900:50]:
        assert whole[d] == true(rows, v, 5)
    one = index.nearest_lists(vector_index.unit([rows[0][1]], 24)[0], 4)[0].tolist()
    assert 0 < index.files(one) < index.files()
    none = spark.createDataFrame([(1, [0.0] * 24), (2, None)], "query long, embedding array<double>")
    assert vector_index.search(index, none, 3).count() == 0
    allowed = vectors.where("doc_id between 100 and 104").select("doc_id")
    got = [r.doc_id for r in vector_index.search(index, spark.createDataFrame([(1, rows[7][1])], "query long, embedding array<double>"), 3, 30, 50, allowed).orderBy("distance").collect()]
    assert got == [r.doc_id for r in dense.nearest(vectors, [rows[7][1]], 3, allowed).orderBy("distance").collect()]


def test_changes(spark, rows, vectors, tmp_path):
    index = vector_index.build(vectors, f"{tmp_path}/v", lists=10)
    gone = vectors.where("doc_id % 2 = 0").select("doc_id")
    after = vector_index.updated(index, gone=gone)
    back = vectors.where("doc_id = 4")
    last = vector_index.updated(vector_index.opened(spark, f"{tmp_path}/v"), back, gone.where("doc_id = 6"))
    with pytest.raises(Conflict):
        vector_index.updated(after, back)
    for k, (i, without) in enumerate([(index, ()), (after, range(0, 1000, 2)), (last, [d for d in range(0, 1000, 2) if d != 4])]):
        asked = spark.createDataFrame([(9, rows[4][1])], "query long, embedding array<double>")
        got = [r.doc_id for r in vector_index.search(i, asked, 4, probes=10, refined=200).orderBy("distance", "doc_id").collect()]
        assert got == true(rows, rows[4][1], 4, set(without)), k


def test_empty_and_chunks(spark, vectors, tmp_path):
    index = vector_index.build(vectors.where("false"), f"{tmp_path}/none")
    assert vector_index.nearest(index, [[1.0] * 24], 3).count() == 0
    two = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 1.0])], "doc_id long, chunk_index int, embedding array<double>")
    index = vector_index.build(two, f"{tmp_path}/two")
    assert [(r.doc_id, r.chunk_index) for r in vector_index.nearest(index, [[0.0, 2.0]], 2).orderBy("distance").collect()] == [(1, 1), (2, 0)]


def test_a_blank_first_line_does_not_hide_a_hit(spark):
    chunks = spark.createDataFrame([(1, 1, "second line", 1, 12), (1, 2, "third", 13, 18), (2, 0, "other", 0, 5)], "doc_id long, chunk_index int, text string, char_start int, char_end int")
    docs = spark.sql("select * from values (1L, 't', timestamp '2024-01-01', 'a'), (2L, 't', timestamp '2024-01-01', 'b'), (3L, '', timestamp '2024-01-01', 'c') as t(doc_id, text, modified_at, display_path)")
    now = F.lit("2024-01-02")
    of_docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [1.0, 0.0])], "doc_id long, embedding array<double>")
    got = fusion.hybrid_search(docs, chunks, of_docs, "zzz", [[1.0, 0.0]], now).collect()
    assert [(r.doc_id, r.chunk_index, r.quote) for r in got] == [(1, 1, "second line"), (2, 0, "other")]
    of_chunks = spark.createDataFrame([(1, 2, [1.0, 0.0]), (1, 1, [0.6, 0.8]), (2, 0, [0.8, 0.6])], "doc_id long, chunk_index int, embedding array<double>")
    got = fusion.hybrid_search(docs, chunks, of_chunks, "third", [[1.0, 0.0]], now).collect()
    assert [(r.doc_id, r.chunk_index) for r in got] == [(1, 2), (2, 0), (1, 1)] and got[0].lex == 1.0

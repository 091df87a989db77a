"""Every registered query of the plans against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "nation customer orders supplier events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if not math.isnan(v) else "nan"
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(db.sql(catalogue.ORACLE[name]).columns) == cols
    want = db.sql(f"select {', '.join(cols)} from ({catalogue.ORACLE[name]})").fetchall()
    assert sorted(str(plain(tuple(r[c] for c in cols))) for r in df.collect()) == sorted(str(plain(r)) for r in want)


def test_stream_debounce(spark, tmp_path):
    from docloom.streaming import watch

    rows = spark.sql("select * from values (timestamp '2024-01-01 00:00:00', 'created', 'a.md', null), (timestamp '2024-01-01 00:00:00.4', 'modified', 'a.md', null), (timestamp '2024-01-01 00:02:00', 'deleted', 'z.md', null) as t(ts, event_type, path, dest_path)")
    rows.write.parquet(f"{tmp_path}/in")
    seen, built = [], []
    q = watch.watch(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda df: seen.extend((r.path, r.event_type, r.n_events) for r in df.collect()), lambda: built.append(1), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert ("a.md", "modified", 2) in seen and built


def test_embedder_neighbours(spark):
    from docloom.operators import dense

    docs = spark.createDataFrame([(1, "budget plan costs"), (2, "cost plan numbers"), (3, "cats and dogs"), (4, "dogs chase cats"), (5, "")], "doc_id long, text string")
    e = dense.Embedder.fit(docs)
    v = {r.doc_id: r.embedding for r in e.embed(docs).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    counts = dense.token_rows(docs, dense.LEXICON)
    w = {}
    for r in dense.tfidf(counts, dense.vocabulary(counts, docs.count() + len(dense.LEXICON))).collect():
        w.setdefault(r.doc_id, {})[r.token] = r.w
    norm = lambda x: math.sqrt(sum(v * v for v in x.values()))
    plainly = lambda a, b: sum(x * w[b].get(t, 0) for t, x in w[a].items()) / norm(w[a]) / norm(w[b])
    # At full rank the projection keeps every cosine of the weighted vectors.
    assert all(abs(cos(a, b) - plainly(a, b)) < 1e-6 for a, b in [(1, 2), (3, 4), (1, 3), (2, 4)])
    assert cos(1, 2) > 0.3 and cos(3, 4) > 0.3 and abs(cos(1, 3)) < 1e-6 and not any(v[5])

"""Debounce by the clock, and index work that is done once whatever ends in between."""

import time
from datetime import UTC, datetime

import pytest

from docloom.sources.versions import Conflict, Store
from docloom.streaming import watch

EVENTS = "ts timestamp, event_id long, event_type string, path string, dest_path string"
T = "timestamp '2024-01-01 00:00:0{}'"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def at(s):
    return datetime.fromtimestamp(1_704_067_200 + s, UTC).replace(tzinfo=None)


ROWS = [
    (at(0), 1, "created", "a.md", None), (at(0.4), 2, "modified", "a.md", None), (at(3), 3, "modified", "a.md", None),
    (at(10), 4, "modified", "b.md", None), (at(10.2), 5, "modified", "c.md", None), (at(10.5), 6, "moved", "b.md", "c.md"),
    (at(20), 7, "moved", "d.md", "e.md"), (at(20.5), 8, "moved", "d.md", "e.md"), (at(20.6), 9, "created", "d.md", None),
    (at(30), 10, "moved", "f.md", "f.bin"), (at(40), 11, "moved", "g.md", None), (at(50), 12, "created", "h.md", None), (at(51), 13, "deleted", "h.md", None),
]
WANT = {
    ("a.md", "modified", None, at(0.4)), ("a.md", "modified", None, at(3)), ("b.md", "moved", "c.md", at(10.5)), ("d.md", "moved", "e.md", at(20.5)),
    ("d.md", "created", None, at(20.6)), ("f.md", "moved", "f.bin", at(30)), ("g.md", "deleted", None, at(40)), ("h.md", "deleted", None, at(51)),
}


def test_table(spark):
    assert {tuple(r) for r in watch.settled_table(spark.createDataFrame(ROWS, EVENTS)).collect()} == WANT


def wait(q, done, seconds=90):
    end = time.time() + seconds
    while time.time() < end and not done():
        if q.exception():
            raise q.exception()
        time.sleep(0.2)
    q.stop()
    assert done()


def test_stream_as_table_and_by_the_clock(spark, rocks, tmp_path):
    seen = []
    source = lambda: spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    put = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    start = lambda: watch.settled(source(), 1.0).writeStream.option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect()))).trigger(processingTime="300 milliseconds").start()
    put(ROWS)
    wait(start(), lambda: len(seen) >= len(WANT))
    assert set(seen) == WANT and len(seen) == len(WANT)
    soon = time.time() + 25  # what is pending when the query ends goes once the clock is there, after a restart
    when = datetime.fromtimestamp(soon, UTC).replace(tzinfo=None, microsecond=0)
    put([(when, 20, "modified", "z.md", None), (when, 21, "moved", "y.md", "x.md")])
    q = start()
    while not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.2)
    q.stop()
    early = len(seen)
    wait(start(), lambda: len(seen) == len(WANT) + 2)
    assert early == len(WANT) and set(seen) - WANT == {("z.md", "modified", None, when), ("y.md", "moved", "x.md", when)}


def test_work_is_done_once(spark, tmp_path):
    store, log = Store(spark, f"{tmp_path}/g"), []
    df = spark.range(1)

    class Killed(Exception):
        pass

    def killed():
        raise Killed

    index = lambda df: log.append("index") or {"docs": f"docs{len(log)}"}
    with pytest.raises(Killed):  # between index and rebuild
        watch.applied(store, "q", 0, df, index, killed)
    assert log == ["index"] and store.latest().facts["owed"]
    watch.applied(Store(spark, f"{tmp_path}/g"), "q", 0, df, index, lambda: log.append("rebuild") or {"vectors": "v1"})
    assert log == ["index", "rebuild"] and store.latest().tables == {"docs": "docs1", "vectors": "v1"}
    watch.applied(store, "q", 0, df, index, lambda: log.append("again"))  # the batch's own commit was lost: nothing is repeated
    assert log == ["index", "rebuild"] and not store.latest().facts["owed"]
    watch.applied(store, "q", 1, df, index, lambda: False)  # another one is building
    watch.applied(store, "q", 2, df.where("false"), index, lambda: log.append("owed"))
    assert log == ["index", "rebuild", "index", "owed"]


def test_generations(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    assert store.latest().generation == 0 and store.generations() == []
    one = store.commit(store.latest(), {"t": store.written(spark.range(3), "t")})
    two = store.commit(one, {"t": store.written(spark.range(5), "t")}, {"x": 1})
    with pytest.raises(Conflict):
        store.commit(one, {"t": store.written(spark.range(9), "t")})
    assert store.table("t").count() == 5 and store.table("t", one).count() == 3 and store.latest() == store.at(2) == two
    tries = []

    def change(base):
        tries.append(base.generation)
        if len(tries) == 1:
            store.commit(base, {**base.tables, "u": "other"})  # another writer is faster
        return {**base.tables, "n": "new"}, base.facts

    assert store.changed(change).tables.keys() == {"t", "u", "n"} and tries == [2, 3]
    store.written(spark.range(1), "draft")
    assert store.pruned(keep=1) == ["000000000001.json", "000000000002.json", "000000000003.json"]  # folders are too new to go
    assert len(store.pruned(keep=1, grace=-1)) == 3 and store.table("t").count() == 5

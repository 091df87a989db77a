"""File events as a stream: trailing-edge debounce by path, moves, and rebuilds once per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.sources.versions import Store

DEBOUNCE = "1 second"


def split_moves(events: DataFrame) -> DataFrame:
    """A move is a deletion of its source and, if the destination has a parser, a change there."""
    supported = F.lower(F.regexp_extract("dest_path", r"\.([^./]+)$", 1)).isin("txt", "md", "docx", "pdf")
    legs = F.when(F.col("event_type") == "moved", F.filter(F.array(F.struct(F.lit("deleted").alias("t"), F.col("path").alias("p")), F.when(supported, F.struct(F.lit("modified").alias("t"), F.col("dest_path").alias("p")))), lambda x: x.isNotNull()))
    legs = F.coalesce(legs, F.array(F.struct(F.col("event_type").alias("t"), F.col("path").alias("p"))))
    rows = events.select("*", F.posexplode(legs).alias("step", "leg"))
    number = F.col("event_id") if "event_id" in events.columns else F.lit(0).cast("long")
    return rows.select("ts", F.col("leg.t").alias("event_type"), F.col("leg.p").alias("path"), (number * 2 + F.col("step")).alias("sequence"))


def debounced(events: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """One row for each run of events on a path less than ``gap`` apart; the last event of the run says what it is (by time,
    then by sequence, then by name, so that it never depends on the order of arrival).

    Works on streams and on tables: session windows close when the watermark passes their end.
    """
    rows = events if "sequence" in events.columns else events.withColumn("sequence", F.lit(0).cast("long"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("ts", gap), "path").agg(F.max_by("event_type", F.struct("ts", "sequence", "event_type")).alias("event_type"), F.count("*").alias("n_events")).select(
        "path", "event_type", "n_events", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("due")
    )


def debounced_batch(events: DataFrame, seconds: float = 1.0, key: str = "path", order: str = "event_id") -> DataFrame:
    """The same over a finished table, by gaps and islands."""
    w = W.partitionBy(key).orderBy("ts", order)
    fresh = F.coalesce((F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")) > seconds, F.lit(True))
    runs = events.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.max_by("event_type", F.struct("ts", order)).alias("event_type"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def changes(before: DataFrame, after: DataFrame, ts: Column) -> DataFrame:
    """The events between two listings (path, file_identity, modified_at, size_bytes): what appeared, changed, moved or went.

    A file whose identity is found under another path has moved; a path is looked at as a move's source or as itself, not both.
    """
    old, new = before.alias("o"), after.alias("n")
    moved = new.join(old, (F.col("n.file_identity") == F.col("o.file_identity")) & (F.col("n.path") != F.col("o.path"))).join(before.alias("b"), F.col("b.path") == F.col("n.path"), "left_anti")
    moved = moved.join(after.alias("a"), F.col("a.path") == F.col("o.path"), "left_anti").select(F.lit("moved").alias("event_type"), F.col("o.path").alias("path"), F.col("n.path").alias("dest_path"))
    both = new.join(old, F.col("n.path") == F.col("o.path"), "full_outer")
    differs = ~F.col("n.modified_at").eqNullSafe(F.col("o.modified_at")) | ~F.col("n.size_bytes").eqNullSafe(F.col("o.size_bytes")) | ~F.col("n.file_identity").eqNullSafe(F.col("o.file_identity"))
    kind = F.when(F.col("o.path").isNull(), "created").when(F.col("n.path").isNull(), "deleted").when(differs, "modified")
    rest = both.select(kind.alias("event_type"), F.coalesce("n.path", "o.path").alias("path")).where("event_type is not null")
    rest = rest.join(moved.select("path").unionByName(moved.select(F.col("dest_path").alias("path"))), "path", "left_anti")
    return moved.unionByName(rest.withColumn("dest_path", F.lit(None).cast("string"))).select(ts.alias("ts"), "event_type", "path", "dest_path")


def removals(settled: DataFrame, docs: DataFrame) -> DataFrame:
    """Deleted paths with their active document, and the result that is audited: a path without one is not_found, and asks for
    a rebuild all the same."""
    active = docs.where("not is_deleted").select("doc_id", "path")
    gone = settled.where("event_type = 'deleted'").select("path").distinct()
    return gone.join(active, "path", "left").withColumn("result", F.when(F.col("doc_id").isNull(), "not_found").otherwise("success"))


# --- by the clock ---------------------------------------------------------------------------------------------------------

LEGS = "ts timestamp, sequence long, kind string, path string, other string"
SETTLED = "path string, event_type string, dest_path string, ts timestamp"
SUPPORTED = ("txt", "md", "docx", "pdf")


def legs(events: DataFrame) -> DataFrame:
    """What each event means for a path: itself, or of a move ``from`` its source and ``to`` its destination."""
    number = F.col("event_id") if "event_id" in events.columns else F.lit(0).cast("long")
    moved = (F.col("event_type") == "moved") & F.col("dest_path").isNotNull()
    kind = F.when(F.col("event_type") == "moved", "deleted").otherwise(F.col("event_type"))
    leg = lambda k, path, other: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), F.col(path).alias("path"), other.alias("other"))
    none = F.lit(None).cast("string")
    parts = F.when(moved, F.array(leg("from", "path", F.col("dest_path")), leg("to", "dest_path", F.col("path")))).otherwise(F.array(leg(kind, "path", none)))
    return events.select(F.col("ts").cast("timestamp").alias("ts"), number.alias("sequence"), F.explode(parts).alias("leg")).select("ts", "sequence", "leg.*")


def settled_table(events: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(path, event_type, dest_path, ts) of the events of a finished table that nothing follows at their path within ``seconds``.

    A move cancels what is pending at both its paths, and waits by itself: only the same move takes its place.
    """
    rows = legs(events).withColumn("at", F.col("ts").cast("double"))
    w = W.partitionBy("path").orderBy("ts", "sequence", "kind", "other")
    own = W.partitionBy("path", "other", F.col("kind") == "from").orderBy("ts", "sequence", "kind")
    rows = rows.withColumn("next", F.when(F.col("kind") == "from", F.lead("at").over(own)).otherwise(F.lead("at").over(w)))
    still = F.col("next").isNull() | (F.round(F.col("next") - F.col("at"), 6) > seconds)
    return rows.where((F.col("kind") != "to") & still).select("path", F.when(F.col("kind") == "from", "moved").otherwise(F.col("kind")).alias("event_type"), F.col("other").alias("dest_path"), "ts")


class Debouncer(StatefulProcessor):
    """The same by path on a stream: what is pending is state, and a timer of the clock lets it go ``seconds`` after its time."""

    def __init__(self, seconds: float = 1.0):
        self.gap = int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "kind string, ts long")
        self.moves = handle.getMapState("moves", "dest string", "ts long")

    def _due(self, before: int, out: list) -> None:
        """Let go of what was due before a time, in microseconds."""
        if self.event.exists() and (got := self.event.get())[1] + self.gap < before:
            out.append((got[0], None, got[1]))
            self.event.clear()
        for (dest,), (ts,) in list(self.moves.iterator()):
            if ts + self.gap < before:
                out.append(("moved", dest, ts))
                self.moves.removeKey((dest,))

    def _timed(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [ts for _, (ts,) in self.moves.iterator()] + ([self.event.get()[1]] if self.event.exists() else [])
        if times:
            self.handle.registerTimer((min(times) + self.gap) // 1000 + 1)

    def _frame(self, path: str, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({"path": [path] * len(out), "event_type": [o[0] for o in out], "dest_path": [o[1] for o in out], "ts": pd.to_datetime([o[2] for o in out], unit="us")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got["us"] = got["ts"].astype("datetime64[us]").astype("int64")
        got = got.sort_values(["us", "sequence", "kind", "other"], na_position="first")
        out: list = []
        for us, kind, other in zip(got["us"], got["kind"], got["other"], strict=True):
            self._due(int(us), out)
            if kind == "from":
                self.event.clear()
                self.moves.updateValue((other,), (int(us),))
            elif kind == "to":
                self.event.clear()
            else:
                self.event.update((kind, int(us)))
        self._due(timerValues.getCurrentProcessingTimeInMs() * 1000, out)
        self._timed()
        yield from self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list = []
        self._due(expiredTimerInfo.getExpiryTimeInMs() * 1000, out)
        self._timed()
        yield from self._frame(key[0], out)

    def close(self) -> None:
        pass


def settled(events: DataFrame, seconds: float = 1.0) -> DataFrame:
    """(path, event_type, dest_path, ts) of a stream of events, as soon as the clock says that nothing followed. The session's state
    store has to be the RocksDB one, and the query needs a trigger that goes on, for timers are looked at once a batch."""
    return legs(events).groupBy("path").transformWithStateInPandas(Debouncer(seconds), outputStructType=SETTLED, outputMode="append", timeMode="processingTime")


def to_apply(done: DataFrame) -> DataFrame:
    """Settled events as index work (path, event_type): a move to a name without a parser is a deletion of its source, any other the
    deletion of its source and an event ``moved`` at its destination, where lineage finds the document by its identity."""
    fits = F.lower(F.regexp_extract("dest_path", r"\.([^./]+)$", 1)).isin(*SUPPORTED)
    pair = lambda path, kind: F.struct(F.col(path).alias("path"), F.lit(kind).alias("event_type"))
    moved = F.when(fits, F.array(pair("path", "deleted"), pair("dest_path", "moved"))).otherwise(F.array(pair("path", "deleted")))
    return done.select("ts", F.explode(F.when(F.col("event_type") == "moved", moved).otherwise(F.array(F.struct("path", "event_type")))).alias("x")).select("x.*", "ts")


Work = Callable[[DataFrame], "dict[str, str] | None"]
Rebuild = Callable[[], "dict[str, str] | bool | None"]


def _tables(made: object) -> dict[str, str]:
    return made if isinstance(made, dict) else {}


def applied(store: Store, source: str, batch: int, df: DataFrame, index: Work, rebuild: Rebuild) -> None:
    """One micro-batch, once: its index work and its number are one commit, and so are a rebuild and that none is owed any more. What is run again
    after a crash finds its number taken, and a rebuild that is still owed is made then. Both may return folders of tables."""
    now = store.latest()
    seen = now.facts.get("batches", {})
    if batch > seen.get(source, -1) and not df.isEmpty():
        now = store.commit(now, now.tables | _tables(index(df)), now.facts | {"batches": seen | {source: batch}, "owed": True})
    if now.facts.get("owed"):
        made = rebuild()
        if made is not False:
            store.commit(now, now.tables | _tables(made), now.facts | {"owed": False})


def watch(events: DataFrame, index: Work, rebuild: Rebuild, checkpoint: str, gap: str = DEBOUNCE, store: Store | None = None):
    """Apply each micro-batch's settled events through ``index`` and rebuild vectors once after it; batches run one at a time.

    A rebuild that finds another one building returns False; it is owed, and asked for again with the next batch, whether or not that has
    events, and after a restart. What is owed stands in the generations of ``store``, beside the tables that index and rebuild return.
    """
    store = store or Store(events.sparkSession, f"{checkpoint}/generations")
    work = lambda df, batch: applied(store, checkpoint, batch, df, index, rebuild)
    return debounced(split_moves(events), gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(work).trigger(availableNow=True).start()


def watch_by_clock(events: DataFrame, index: Work, rebuild: Rebuild, checkpoint: str, seconds: float = 1.0, every: str = "1 second", store: Store | None = None):
    """The same without end, by timers of the clock; ``index`` gets (path, event_type, ts)."""
    store = store or Store(events.sparkSession, f"{checkpoint}/generations")
    work = lambda df, batch: applied(store, checkpoint, batch, to_apply(df), index, rebuild)
    return settled(events, seconds).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(work).trigger(processingTime=every).start()

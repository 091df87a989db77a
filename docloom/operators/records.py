"""Lookups of memory, events, edges and knowledge; status reports, schema checks, tags and the golden gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import sync


def active_memory(memory: DataFrame) -> DataFrame:
    """Promoted items in use, the most important first."""
    return memory.where("status = 'active' and promotion_state = 'promoted'").orderBy(F.desc("importance"), "memory_id")


def memory_of(memory: DataFrame, scope: str, key: str) -> DataFrame:
    """The latest item of a scope and key."""
    return memory.where((F.col("scope") == scope) & (F.col("key") == key)).orderBy(F.desc("updated_at"), "memory_id").limit(1)


def memory_added(memory: DataFrame, new: DataFrame, events: DataFrame) -> DataFrame:
    """``memory`` with new items; ValueError unless all are of type M1 or M2, beyond one session, and cite events that exist."""
    wrong = new.where(~F.col("memory_type").isin("M1", "M2") | (F.col("scope_type") == "session") | (F.size("event_ids") == 0))
    if not wrong.isEmpty() or not sync.dangling(new, events).isEmpty():
        raise ValueError("memory has to be M1 or M2, of a lasting scope, and cite existing events")
    return memory.unionByName(new)


def events_by(events: DataFrame, limit: int | None = None, **equals) -> DataFrame:
    """Events by business key, scope or trace, the latest first."""
    for k, v in equals.items():
        events = events.where(F.col(k) == v)
    out = events.orderBy(F.desc("ts"), F.desc("event_id"))
    return out if limit is None else out.limit(limit)


def edges_from(edges: DataFrame, source: str) -> DataFrame:
    return edges.where(F.col("source_id") == source)


def reweighted(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the weights of ``new`` (source_id, target_id, weight), none of which may be negative."""
    if not new.where("weight < 0").isEmpty():
        raise ValueError("a weight is negative")
    to = new.select("source_id", "target_id", F.col("weight").alias("w"))
    return edges.join(to, ["source_id", "target_id"], "left").withColumn("weight", F.coalesce("w", "weight")).drop("w").select(*edges.columns)


def knowledge_of(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Knowledge items of active documents."""
    return items.join(docs.where("not is_deleted").select("doc_id"), "doc_id", "left_semi")


def tags_merged(old: Column, new: Column) -> Column:
    """Tags in order, cleaned, each once."""
    clean = F.transform(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def artifact_status(artifacts: DataFrame, now: Column) -> DataFrame:
    """Freshness and whether the committed generation can be read are told apart; a degraded artifact says why."""
    running = F.col("active_build_token").isNotNull() & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") >= now))
    readable = (F.col("generation") > 0) & F.coalesce("has_bundle", F.lit(False))
    why = F.when(~readable, "committed_bundle_missing").when(F.col("status") != "ready", F.col("last_reason"))
    return artifacts.select("artifact_name", F.col("status").alias("freshness"), running.alias("build_in_progress"), readable.alias("committed_readable"), ((F.col("status") != "ready") | ~readable).alias("degraded"), why.alias("degraded_reason"))


def reconciled(artifacts: DataFrame, now: Column) -> DataFrame:
    """Stored states brought in line with what is there: leases that have run out are cleared, and what the ladder of
    ``sync.stale_reason`` finds makes a ready artifact stale."""
    over = F.col("active_build_token").isNotNull() & (F.col("lease_expires_at") < now)
    reason = sync.stale_reason()
    drift = (F.col("status") == "ready") & reason.isNotNull()
    return artifacts.withColumns({
        "status": F.when(drift, "stale").otherwise(F.col("status")), "last_reason": F.when(drift, reason).when(over, "lease_expired").otherwise(F.col("last_reason")),
        "active_build_token": F.when(over, None).otherwise(F.col("active_build_token")), "lease_expires_at": F.when(over, None).otherwise(F.col("lease_expires_at")),
    })


def schema_issues(df: DataFrame, want: StructType) -> list[str]:
    """What keeps a table from being of a schema: columns that lack, are of another type, or may be null and should not."""
    have, out = {f.name: f for f in df.schema}, []
    for f in want:
        got = have.get(f.name)
        if got is None:
            out.append(f"{f.name}: missing")
        elif got.dataType != f.dataType:
            out.append(f"{f.name}: {got.dataType.simpleString()} instead of {f.dataType.simpleString()}")
        elif not f.nullable and not df.where(F.col(f"`{f.name}`").isNull()).isEmpty():
            out.append(f"{f.name}: null")
    return out


def golden(hits: DataFrame, cases: DataFrame, least: float = 0.9, top: int = 10, zero: float = 0.3) -> DataFrame:
    """One row: how many of the golden cases (case_id, doc_id; null: nothing should be found) pass, and whether that is enough.

    ``hits``: case_id, doc_id, rank, score. A case passes if its document is among the first ``top``; one that should find
    nothing if there is no hit of a score of ``zero`` or more.
    """
    first = hits.where(F.col("rank") <= top).withColumnRenamed("doc_id", "hit")
    per = cases.join(first, "case_id", "left").groupBy("case_id", "doc_id").agg(F.coalesce(F.bool_or(F.col("hit") == F.col("doc_id")), F.lit(False)).alias("found"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    ok = F.when(F.col("doc_id").isNull(), F.col("best") < zero).otherwise(F.col("found"))
    return per.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_passed")).select("*", (F.col("n_passed") >= least * F.col("n")).alias("passed"))

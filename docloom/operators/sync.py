"""Incremental synchronisation: what to skip, lineage, what is missing, metadata, status, artifacts, audit and memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sensitivities from the least to the most restrictive.
SENSITIVITIES = ["public", "internal", "sensitive"]


def unchanged(prev: str = "p", new: str = "n") -> Column:
    """A file is skipped if its document has the same path, identity, hash and configuration, was parsed, isn't deleted and has chunks."""
    same = [F.col(f"{prev}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in ("path", "file_identity", "hash_sha256", "source_config_rev")]
    out = F.coalesce(F.col(f"{prev}.parse_status") == "success", F.lit(False)) & ~F.col(f"{prev}.is_deleted") & (F.col(f"{prev}.n_chunks") > 0)
    for s in same:
        out = out & s
    return F.coalesce(out, F.lit(False))


def lineage(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Which document each scanned file continues: the one with its identity, else the one at its path if either side has no
    identity. A document is claimed once, by identity before by path, then by the first in name order; other files are new."""
    snap = snapshot.where("not is_deleted").select("doc_id", F.col("path").alias("old_path"), F.col("file_identity").alias("old_identity"))
    by_identity = files.join(snap, F.col("file_identity") == F.col("old_identity")).select("path", "doc_id", F.lit(1).alias("how"))
    rest = files.join(by_identity.select("path"), "path", "left_anti")
    by_path = rest.join(snap, F.col("path") == F.col("old_path")).where("file_identity is null or old_identity is null").select("path", "doc_id", F.lit(2).alias("how"))
    claims = by_identity.unionByName(by_path).withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy("how", "path"))).where("rn = 1")
    return files.join(claims.select("path", "doc_id", "how"), "path", "left").withColumn("how", F.element_at(F.array(F.lit("identity"), F.lit("path"), F.lit("new")), F.coalesce("how", F.lit(3))))


def missing(docs: DataFrame, seen: DataFrame, errors: list[str] | None = None) -> DataFrame:
    """Active documents whose path the scan did not see, unless it lies at or below a path that could not be read."""
    out = docs.where("not is_deleted").join(seen.select("path"), "path", "left_anti")
    for e in errors or []:
        out = out.where((F.col("path") != e) & ~F.col("path").startswith(e + "/"))
    return out


def merged_metadata(declared: str = "declared", default: str = "default") -> list[Column]:
    """Category: the declared one wins; tags: all of both; sensitivity: the more restrictive."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, SENSITIVITIES)), F.coalesce(c, F.lit("internal")))
    more = F.greatest(rank(F.col(f"{declared}_sensitivity")), rank(F.col(f"{default}_sensitivity")))
    tags = F.array_distinct(F.concat(F.coalesce(f"{default}_tags", F.array().cast("array<string>")), F.coalesce(f"{declared}_tags", F.array().cast("array<string>"))))
    return [F.coalesce(f"{declared}_category", f"{default}_category").alias("category"), tags.alias("tags"), F.element_at(F.array(*map(F.lit, SENSITIVITIES)), more.cast("int")).alias("sensitivity")]


def replaced(chunks: DataFrame, changed: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """A new version of a chunk table: the changed documents' old chunks go and their new ones come."""
    return chunks.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(new_chunks)


def soft_deleted(docs: DataFrame, gone: DataFrame) -> DataFrame:
    marks = gone.select("doc_id", F.lit(True).alias("gone")).distinct()
    return docs.join(marks, "doc_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).drop("gone")


def status(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.count_if(~F.col("is_deleted")).alias("active")).crossJoin(chunks.agg(F.count("*").alias("chunks")))  # one row each


def stale_reason() -> Column:
    """The first reason why an artifact isn't fresh, or null. Columns: status, has_bundle, chunk_count, indexed_count, model_hash, bundle_hash."""
    return (
        F.when(F.col("status") == "failed", "last_build_failed").when(F.col("status") == "building", "build_in_progress").when(~F.col("has_bundle"), "bundle_missing")
        .when(F.col("chunk_count") != F.col("indexed_count"), "count_mismatch").when(~F.col("model_hash").eqNullSafe(F.col("bundle_hash")), "model_mismatch").when(F.col("status") == "stale", "marked_stale")
    )


def gc_due(generations: DataFrame, now: Column) -> DataFrame:
    return generations.where((F.col("state") == "retained") & (F.col("delete_after") < now))


def audit(logs: DataFrame, now_from=None, now_to=None, limit: int = 200, paths: dict[str, str] | None = None, **equals) -> DataFrame:
    """Audit rows by column and by path in the JSON detail, the latest first."""
    for k, v in equals.items():
        logs = logs.where(F.col(k) == v)
    for k, v in (paths or {}).items():
        logs = logs.where(F.get_json_object("detail_json", k) == v)
    if now_from is not None:
        logs = logs.where(F.col("timestamp") >= now_from)
    if now_to is not None:
        logs = logs.where(F.col("timestamp") <= now_to)
    return logs.orderBy(F.desc("timestamp"), F.desc("audit_id")).limit(limit)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def dangling(memory: DataFrame, events: DataFrame) -> DataFrame:
    """Memory items that cite an event that does not exist, with how many."""
    cited = memory.select("memory_id", F.explode("event_ids").alias("event_id"))
    return cited.join(events.select("event_id"), "event_id", "left_anti").groupBy("memory_id").agg(F.count("*").alias("n_missing"))


def overlapping_roots(roots: DataFrame) -> DataFrame:
    """Pairs of active roots of which one lies at or below the other, by joining each path's ancestors to the roots."""
    active = roots.where("is_active").select("root_id", "path")
    above = active.select(F.col("root_id").alias("inner_id"), F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))).alias("path"))
    return above.join(active.withColumnRenamed("root_id", "outer_id"), "path").where("inner_id <> outer_id").select("outer_id", "inner_id")

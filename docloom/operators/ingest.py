"""Index writes: listings with identities, scan runs, sources, upserts, whole incremental runs, audit rows and garbage.

Tables are values: each step maps the tables as they are to their next version, which the caller writes and makes current.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking, sync
from docloom.sources import files
from docloom.sources.versions import Manifest, Store

LISTING = "path string, relative_path string, size_bytes long, created_at timestamp, modified_at timestamp, file_identity string, error string"
# Fields of a source whose change makes its documents be indexed anew, and those that may be changed.
REINDEXED = ("exclude_rules", "default_category", "default_tags", "default_sensitivity", "recursive")
CHANGEABLE = ("label", *REINDEXED, "is_active")


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Files of a mounted folder in the order of their names, hidden ones too; links are not followed. A folder or file that
    can't be read is a row with an error; a root that can't be read raises. Names and times only: contents are read by tasks."""
    rows, todo = [], [root.rstrip("/")]
    when = lambda t: datetime.fromtimestamp(int(t), UTC).replace(tzinfo=None)
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            if folder == root.rstrip("/"):
                raise
            rows.append((folder, os.path.relpath(folder, root), None, None, None, None, type(e).__name__))
            continue
        for e in entries:
            try:
                s = e.stat(follow_symlinks=False)
            except OSError as x:
                rows.append((e.path, os.path.relpath(e.path, root), None, None, None, None, type(x).__name__))
                continue
            if stat.S_ISREG(s.st_mode):
                born = getattr(s, "st_birthtime", min(s.st_ctime, s.st_mtime))
                rows.append((e.path, os.path.relpath(e.path, root), s.st_size, when(born), when(s.st_mtime), f"{s.st_dev}:{s.st_ino}" if s.st_ino > 0 else None, None))
        if recursive:
            todo += [e.path for e in reversed(entries) if e.is_dir(follow_symlinks=False)]
    return spark.createDataFrame(rows, LISTING)


def scan_run(decided: DataFrame, run_id: str, source_id: str, started: Column, finished: Column) -> DataFrame:
    """The row that a finished scan leaves. ``decided``: path, reason, and error where a path could not be read."""
    bad = F.col("error").isNotNull()
    return decided.agg(
        F.count_if(F.col("reason").isNull() & ~bad).alias("included_count"), F.count_if(F.col("reason").isNotNull() & ~bad).alias("excluded_count"),
        F.count_if((F.col("reason") == "unsupported_format") & ~bad).alias("unsupported_count"), F.count_if(bad).alias("failed_count"),
        F.slice(F.array_sort(F.collect_list(F.when(bad, F.struct("path", "error")))), 1, 100).alias("error_summary"),
    ).select(F.lit(run_id).alias("run_id"), F.lit(source_id).alias("source_id"), F.lit("completed").alias("status"), started.alias("started_at"), finished.alias("finished_at"), "*")


def failed_run(spark: SparkSession, run_id: str, source_id: str, started: Column, finished: Column, error: str) -> DataFrame:
    zero = [F.lit(0).cast("long").alias(f"{c}_count") for c in ("included", "excluded", "unsupported", "failed")]
    summary = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(error).alias("error"))).alias("error_summary")
    return spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(source_id).alias("source_id"), F.lit("failed").alias("status"), started.alias("started_at"), finished.alias("finished_at"), *zero, summary)


def source_added(roots: DataFrame, new: DataFrame) -> DataFrame:
    """``roots`` with a new one; ValueError if it lies at, above or below an active one."""
    both = roots.unionByName(new)
    over = sync.overlapping_roots(both).join(new.select("root_id"), (F.col("root_id") == F.col("outer_id")) | (F.col("root_id") == F.col("inner_id")), "left_semi").take(1)
    if over:
        raise ValueError(f"root {over[0].inner_id} lies within root {over[0].outer_id}")
    return both


def source_updated(sources: DataFrame, which: Column, **changes: Column) -> DataFrame:
    """Sources with new values; source_config_rev rises by one where a field that matters to the index really changes."""
    if unknown := sorted(set(changes) - set(CHANGEABLE)):
        raise ValueError(f"these fields can't be changed: {', '.join(unknown)}")
    moved = F.lit(False)
    for c in (c for c in changes if c in REINDEXED):
        moved = moved | ~F.col(c).eqNullSafe(changes[c])
    types = dict(sources.dtypes)
    new = {c: F.when(which, v.cast(types[c])).otherwise(F.col(c)) for c, v in changes.items()}
    return sources.withColumns(new | {"source_config_rev": F.col("source_config_rev") + F.when(which & moved, 1).otherwise(0)})


DOCUMENT = ["doc_id", "path", "relative_path", "display_path", "directory", "relative_directory", "file_identity", "source_path", "source_config_rev", "hash_sha256", "title", "file_type", "size_bytes", "modified_at", "indexed_at", "parse_status", "category", "tags", "sensitivity", "is_deleted"]


def upserted(docs: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """The next version of ``docs``: an incoming row replaces the one with its doc_id or is new.

    source_path stays as it was first; sensitivity is internal where none is told; a missing title is the file's stem; a
    document that could not be parsed has not been indexed.
    """
    old = docs.select("doc_id", F.col("source_path").alias("old_source"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    rows = incoming.join(old, "doc_id", "left").withColumns({
        "source_path": F.coalesce("old_source", "path"), "title": F.coalesce("title", stem), "sensitivity": F.coalesce("sensitivity", F.lit("internal")),
        "directory": tx.directory(F.col("path")), "relative_directory": tx.directory(F.col("relative_path")),
        "indexed_at": F.when(F.col("parse_status") != "failed", now), "is_deleted": F.lit(False),
    })
    return docs.select(*DOCUMENT).join(incoming.select("doc_id"), "doc_id", "left_anti").unionByName(rows.select(*DOCUMENT))


class Run(NamedTuple):
    docs: DataFrame
    chunks: DataFrame
    audit: DataFrame
    counts: DataFrame


def incremental(docs: DataFrame, chunks: DataFrame, files: DataFrame, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: Column, trace: str, errors: list[str] | None = None, force: bool = False) -> Run:
    """One run over a scan. ``files``: path, relative_path, display_path, file_identity, hash_sha256, source_config_rev, file_type,
    size_bytes, modified_at.

    Files continue documents by identity, then by path; a document whose path another file has taken is retired, and so
    are those whose file is missing (not below ``errors``); unchanged ones are skipped unless ``force`` (a full rebuild). ``parse`` maps
    the files to do, with their doc_id, to (facts by doc_id: title, parse_status, category, tags, sensitivity; chunks). A
    file that fails to parse is a row with status failed and loses its chunks; the others go on.
    """
    snap = docs.select("doc_id", "path", "file_identity", "is_deleted")
    claimed = sync.lineage(files.select("path", "file_identity"), snap)
    fresh_id = F.concat(F.lit("d-"), F.substring(F.sha2(F.concat_ws("|", "path", F.lit(trace)), 256), 1, 16))
    of = files.join(claimed.select("path", F.coalesce(F.col("doc_id").cast("string"), fresh_id).alias("doc_id"), "how"), "path")
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    prev = docs.join(n, "doc_id", "left").fillna(0, ["n_chunks"])
    seen = of.alias("n").join(prev.alias("p"), F.col("n.doc_id") == F.col("p.doc_id"), "left").select("n.*", (sync.unchanged() & F.lit(not force)).alias("skip"))
    todo = seen.where("not skip").drop("skip")
    facts, made = parse(todo)
    incoming = todo.drop("how").join(facts, "doc_id")
    taken = docs.where("not is_deleted").join(of.select("path", F.col("doc_id").alias("now_of")), "path").where("doc_id <> now_of").join(of.select("doc_id"), "doc_id", "left_anti")
    lost = sync.missing(docs, files, errors).join(of.select("doc_id"), "doc_id", "left_anti")
    gone = taken.select("doc_id", "path", F.lit("path_reused_by_different_document").alias("reason")).unionByName(lost.select("doc_id", "path", F.lit("missing_from_scan").alias("reason")))
    after = upserted(sync.soft_deleted(docs, gone), incoming, now)
    dropped = todo.select("doc_id").unionByName(gone.select("doc_id")).distinct()
    kept = chunks.join(dropped, "doc_id", "left_anti").unionByName(made.select(*chunks.columns))
    one = lambda df, what, result, detail: df.select(now.alias("timestamp"), F.lit("system").alias("actor"), F.lit(what).alias("operation"), F.lit("document").alias("target_type"), F.col("doc_id").alias("target_id"), result.alias("result"), F.to_json(F.struct(F.col("path").alias("file_path"), *detail)).alias("detail_json"), F.lit(trace).alias("trace_id"))
    logs = one(incoming, "index_document", F.when(F.col("parse_status") == "failed", "failure").otherwise("success"), ["parse_status"]).unionByName(one(gone, "remove_document", F.lit("success"), ["reason"]))
    state = seen.join(facts.select("doc_id", "parse_status"), "doc_id", "left").select(F.when(F.col("skip"), "skipped").otherwise(F.col("parse_status")).alias("status"))
    return Run(after, kept, logs, batch_counts(state.unionByName(gone.select(F.lit("removed").alias("status")))))


def batch_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def appended(logs: DataFrame, path: str) -> None:
    """Audit rows are only ever added: a Parquet table, and the same rows as JSON lines beside it, secrets taken out."""
    safe = tx.redacted_rows(logs)
    safe.write.mode("append").parquet(f"{path}/audit")
    safe.write.mode("append").json(f"{path}/audit_jsonl")


def next_due(generations: DataFrame) -> DataFrame:
    return generations.where("state = 'retained'").agg(F.min("delete_after").alias("next_due"))


def collected(spark: SparkSession, generations: DataFrame, now: Column) -> DataFrame:
    """Delete the folders of retired generations that are due; returns the generations' next version."""
    due = sync.gc_due(generations, now)
    for r in due.select("bundle_path").collect():  # one row a generation
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(r.bundle_path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    over = (F.col("state") == "retained") & (F.col("delete_after") < now)
    return generations.withColumn("state", F.when(over, "deleted").otherwise(F.col("state")))


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunks of each document numbered from 0 in the order of their place."""
    return chunks.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy("char_start", "char_end")) - 1)


def active_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """What an index is rebuilt from: chunks of documents that are not deleted."""
    return chunks.join(docs.where("not is_deleted").select("doc_id"), "doc_id", "left_semi")


AUDIT = "timestamp timestamp, actor string, operation string, target_type string, target_id string, result string, detail_json string, trace_id string"
CHUNKS = "doc_id string, chunk_index int, text string, char_start int, char_end int, page_no int, paragraph_start int, paragraph_end int, heading_path string, token_estimate int"
_TYPES = {"source_config_rev": "int", "size_bytes": "long", "modified_at": "timestamp", "indexed_at": "timestamp", "tags": "array<string>", "is_deleted": "boolean"}
DOCUMENTS = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in DOCUMENT)
FACTS = ["title", "parse_status", "category", "tags", "sensitivity"]


def parsed_once(store: Store, contents: DataFrame | None = None, config: dict | None = None, folders: list[str] | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A ``parse`` for ``incremental``: files are read (from ``contents``: path, content; else from their mounted folder), parsed and chunked by the
    tasks that have them, once: what comes of it is written, and facts, chunks, audit and counts all read that. ``folders`` gets what was
    written, to be deleted when these have been made."""

    def parse(todo: DataFrame) -> tuple[DataFrame, DataFrame]:
        spark, folders_ = store.spark, [] if folders is None else folders

        def written(df: DataFrame, name: str) -> DataFrame:
            folders_.append(store.written(df, name))
            return spark.read.parquet(folders_[-1])

        named = written(todo.select("doc_id", "path", "file_type").withColumn("row", F.monotonically_increasing_id()), "todo")
        rows = named.select(F.col("row").alias("doc_id"), "path", "file_type")
        if contents is not None:
            rows = rows.join(contents.select("path", "content"), "path", "left").withColumn("error_code", F.when(F.col("content").isNull(), "io_error"))
        else:
            rows = files.read_files(rows)
        parsed = written(files.parsed(rows), "parsed")
        made = written(chunking.chunks(parsed, **(config or {})), "made")
        of = named.select("row", F.col("doc_id").alias("name"))
        facts = parsed.join(of, F.col("doc_id") == F.col("row")).select(F.col("name").alias("doc_id"), *FACTS)
        return facts, made.join(of, F.col("doc_id") == F.col("row")).drop("doc_id", "row").withColumnRenamed("name", "doc_id")

    return parse


def committed_run(store: Store, scanned: DataFrame, now: Column, trace: str, contents: DataFrame | None = None, errors: list[str] | None = None, force: bool = False, config: dict | None = None, vectors: Callable[[DataFrame], str] | None = None) -> Manifest:
    """One incremental run over the generation that is current, committed as the next: documents, chunks and audit together.

    Readers see all of a run or nothing; of two runs from the same generation one gets ``Conflict``. ``vectors`` makes
    a bundle of the active chunks and returns its folder; it is part of the same generation, so that vectors never lag behind.
    Parsed texts and new chunks are written on the way and deleted when the run ends, committed or not.
    """
    spark, base, folders = store.spark, store.latest(), []
    table = lambda name, schema: spark.read.schema(schema).parquet(base.tables[name]) if name in base.tables else spark.createDataFrame([], schema)
    docs, chunks, logs = table("documents", DOCUMENTS), table("chunks", CHUNKS), table("audit", AUDIT)
    try:
        run = incremental(docs, chunks, scanned, parsed_once(store, contents, config, folders), now, trace, errors, force)
        tables = {"documents": store.written(run.docs.select(*DOCUMENT), "documents"), "chunks": store.written(run.chunks, "chunks"), "audit": store.written(logs.unionByName(tx.redacted_rows(run.audit)), "audit")}
        counts = {r.status: r.n for r in run.counts.collect()}  # a row for each status
        if vectors is not None:
            written = spark.read.parquet(tables["documents"])
            tables["vectors"] = vectors(active_chunks(spark.read.parquet(tables["chunks"]), written))
        return store.commit(base, base.tables | tables, base.facts | {"run": trace, "counts": counts})
    finally:
        store.removed(folders)

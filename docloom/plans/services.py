"""Registered queries of answering, evidence, index writes and records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import answering, dense, evidence, ingest, postings, records, sync
from docloom.plans import views
from docloom.plans.catalogue import ORACLE, QUERIES, near_sql, query, r6  # noqa: F401
from docloom.plans.views import NOW, SQL_CHUNKS, SQL_DOCS, table
from docloom.sources import charset
from docloom.sources.versions import Store
from docloom.streaming import watch

# --- answering ------------------------------------------------------------------------------------------------------------


@query("summary_bundle", """with c as (select doc_id as item, 1.0::double / (1 + doc_id) as score, line, p from (
  select doc_id, unnest(l) as line, unnest(range(len(l))) as p from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' -' || chr(9))), lambda x: x <> '') as l from documents where not regexp_matches(text, '[。！？!?；;]')))),
f as (select * from c where p < 2 qualify row_number() over (partition by lower(line) order by score desc, item, p) = 1)
select item as doc_id, line from f order by score desc, item, p limit 6""")
def summary_bundle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike("[。！？!?；;]"))
    items = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.col("source").alias("title"), F.col("source").alias("path"), (F.lit(1.0) / (1 + F.col("doc_id"))).alias("score"), F.col("doc_id").alias("item"), F.col("text").alias("preview"))
    return answering.summary_lines(answering.units(items)).select("doc_id", F.col("text").alias("line"))


# --- evidence -------------------------------------------------------------------------------------------------------------


def _hits(spark, sf_dir) -> DataFrame:
    return views.chunks(spark, sf_dir).where(F.lower("text").contains("retiti"))


@query("evidence_preview", f"""with {SQL_CHUNKS}, n as (select c.*, coalesce(lag(char_start) over w, char_start) as s, coalesce(lead(char_end) over w, char_end) as e from chunks c window w as (partition by doc_id order by chunk_index))
select n.doc_id, chunk_index, substr(d.text, s + 1, e - s) as preview, (char_start - s)::int as highlight_start, (char_end - s)::int as highlight_end from n join documents d on n.doc_id = d.doc_id where contains(lower(n.text), 'retiti')""")
def evidence_preview(spark, sf_dir):
    chunks = views.chunks(spark, sf_dir)
    paragraphs = chunks.select("doc_id", F.col("chunk_index").alias("index"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit(None).cast("int").alias("page_no"))
    hits = _hits(spark, sf_dir).select("doc_id", "chunk_index", "char_start", "char_end", F.lit(None).cast("int").alias("page_no"), tx.preview(F.col("text"), 120).alias("quote"))
    return evidence.stored_previews(hits, paragraphs, table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text")))


@query("evidence_located", f"""with {SQL_DOCS}, {SQL_CHUNKS}, t as (select doc_id, 0 as chunk_index from documents union all select doc_id, 100000 from documents where doc_id % 3 = 0)
select t.doc_id, t.chunk_index::int as chunk_index, (c.doc_id is not null and not d.is_deleted) as found, case when c.doc_id is not null and not d.is_deleted then c.char_start || '-' || c.char_end end as char_range,
 (c.doc_id is not null and not d.is_deleted) as can_open, case when c.doc_id is not null and not d.is_deleted then 'file://' || d.path end as uri
from t left join chunks c on t.doc_id = c.doc_id and t.chunk_index = c.chunk_index left join docs d on t.doc_id = d.doc_id""")
def evidence_located(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    targets = docs.withColumn("chunk_index", F.lit(0)).unionByName(docs.where("doc_id % 3 = 0").withColumn("chunk_index", F.lit(100000)))
    return evidence.located(targets, views.chunks(spark, sf_dir), views.docs(spark, sf_dir))


@query("paragraph_ranges", f"with {SQL_CHUNKS} select doc_id, chunk_index, (chunk_index + 1) || case when chunk_index % 2 = 1 then '-' || (chunk_index + 3) else '' end as shown, chunk_index as first, (chunk_index + case when chunk_index % 2 = 1 then 2 else 0 end)::int as last from chunks")
def paragraph_ranges(spark, sf_dir):
    end = F.col("chunk_index") + F.when(F.col("chunk_index") % 2 == 1, 2).otherwise(0)
    rows = views.chunks(spark, sf_dir).withColumn("shown", evidence.paragraph_range(F.col("chunk_index"), end)).withColumn("r", evidence.parsed_range(F.col("shown"), 1))
    return rows.select("doc_id", "chunk_index", "shown", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@query("display_roots", "select * from (values ('a1-x', 'docs', 'docs/n.md'), ('b2-y', 'docs__b2', 'docs__b2/n.md'), ('c3-z', 'c-drive', 'c-drive/n.md'), ('d4-w', 'root', 'root/n.md')) t(root_id, display_root, shown)")
def display_roots(spark, sf_dir):
    roots = spark.createDataFrame([("a1-x", "/home/docs"), ("b2-y", "/srv/docs/"), ("c3-z", "C:\\"), ("d4-w", "/")], "root_id string, path string")
    return evidence.display_roots(roots).select("root_id", "display_root", evidence.display_path(F.col("display_root"), F.lit("/n.md")).alias("shown"))


@query("filter_roots", "select d.doc_id from documents d where source in ('src1', 'src2')")
def filter_roots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("root_id"))
    roots = docs.select("root_id").where("root_id is not null").distinct().select("root_id", F.concat(F.lit("/corpus/"), "root_id").alias("path"), F.col("root_id").alias("display_root"))
    return evidence.in_roots(docs, roots, ["/corpus/src1", "src2"]).select("doc_id")


@query("relative_dirs", f"with {SQL_DOCS} select doc_id, relative_directory from docs")
def relative_dirs(spark, sf_dir):
    return views.docs(spark, sf_dir).select("doc_id", tx.relative_directory(F.col("path"), F.lit("/corpus")).alias("relative_directory"))


# --- index writes ---------------------------------------------------------------------------------------------------------


def _stored(spark, sf_dir) -> DataFrame:
    d, none = views.docs(spark, sf_dir), F.lit(None).cast("string")
    return d.select(
        F.concat(F.lit("d"), "doc_id").alias("doc_id"), "path", F.expr("substring(path, 9)").alias("relative_path"), "display_path", "directory", "relative_directory", F.concat(F.lit("1:"), "doc_id").alias("file_identity"),
        F.concat(F.lit("/old"), "path").alias("source_path"), F.lit(1).alias("source_config_rev"), F.md5(F.coalesce("text", F.lit(""))).alias("hash_sha256"), none.alias("title"), "file_type", F.length("text").cast("long").alias("size_bytes"),
        "modified_at", "modified_at", F.lit("success").alias("parse_status"), "category", "tags", "sensitivity", F.lit(False).alias("is_deleted"), F.col("doc_id").alias("n"),
    ).toDF(*ingest.DOCUMENT, "n")


def _run(spark, sf_dir, force: bool = False) -> ingest.Run:
    """Of ten documents, one is missing, one changed, one renamed, one changed and unreadable, and two have swapped nothing: the rest stay."""
    d, now = _stored(spark, sf_dir), F.lit(NOW).cast("timestamp")
    kind = F.col("n") % 10
    files = d.where(kind != 3).select(
        F.when(kind == 5, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")).alias("path"), "relative_path", "display_path", "file_identity",
        F.when(kind.isin(4, 6), F.lit("new")).otherwise(F.col("hash_sha256")).alias("hash_sha256"), "source_config_rev", "file_type", "size_bytes", "modified_at",
    )
    extra = d.where(kind == 7).select(F.concat(F.lit("/new"), "path").alias("path"), "relative_path", "display_path", F.concat(F.lit("2:"), "n").alias("file_identity"), "hash_sha256", "source_config_rev", "file_type", "size_bytes", "modified_at")
    chunks = d.select("doc_id", F.lit(0).alias("chunk_index"), F.col("hash_sha256").alias("text"))

    def parse(todo: DataFrame) -> tuple[DataFrame, DataFrame]:
        bad = F.col("file_identity").rlike("^1:.*6$")
        none = F.lit(None).cast("string")
        facts = todo.select("doc_id", none.alias("title"), F.when(bad, "failed").otherwise("success").alias("parse_status"), none.alias("category"), F.array().cast("array<string>").alias("tags"), none.alias("sensitivity"))
        return facts, todo.where(~bad).select("doc_id", F.lit(0).alias("chunk_index"), F.col("hash_sha256").alias("text"))

    return ingest.incremental(d.drop("n"), chunks, files.unionByName(extra), parse, now, "t1", force=force)


_RUN_SQL = f"""{SQL_DOCS}, old as (select 'd' || doc_id as doc_id, doc_id as n, path, file_type from docs),
new as (select 'd-' || substr(sha256('/new' || path || '|t1'), 1, 16) as doc_id, '/new' || path as path, file_type from old where n % 10 = 7)"""


@query("incremental_run", f"""with {_RUN_SQL} select doc_id, case when n % 10 = 5 then '/moved' || path else path end as path, '/old' || path as source_path, n % 10 = 3 as is_deleted, case when n % 10 = 6 then 'failed' else 'success' end as parse_status,
 case when n % 10 in (4, 5, 6) then n || '.' || file_type end as title from old union all select doc_id, path, path, false, 'success', regexp_extract(path, '([^/]*)$', 1) from new""".replace("n || '.' || file_type", "n::varchar").replace("regexp_extract(path, '([^/]*)$', 1)", "regexp_extract(path, '([^/]*)[.][a-z]+$', 1)"))
def incremental_run(spark, sf_dir):
    return _run(spark, sf_dir).docs.select("doc_id", "path", "source_path", "is_deleted", "parse_status", "title")


@query("incremental_counts", f"with {_RUN_SQL} select case when n % 10 = 3 then 'removed' when n % 10 in (4, 5) then 'success' when n % 10 = 6 then 'failed' else 'skipped' end as status, count(*) as n from old group by 1 having status <> 'success' union all select 'success', (select count(*) from old where n % 10 in (4, 5)) + (select count(*) from new)")
def incremental_counts(spark, sf_dir):
    return _run(spark, sf_dir).counts


@query("incremental_chunks", f"with {_RUN_SQL} select doc_id from old where n % 10 not in (3, 6) union all select doc_id from new")
def incremental_chunks(spark, sf_dir):
    return _run(spark, sf_dir).chunks.select("doc_id")


@query("incremental_audit", f"with {_RUN_SQL} select doc_id as target_id, case when n % 10 = 3 then 'remove_document' else 'index_document' end as operation, case when n % 10 = 6 then 'failure' else 'success' end as result, path as file_path from (select doc_id, n, case when n % 10 = 5 then '/moved' || path else path end as path from old) where n % 10 in (3, 4, 5, 6) union all select doc_id, 'index_document', 'success', path from new")
def incremental_audit(spark, sf_dir):
    return _run(spark, sf_dir).audit.select("target_id", "operation", "result", F.get_json_object("detail_json", "$.file_path").alias("file_path"))


@query("full_rebuild", f"with {_RUN_SQL} select case when n % 10 = 3 then 'removed' when n % 10 = 6 then 'failed' end as status, count(*) as n from old where n % 10 in (3, 6) group by 1 union all select 'success', (select count(*) from old where n % 10 not in (3, 6)) + (select count(*) from new)")
def full_rebuild(spark, sf_dir):
    return _run(spark, sf_dir, force=True).counts


_FILES_SQL = """d as (select doc_id as n, text, 'f/' || doc_id || case when doc_id % 2 = 0 then '.txt' else '.md' end as path from documents where text is not null and regexp_matches(text, '[a-zA-Z]')),
moved as (select n, path, coalesce(lag(n + 1) over (order by n) = n and lag(n) over (order by n) % 10 = 5, false) as displaced, coalesce(n % 10 = 5 and lead(n) over (order by n) = n + 1, false) as takes, lead(path) over (order by n) as onto from d)"""


@query("incremental_files", f"""with {_FILES_SQL}
select 'f' || n as file, case when takes then onto else path end as path, n % 10 = 3 or displaced as is_deleted, case when n % 10 = 8 then 'failed' else 'success' end as parse_status,
 case when n % 10 = 8 or n % 10 = 3 or displaced then 'none' when n % 10 = 4 then 'new' else 'old' end as chunks from moved""")
def incremental_files(spark, sf_dir):
    """Documents as files, indexed by the parsers, and again after some went, changed, moved onto another's path or became unreadable."""
    d = table(spark, sf_dir, "documents").where("text rlike '[a-zA-Z]'").select(F.col("doc_id").alias("n"), "text")
    d = d.withColumn("path", F.concat(F.lit("f/"), "n", F.when(F.col("n") % 2 == 0, ".txt").otherwise(".md")))
    store, now = Store(spark, views.scratch_path(spark, "generations")), F.lit(NOW).cast("timestamp")

    def run(rows: DataFrame, trace: str) -> None:
        bytes_ = F.encode("text", "UTF-8")
        files = rows.select(
            "path", F.col("path").alias("relative_path"), F.col("path").alias("display_path"), F.concat(F.lit("id:"), "n").alias("file_identity"), F.sha2(bytes_, 256).alias("hash_sha256"),
            F.lit(1).alias("source_config_rev"), "file_type", F.octet_length(bytes_).cast("long").alias("size_bytes"), now.alias("modified_at"),
        )
        ingest.committed_run(store, files, now, trace, rows.select("path", bytes_.alias("content")))

    run(d.withColumn("file_type", F.regexp_extract("path", "([a-z]+)$", 1)), "first")
    w = sync.W.orderBy("n")  # the next document's path, for one in ten
    near = d.select("n", F.lead("n").over(w).alias("after"), F.lead("path").over(w).alias("onto")).where("n % 10 = 5 and after = n + 1")
    later = d.where("n % 10 <> 3").join(near.select("n", "onto"), "n", "left").join(near.select(F.col("after").alias("n")), "n", "left_anti")
    later = later.withColumn("path", F.coalesce("onto", "path")).withColumn("text", F.when(F.col("n") % 10 == 4, F.concat(F.lit("Anew "), "text")).when(F.col("n") % 10 == 8, F.concat(F.lit("no zip "), "text")).otherwise(F.col("text")))
    kind = F.when(F.col("n") % 10 == 8, "docx").otherwise(F.regexp_extract("path", "([a-z]+)$", 1))
    run(later.withColumn("file_type", kind).drop("onto"), "second")
    store.pruned(keep=1, grace=0.0)  # this folder has one writer, and nothing reads the first run any more
    first = store.table("chunks").groupBy("doc_id").agg(F.min_by("text", "chunk_index").startswith("Anew ").alias("anew"))
    got = store.table("documents").join(first, "doc_id", "left")
    return got.select(F.regexp_replace("file_identity", "id:", "f").alias("file"), "path", "is_deleted", "parse_status", F.when(F.col("anew"), "new").when(~F.col("anew"), "old").otherwise("none").alias("chunks"))


@query("scan_run", "select 'r1' as run_id, 'completed' as status, count(*) filter (page_id % 4 = 0) as included_count, count(*) filter (page_id % 4 in (1, 2)) as excluded_count, count(*) filter (page_id % 4 = 2) as unsupported_count, count(*) filter (page_id % 4 = 3) as failed_count from pages")
def scan_run(spark, sf_dir):
    kind, now = F.col("page_id") % 4, F.lit(NOW).cast("timestamp")
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.when(kind == 1, "hidden_file").when(kind == 2, "unsupported_format").alias("reason"), F.when(kind == 3, "PermissionError").alias("error"))
    return ingest.scan_run(rows, "r1", "s1", now, now).select("run_id", "status", "included_count", "excluded_count", "unsupported_count", "failed_count")


@query("source_rev", "select s_suppkey as id, case when s_suppkey % 2 = 0 then 'x' else s_name end as label, case when s_suppkey % 2 = 0 then true else s_suppkey % 3 = 0 end as recursive, (1 + case when s_suppkey % 2 = 0 and s_suppkey % 3 <> 0 then 1 else 0 end)::int as source_config_rev from supplier")
def source_rev(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), (F.col("s_suppkey") % 3 == 0).alias("recursive"), F.lit(1).alias("source_config_rev"))
    return ingest.source_updated(rows, F.col("id") % 2 == 0, label=F.lit("x"), recursive=F.lit(True))


@query("active_chunks", f"with {SQL_DOCS}, {SQL_CHUNKS} select c.doc_id, c.chunk_index from chunks c join docs d on c.doc_id = d.doc_id where not d.is_deleted")
def active_chunks(spark, sf_dir):
    return ingest.active_chunks(views.chunks(spark, sf_dir), views.docs(spark, sf_dir)).select("doc_id", "chunk_index")


@query("next_due", "select min(ts) as next_due from events where event_id % 2 = 0")
def next_due(spark, sf_dir):
    return ingest.next_due(table(spark, sf_dir, "events").select(F.expr("if(event_id % 2 = 0, 'retained', 'committed')").alias("state"), F.col("ts").alias("delete_after")))


# --- file events ----------------------------------------------------------------------------------------------------------


@query("file_changes", f"""with {SQL_DOCS}, f as (select doc_id as n, path from docs)
select case when n % 10 = 1 then 'moved' when n % 10 = 2 then 'deleted' when n % 10 = 3 then 'created' else 'modified' end as event_type, path, case when n % 10 = 1 then '/moved' || path end as dest_path from f where n % 10 in (1, 2, 3, 4)""")
def file_changes(spark, sf_dir):
    f = views.docs(spark, sf_dir).select(F.col("doc_id").alias("n"), "path", F.concat(F.lit("1:"), "doc_id").alias("file_identity"), "modified_at", F.lit(1).cast("long").alias("size_bytes"))
    kind = F.col("n") % 10
    after = f.where(kind != 2).withColumns({"path": F.when(kind == 1, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")), "size_bytes": F.when(kind == 4, 2).otherwise(1).cast("long")})
    return watch.changes(f.where(kind != 3).drop("n"), after.drop("n"), F.lit(NOW).cast("timestamp")).select("event_type", "path", "dest_path")


@query("watcher_removals", f"with {SQL_DOCS} select path, case when doc_id % 5 = 0 and not is_deleted then doc_id end as doc_id, case when doc_id % 5 = 0 and not is_deleted then 'success' else 'not_found' end as result from docs where doc_id % 2 = 0")
def watcher_removals(spark, sf_dir):
    d = views.docs(spark, sf_dir)
    gone = d.where("doc_id % 2 = 0").select(F.lit("deleted").alias("event_type"), "path")
    return watch.removals(gone, d.where("doc_id % 5 = 0")).select("path", "doc_id", "result")


# --- records --------------------------------------------------------------------------------------------------------------


def _memory(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id as memory_id", "if(user_id % 2 = 0, 'active', 'expired') as status", "if(event_id % 3 = 0, 'promoted', 'candidate') as promotion_state", "value as importance", "cast(user_id as string) as scope", "event_type as key", "ts as updated_at")


@query("memory_active_rows", "select event_id as memory_id, value as importance from events where user_id % 2 = 0 and event_id % 3 = 0")
def memory_active_rows(spark, sf_dir):
    return records.active_memory(_memory(spark, sf_dir)).select("memory_id", "importance")


@query("memory_latest", "select event_id as memory_id from events where user_id = 1 and event_type = (select min(event_type) from events) order by ts desc, event_id limit 1")
def memory_latest(spark, sf_dir):
    kind = table(spark, sf_dir, "events").agg(F.min("event_type")).first()[0]
    return records.memory_of(_memory(spark, sf_dir), "1", kind).select("memory_id")


@query("events_by_user", "select event_id, event_type from events where user_id = 2 order by ts desc, event_id desc limit 50")
def events_by_user(spark, sf_dir):
    return records.events_by(table(spark, sf_dir, "events"), 50, user_id=2).select("event_id", "event_type")


@query("edges_reweighted", "select ps_source as source_id, ps_target as target_id, case when ps_target % 2 = 0 then 0.5::double else 1.0::double end as weight from (select distinct n_regionkey as ps_source, n_nationkey as ps_target from nation) where ps_source = 1")
def edges_reweighted(spark, sf_dir):
    edges = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("source_id"), F.col("n_nationkey").alias("target_id"), F.lit(1.0).alias("weight"))
    new = edges.where("target_id % 2 = 0").withColumn("weight", F.lit(0.5))
    return records.edges_from(records.reweighted(edges, new), 1)


@query("knowledge_active", f"with {SQL_DOCS} select l.doc_id, l.quality from labels l join docs d on l.doc_id = d.doc_id where not d.is_deleted")
def knowledge_active(spark, sf_dir):
    return records.knowledge_of(table(spark, sf_dir, "labels").select("doc_id", "quality"), views.docs(spark, sf_dir))


@query("tags_merged", "select doc_id, list_concat([lower(source)], case when source = 'src1' then [] else ['src1'] end) as tags from documents where source is not null")
def tags_merged(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source is not null")
    return d.select("doc_id", records.tags_merged(F.array("source"), F.array(F.lit(" SRC1 "), F.lit(""), F.upper("source"))).alias("tags"))


_ARTIFACTS = "select user_id::varchar as artifact_name, case when value > 0 then event_type end as token, ts as until_, user_id % 3 = 0 as has_bundle, case when event_id % 2 = 0 then 'ready' else 'failed' end as status from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"


def _artifacts(spark, sf_dir) -> DataFrame:
    last = sync.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return last.selectExpr("cast(user_id as string) as artifact_name", "if(value > 0, event_type, null) as active_build_token", "ts as lease_expires_at", "user_id % 3 = 0 as has_bundle", "if(event_id % 2 = 0, 'ready', 'failed') as status", "1 as generation", "'why' as last_reason", "5 as chunk_count", "5 as indexed_count", "'m' as model_hash", "'m' as bundle_hash")


@query("artifact_report", f"with a as ({_ARTIFACTS}) select artifact_name, status as freshness, token is not null and until_ >= (select max(ts) from events) as build_in_progress, has_bundle as committed_readable, status <> 'ready' or not has_bundle as degraded, case when not has_bundle then 'committed_bundle_missing' when status <> 'ready' then 'why' end as degraded_reason from a")
def artifact_report(spark, sf_dir):
    now = F.lit(table(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]).cast("timestamp")
    return records.artifact_status(_artifacts(spark, sf_dir), now)


@query("artifact_reconciled", f"with a as ({_ARTIFACTS}), o as (select *, token is not null and until_ < (select max(ts) from events) as over_, status = 'ready' and not has_bundle as drift from a) select artifact_name, case when drift then 'stale' else status end as status, case when drift then 'bundle_missing' when over_ then 'lease_expired' else 'why' end as last_reason, case when over_ then null else token end as active_build_token from o")
def artifact_reconciled(spark, sf_dir):
    now = F.lit(table(spark, sf_dir, "events").agg(F.max("ts").cast("string")).first()[0]).cast("timestamp")
    return records.reconciled(_artifacts(spark, sf_dir), now).select("artifact_name", "status", "last_reason", "active_build_token")


_SIZE = "greatest(0, length(text) - 2)"


@query("golden_top10", f"""with {SQL_CHUNKS},
cases as (
  select doc_id as case_id, doc_id as due, lower(substr(text, 6, 24)) as phrase from chunks where doc_id % 50 = 0 and length(text) >= 30 qualify row_number() over (partition by doc_id order by chunk_index) = 1
  union all select -1, null, 'no text has these words'),
stats as (select count(*) as n, avg({_SIZE}) as avgdl from chunks),
hits as (select case_id, doc_id, chunk_index, text, (length(lower(text)) - length(replace(lower(text), phrase, ''))) / 24 as f, count(*) over (partition by case_id) as df from chunks join cases on contains(lower(text), phrase)),
scored as (select case_id, doc_id, chunk_index, greatest(1e-6, ln((n - df + 0.5::double) / (df + 0.5::double))) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * {_SIZE} / avgdl)) as score from hits, stats),
best as (select * from scored qualify row_number() over (partition by case_id order by score desc, doc_id, chunk_index) <= 10),
per as (select c.case_id, case when any_value(due) is null then coalesce(max(score), 0) < 0.3 else coalesce(bool_or(b.doc_id = due), false) end as ok from cases c left join best b using (case_id) group by c.case_id)
select count(*) as n, count(*) filter (ok) as n_passed, count(*) filter (ok) >= 0.9 * count(*) as passed from per""")
def golden_top10(spark, sf_dir):
    """Of every fiftieth document a passage of its first long line is asked for, all in one plan, and one that nothing holds: how many find their document among ten."""
    chunks = views.chunks(spark, sf_dir)
    index = postings.build(chunks, views.scratch_path(spark, "postings"))
    long = chunks.where("doc_id % 50 = 0 and length(text) >= 30").groupBy("doc_id").agg(F.min_by("text", "chunk_index").alias("text"))
    cases = long.select(F.col("doc_id").alias("case_id"), "doc_id", F.substring("text", 6, 24).alias("text"))
    cases = cases.unionByName(spark.createDataFrame([(-1, None, "no text has these words")], "case_id long, doc_id long, text string"))
    hits = postings.search_many(index, cases, 10).withColumn("score", -F.col("bm25"))
    return records.golden(hits.select("case_id", "doc_id", "rank", "score"), cases.select("case_id", "doc_id"))


_WAYS = ["utf-8", "utf-8 with a mark", "iso-8859-1", "utf-16 with a mark", "utf-16, low byte first"]


@query("charset_read", "select way, lang, count(*) as n, count(*) filter (way <> 'iso-8859-1' or not regexp_matches(text, '[^\\x{00}-\\x{FF}]')) as n_back from documents, (values " + ", ".join(f"('{w}')" for w in _WAYS) + ") t(way) where text <> '' group by way, lang")
def charset_read(spark, sf_dir):
    """Every document encoded in five ways and read back without being told which."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    mark = lambda x: F.unhex(F.lit(x))
    made = [F.encode("text", "UTF-8"), F.concat(mark("EFBBBF"), F.encode("text", "UTF-8")), F.encode("text", "ISO-8859-1"), F.concat(mark("FEFF"), F.encode("text", "UTF-16BE")), F.concat(mark("FFFE"), F.encode("text", "UTF-16LE"))]
    made[2] = F.when(F.col("text").rlike("[^\\x00-\\xFF]"), F.lit(None)).otherwise(made[2])
    ways = F.array(*[F.struct(F.lit(w).alias("way"), m.alias("content")) for w, m in zip(_WAYS, made, strict=True)])
    rows = docs.select("doc_id", "lang", F.sha2("text", 256).alias("due"), F.explode(ways).alias("x")).select("doc_id", "lang", "due", "x.way", "x.content")
    back = charset.texts(rows)
    return back.groupBy("way", "lang").agg(F.count("*").alias("n"), F.count_if(F.sha2("text", 256) == F.col("due")).alias("n_back"))


@query("redact_nested", "select doc_id, 'token=[REDACTED]' as said, ['api_key:[REDACTED]', source] as many from documents")
def redact_nested(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.struct(F.concat(F.lit("token='"), "lang").alias("said")).alias("s"), F.array(F.concat(F.lit("api_key: "), "lang"), F.col("source")).alias("many"))
    return tx.redacted_rows(rows).select("doc_id", "s.said", "many")


@query("lsa_neighbors")
def lsa_neighbors(spark, sf_dir):
    """Rows only: singular vectors are beyond SQL; tests compare them with the weighted vectors' own cosines."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    model = dense.Embedder.fit(items, {})
    return dense.lsa_neighbors(items, model, items.orderBy("doc_id").first().text, 10).select("doc_id", r6("distance"))

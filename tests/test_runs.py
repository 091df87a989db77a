"""Whole incremental runs over files on disk, committed as generations."""

import os

import pytest
from pyspark.sql import functions as F

from docloom.operators import ingest
from docloom.sources.versions import Conflict, Store


def scanned(spark, root):
    rows = ingest.listing(spark, root).where("error is null")
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    digest = F.md5(F.concat_ws("|", "size_bytes", "modified_at"))
    return rows.select("path", "relative_path", F.col("relative_path").alias("display_path"), "file_identity", digest.alias("hash_sha256"), F.lit(1).alias("source_config_rev"), kind.alias("file_type"), "size_bytes", "modified_at")


def test_runs_over_a_folder(spark, tmp_path):
    root, store, now = f"{tmp_path}/in", Store(spark, f"{tmp_path}/g"), F.lit("2024-01-01").cast("timestamp")
    os.mkdir(root)
    put = lambda name, data: open(f"{root}/{name}", "wb").write(data)
    put("a.md", b"# Plan\n\nThe river runs.")
    put("b.txt", "Größe und Maß".encode("cp1252"))
    put("c.docx", b"no zip")
    parsed = []
    vectors = lambda active: parsed.append(active.count()) or store.written(active.select("doc_id"), "vectors")
    one = ingest.committed_run(store, scanned(spark, root), now, "t1", vectors=vectors)
    docs = {r.relative_path: r for r in store.table("documents").collect()}
    assert {p: r.parse_status for p, r in docs.items()} == {"a.md": "success", "b.txt": "success", "c.docx": "failed"} and docs["c.docx"].indexed_at is None
    assert one.facts["counts"] == {"success": 2, "failed": 1} and parsed == [2]
    assert store.table("chunks").join(store.table("documents").where("relative_path = 'b.txt'"), "doc_id").first().text == "Größe und Maß"
    os.remove(f"{root}/b.txt")
    os.rename(f"{root}/a.md", f"{root}/b.txt")  # its path now belongs to another document
    late = store.latest()
    two = ingest.committed_run(store, scanned(spark, root), now, "t2", vectors=vectors)
    now_ = {r.doc_id: r for r in store.table("documents").collect()}
    assert now_[docs["b.txt"].doc_id].is_deleted and now_[docs["a.md"].doc_id].relative_path == "b.txt" and parsed == [2, 1]
    reasons = {r.r for r in store.table("audit").where("operation = 'remove_document'").select(F.get_json_object("detail_json", "$.reason").alias("r")).collect()}
    assert reasons == {"path_reused_by_different_document"} and store.table("audit").count() > 3
    three = ingest.committed_run(store, scanned(spark, root), now, "t3", vectors=vectors)
    assert three.facts["counts"].get("skipped") == 1 and store.table("chunks").count() == store.table("chunks", two).count()
    with pytest.raises(Conflict):
        store.commit(late, {})
    assert store.table("documents", one).count() == 3  # a reader of the first generation still sees it whole

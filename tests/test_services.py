"""What SQL can't check: files, models, settings, writes and errors."""

import io
import os
import random
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docloom import settings
from docloom.operators import answering, dense, evidence, ingest, lexical, qa, records
from docloom.sources import files
from docloom.streaming import watch


def test_listing_and_reading(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".hidden.md").write_text("x")
    (tmp_path / "b.txt").write_text("hello\n\nworld")
    os.symlink(tmp_path / "b.txt", tmp_path / "link.txt")
    got = ingest.listing(spark, str(tmp_path))
    rows = {r.relative_path: r for r in got.collect()}
    assert set(rows) == {"a/.hidden.md", "b.txt"} and rows["b.txt"].size_bytes == 12 and ":" in rows["b.txt"].file_identity
    assert [r.relative_path for r in ingest.listing(spark, str(tmp_path), recursive=False).collect()] == ["b.txt"]
    with pytest.raises(OSError):
        ingest.listing(spark, str(tmp_path / "none"))
    more = got.unionByName(spark.createDataFrame([(str(tmp_path / "gone.txt"), "gone.txt", 1, None, None, None, None)], ingest.LISTING))
    read = files.read_files(more.select("path")).withColumns({"doc_id": F.monotonically_increasing_id(), "file_type": F.lit("txt")})
    parsed = {os.path.basename(r.path): r for r in files.parsed(read).collect()}
    assert parsed["gone.txt"].error_code == "io_error" and parsed["b.txt"].title == "hello"


def test_denied_files_say_so():
    assert files.parse("txt", None, denied="permission_denied")["error_code"] == "permission_denied"


def test_front_matter():
    meta, at = files.front_matter('---\n  Category: "R&D, Alpha"\ntags:\n - one\n - "two"\nsensitivity: public\n...\n---\nbody'.split("\n"))
    assert meta == {"category": ["R&D, Alpha"], "tags": ["one", "two"], "sensitivity": ["public"]} and at == 8
    assert files.front_matter(["---", "tags: [a;b, c]", "---"])[0] == {"tags": ["a;b", "c"]}
    assert files.front_matter(["---", "tags: a; b, c", "---"])[0] == {"tags": ["a", "b, c"]}


def test_docx_core_properties():
    core = '<p xmlns:dc="d" xmlns:cp="c"><dc:title>T</dc:title><cp:category>C</cp:category><cp:keywords>x; y</cp:keywords></p>'
    word = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", word)
        z.writestr("docProps/core.xml", core)
    got = files.parse("docx", data.getvalue())
    assert (got["title"], got["category"], got["tags"]) == ("T", "c", ["x", "y"])


def test_lexicon_is_the_callers(spark):
    docs = spark.createDataFrame([(1, "budget plan costs"), (2, None)], "doc_id long, text string")
    assert not [r for r in dense.token_rows(docs, {}).collect() if r.token.startswith("concept::")]
    got = {(r.doc_id, r.token): r.c for r in dense.token_rows(docs, {"money": ["costs", "price"]}).collect()}
    assert got[1, "concept::money"] == 1
    # The auxiliary document names its concept once for itself and once for each of its terms.
    assert got[-1, "concept::money"] == 3 and got[-1, "costs"] == 1
    assert lexical.expand("ＮＬＰ")[0] == "NLP" and len(lexical.expand("ＮＬＰ")) > 1


def test_bundle_is_written_checked_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cats and dogs"), (2, "dogs chase cats"), (3, "budget plan"), (4, "")], "doc_id long, text string")
    path, print_ = dense.rebuilt(spark, docs, str(tmp_path), 1)
    model = dense.Embedder.load(spark, f"{path}/model")
    assert model.fingerprint() == print_ == dense.Embedder.load(spark, f"{path}/model").fingerprint()
    near = [r.doc_id for r in dense.lsa_neighbors(docs, model, "dogs and cats", 2).orderBy("distance").collect()]
    assert set(near) == {1, 2}
    generations = spark.createDataFrame([(1, "committed", path, None)], "generation int, state string, bundle_path string, delete_after timestamp")
    assert dense.committed(spark, generations).count() == 4
    assert dense.committed(spark, generations.where("false")).count() == 0
    vectors = dense.committed(spark, generations)
    assert dense.deleted(dense.added(vectors, vectors.where("doc_id = 1")), vectors.where("doc_id = 2")).count() == 3
    due = generations.selectExpr("generation", "'retained' as state", "bundle_path", "timestamp '2024-01-01' as delete_after")
    assert ingest.collected(spark, due, F.lit("2024-02-01").cast("timestamp")).first().state == "deleted" and not os.path.exists(path)


def test_settings(tmp_path):
    assert settings.load().search.top_k == 12
    (tmp_path / "s.toml").write_text("[search]\ntop_k = 5\n")
    assert settings.load(str(tmp_path / "s.toml")).search.top_k == 5
    (tmp_path / "s.toml").write_text("[search]\nnope = 5\n")
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "s.toml"))
    with pytest.raises(FileNotFoundError):
        settings.load(str(tmp_path / "none.toml"))


def test_refusals(spark):
    roots = spark.createDataFrame([(1, "/a", True)], "root_id int, path string, is_active boolean")
    with pytest.raises(ValueError):
        ingest.source_added(roots, spark.createDataFrame([(2, "/a/b", True)], roots.schema))
    assert ingest.source_added(roots, spark.createDataFrame([(2, "/ab", True)], roots.schema)).count() == 2
    with pytest.raises(ValueError):
        ingest.source_updated(roots, F.lit(True), path=F.lit("x"))
    with pytest.raises(ValueError):
        answering.plan(spark, "  ")
    memory = spark.createDataFrame([("m1", "M1", "project", ["e1"])], "memory_id string, memory_type string, scope_type string, event_ids array<string>")
    events = spark.createDataFrame([("e1",)], "event_id string")
    assert records.memory_added(memory, memory, events).count() == 2
    for bad in (("m2", "M0", "project", ["e1"]), ("m2", "M1", "session", ["e1"]), ("m2", "M1", "project", ["e9"])):
        with pytest.raises(ValueError):
            records.memory_added(memory, spark.createDataFrame([bad], memory.schema), events)


def test_schema_issues(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    want = StructType([StructField("a", LongType()), StructField("b", StringType(), False), StructField("c", StringType())])
    assert records.schema_issues(df, want) == ["a: int instead of bigint", "b: null", "c: missing"]


def test_audit_only_grows_and_keeps_no_secret(spark, tmp_path):
    rows = spark.createDataFrame([(1, "password=hunter2")], "id int, detail_json string")
    ingest.appended(rows, str(tmp_path))
    ingest.appended(rows, str(tmp_path))
    got = spark.read.parquet(f"{tmp_path}/audit").collect()
    assert len(got) == 2 and got[0].detail_json == "password=[REDACTED]"
    assert spark.read.json(f"{tmp_path}/audit_jsonl").count() == 2


def test_facts_are_cited_by_key_and_value(spark):
    lines = spark.createDataFrame([(1, "负责人：陈立"), (1, "预算：10")], "doc_id int, line string")
    claims = spark.createDataFrame([(1, 1, "陈立", "owner"), (2, 1, "陈立", "budget"), (3, 1, "负责人", None), (4, 1, "陈", "owner"), (5, 1, "", None)], "claim_id int, doc_id int, text string, key string")
    assert {r.claim_id: r.valid for r in qa.cited(claims, lines).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_answers_stay_with_their_subject(spark):
    rows = [(1, 0, "Kestrel plan", "p/1.md", 0.9, datetime(2024, 1, 2), "Kestrel 负责人：陈立\nKestrel 预算：10"), (2, 0, "Heron plan", "p/2.md", 0.7, datetime(2024, 3, 4), "Heron 负责人：周宁")]
    items = spark.createDataFrame(rows, "doc_id int, chunk_index int, title string, path string, score double, modified_at timestamp, preview string")
    got = answering.answer(items, "Heron 的负责人？").first()
    assert got.lines == ["Heron 负责人：周宁"] and [tuple(c) for c in got.citations] == [(2, 0)] and len(got.checked) == 2
    assert answering.answer(items, "总结一下").first().result_type == "answered"
    assert answering.answer(items.where("false"), "Kestrel 预算").first().result_type == "insufficient_evidence"


def test_preview_scopes_and_fallbacks(spark):
    text = "one\ntwo\nthree\nfour"
    p = [{"index": k, "start": s, "end": e, "page_no": g} for k, (s, e, g) in enumerate([(0, 3, 1), (4, 7, 1), (8, 13, 2), (14, 18, 2)])]
    schema = "doc_id int, raw_text string, paragraphs array<struct<index:int,start:int,end:int,page_no:int>>"
    parsed = spark.createDataFrame([(1, text, p), (2, "x" * 500, []), (3, None, None)], schema)
    hits = spark.createDataFrame([(1, 0, 4, 7, 1, "q"), (1, 1, 4, 7, None, "q"), (2, 0, 200, 210, None, "q"), (3, 0, 0, 3, None, "quote"), (1, 2, 900, 910, None, "q")], "doc_id int, chunk_index int, char_start int, char_end int, page_no int, quote string")
    got = {(r.doc_id, r.chunk_index): (r.preview, r.highlight_start, r.highlight_end) for r in evidence.previews(hits, parsed).collect()}
    assert got[1, 0] == ("one\ntwo", 4, 7) and got[1, 1] == ("one\ntwo\nthree", 4, 7)
    assert got[2, 0] == ("x" * 330, 160, 170) and got[3, 0] == ("quote", 0, 5) and got[1, 2][0] == "three\nfour"
    table = parsed.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    for size in (1, 3, 4096):
        stored = evidence.stored_previews(hits, table, parsed.select("doc_id", "raw_text"), bin_chars=size).collect()
        assert {(r.doc_id, r.chunk_index): (r.preview, r.highlight_start, r.highlight_end) for r in stored} == got


def test_stored_paragraphs_give_the_same_previews(spark):
    rng, parsed, hits = random.Random(3), [], []
    for d in range(30):
        at, p = rng.randint(0, 3), []
        for k in range(rng.randint(1, 9)):
            end = at + rng.randint(1, 12)
            p.append({"index": k, "start": at, "end": end, "page_no": k // 3})
            at = end + rng.randint(0, 3)
        parsed.append((d, "".join(rng.choice("abcde") for _ in range(at + 4)), p))
        for k in range(12):
            start = rng.randint(0, at + 3)
            hits.append((d, k, start, start + rng.randint(0, 20), rng.choice([None, 0, 1, 2]), "q"))
    parsed = spark.createDataFrame(parsed, "doc_id int, raw_text string, paragraphs array<struct<index:int,start:int,end:int,page_no:int>>")
    hits = spark.createDataFrame(hits, "doc_id int, chunk_index int, char_start int, char_end int, page_no int, quote string")
    table = parsed.select("doc_id", F.explode("paragraphs").alias("p")).select("doc_id", "p.*")
    for around in (0, 1, 2):
        want, got = evidence.previews(hits, parsed, around), evidence.stored_previews(hits, table, parsed, around, bin_chars=7)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rebuild_is_owed_while_one_is_running(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp '2024-01-01 00:00:00', 'created', 'a.md', null), (timestamp '2024-01-01 00:02:00', 'deleted', 'z.md', null) as t(ts, event_type, path, dest_path)")
    rows.write.parquet(f"{tmp_path}/in")
    asked = []
    q = watch.watch(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), lambda df: df.count(), lambda: bool(asked.append(1)), f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert asked

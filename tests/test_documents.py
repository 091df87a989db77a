import io
import zipfile

from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import chunking
from docloom.sources import files


def paragraphs(*texts, heading=None):
    out, at = [], 0
    for k, t in enumerate(texts):
        out.append({"start": at, "end": at + len(t), "index": k, "page_no": None, "heading_path": heading[k] if heading else None})
        at += len(t) + 1
    return "\n".join(texts), out


def test_offsets_and_headings():
    got = files.parse("md", b"---\ntags:\n- A\n- b\n---\n# T #\nx\n\n## S\ny\nz\n\nNext\n---\nlast")
    assert got["title"] == "T" and got["tags"] == ["a", "b"]
    assert [(p["text"], p["heading_path"]) for p in got["paragraphs"]] == [("T", "T"), ("x", "T"), ("S", "T > S"), ("y\nz", "T > S"), ("Next", "T > Next"), ("last", "T > Next")]
    assert all(got["raw_text"][p["start"] : p["end"]] == p["text"] for p in got["paragraphs"])


def test_failures_are_codes():
    assert files.parse("doc", b"x")["error_code"] == "unsupported_format"
    assert files.parse("txt", b" \n ")["error_code"] == "no_extractable_text"
    assert files.parse("docx", b"not a zip")["error_code"] == "parse_failed"
    assert files.parse("txt", None)["error_code"] == "io_error"


def test_encodings():
    assert files.decoded("﻿中文".encode()) == "中文" and files.decoded("中文文本".encode("gb18030")) == "中文文本"


def test_docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    got = files.parse("docx", buf.getvalue())
    assert [(p["text"], p["heading_path"]) for p in got["paragraphs"]] == [("Top", "Top"), ("a\tb", "Top"), ("1 | 2", "Top")]


def test_chunks_pack_overlap_and_split_on_headings():
    text, ps = paragraphs("a" * 60, "b" * 60, "c" * 60, heading=["H", "H", "I"])
    got = chunking.chunk(text, ps, latin_limit=100, ratio=0.1)
    assert [(c["char_start"], c["char_end"], c["heading_path"]) for c in got] == [(0, 60, "H"), (50, 121, "H"), (122, 182, "I")]


def test_long_paragraph_breaks_at_best_separator():
    text, ps = paragraphs("x" * 30 + ", " + "y" * 20 + ". " + "z" * 80)
    got = chunking.chunk(text, ps, latin_limit=70, ratio=0.0, shortest=1)
    assert [(c["char_start"], c["char_end"]) for c in got] == [(0, 54), (54, 124), (124, 134)]
    assert "".join(c["text"] for c in got) == text


def test_short_chunks_merge_and_nothing_is_lost():
    text, ps = paragraphs("a" * 90, "b" * 20, "c" * 90)
    got = chunking.chunk(text, ps, latin_limit=100, ratio=0.0)
    assert [(c["char_start"], c["char_end"], c["chunk_index"]) for c in got] == [(0, 111, 0), (112, 202, 1)]
    assert chunking.chunk("x", [], "failed") == [] and chunking.chunk("  ", []) == []
    assert chunking.chunk("abc", [])[0]["token_estimate"] == 1
    assert chunking.limit_for("中文字") == 900 and chunking.limit_for("latin") == 2400


def test_scan_rules(spark):
    df = spark.createDataFrame([(".git/a.md", 1), ("a/.b/c.md", 1), (".x.md", 1), ("t.tmp.md", 1), ("ok.MD", 5), ("big.txt", 11), ("p.html", 1)], "path string, size_bytes long")
    got = {r.path: r.reason for r in files.decisions(df, files.ExcludeRules(globs=("*.tmp.*",), max_size_bytes=10)).collect()}
    assert got == {".git/a.md": "hidden_dir", "a/.b/c.md": "hidden_dir", ".x.md": "hidden_file", "t.tmp.md": "exclude_glob:*.tmp.*", "ok.MD": None, "big.txt": "max_size_bytes", "p.html": "unsupported_format"}


def test_redaction_and_lines(spark):
    df = spark.createDataFrame([("password = hunter2 rest", "- a。b！ c\n\n -- d;e")], "a string, b string")
    r = df.select(tx.redacted(F.col("a")), tx.lines(F.col("b"))).first()
    assert r[0] == "password=[REDACTED] rest" and r[1] == ["a。", "b！", "c", "d;", "e"]

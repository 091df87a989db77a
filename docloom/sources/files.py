"""Files to documents: scanning with exclusion rules, content hashes, encodings, and text and Markdown parsers."""

from __future__ import annotations

import fnmatch
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from io import BytesIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.charset import decoded

from docloom.functions import text as tx

TYPES = {"txt": "txt", "md": "md", "docx": "docx", "pdf": "pdf"}
PARAGRAPH = "struct<text:string,start:int,end:int,index:int,page_no:int,heading_path:string>"
PARSED = f"doc_id long, path string, file_type string, title string, parse_status string, error_code string, raw_text string, category string, tags array<string>, sensitivity string, paragraphs array<{PARAGRAPH}>"


@dataclass(frozen=True)
class ExcludeRules:
    dirs: tuple[str, ...] = ("__pycache__", ".git")
    globs: tuple[str, ...] = ()
    max_size_bytes: int | None = None

    def directory_reason(self, name: Column) -> Column:
        return F.when(name.startswith("."), "hidden_dir").when(name.isin(list(self.dirs)), "excluded_dir")

    def file_reason(self, name: Column, size: Column) -> Column:
        """Hidden first, then the first glob that fits, then size (strictly over)."""
        out = F.when(name.startswith("."), "hidden_file")
        for g in self.globs:
            out = out.when(name.rlike(re.sub(r"\(\?s:(.*)\)\\[zZ]", r"(?s)^\1$", fnmatch.translate(g))), f"exclude_glob:{g}")
        return out.when(size > self.max_size_bytes, "max_size_bytes") if self.max_size_bytes is not None else out


def decisions(files: DataFrame, rules: ExcludeRules) -> DataFrame:
    """``files`` (path relative to the root, size_bytes) with reason (null: included) and file_type.

    A hidden or excluded directory anywhere above a file excludes it; an extension without a parser is unsupported.
    """
    parts = F.split("path", "/")
    above = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    in_dir = F.get(F.filter(F.transform(above, rules.directory_reason), lambda r: r.isNotNull()), F.lit(0))
    kind = tx.extension(F.element_at(parts, -1))
    known = F.when(kind.isin(list(TYPES)), kind)
    reason = F.coalesce(in_dir, rules.file_reason(F.element_at(parts, -1), F.col("size_bytes")), F.when(known.isNull(), "unsupported_format"))
    return files.withColumn("file_type", known).withColumn("reason", reason)


def counters(decided: DataFrame) -> DataFrame:
    """Included, excluded and unsupported files; the unsupported are among the excluded."""
    return decided.agg(
        F.count_if(F.col("reason").isNull()).alias("included_count"), F.count_if(F.col("reason").isNotNull()).alias("excluded_count"),
        F.count_if(F.col("reason") == "unsupported_format").alias("unsupported_count"),
    )


def scan(spark: SparkSession, root: str, rules: ExcludeRules | None = None, recursive: bool = True) -> DataFrame:
    """Files below a root with their bytes, decisions and SHA-256. Listing is Spark's; hidden files never reach it."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = F.lit(root.rstrip("/") + "/")
    rows = got.select(F.substring_index("path", base, -1).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    return decisions(rows, rules or ExcludeRules()).withColumn("hash_sha256", F.sha2("content", 256))


def normalized(text: str) -> str:
    wide = {c + 0xFEE0: chr(c) for c in range(33, 127) if chr(c).isalnum()} | {0x3000: " "}
    text = re.sub(r"[ \f\v\r]+", " ", unicodedata.normalize("NFC", text).translate(wide))
    return "\n".join(x.rstrip() for x in text.split("\n"))


@dataclass
class Parsed:
    entries: list[tuple[str, str | None, int | None]] = field(default_factory=list)  # text, heading path, page
    title: str | None = None
    category: str | None = None
    tags: list[str] = field(default_factory=list)
    sensitivity: str | None = None


class ParseError(Exception):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def parse_txt(data: bytes) -> Parsed:
    entries = [(p.strip(), None, None) for p in re.split(r"\n\s*\n", decoded(data)) if p.strip()]
    return Parsed(entries, entries[0][0] if entries else None)


def _scalar(value: str) -> str:
    v = value.strip()
    return v[1:-1].strip() if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def _several(value: str) -> list[str]:
    """Tags on one line: a bracketed list is parted by commas, anything else by semicolons if it has any, else by commas."""
    bracketed = value.startswith("[") and value.endswith("]")
    mark = "," if bracketed or ";" not in value else ";"
    return [t for x in (value[1:-1] if bracketed else value).split(mark) if (t := _scalar(x))]


def front_matter(lines: list[str]) -> tuple[dict[str, list[str]], int]:
    """category, sensitivity (one value each) and tags from a block between two ``---`` lines at the top, and the first line
    after it. Keys may be indented; tags may follow as lines that start with a dash."""
    if not lines or lines[0].strip() != "---":
        return {}, 0
    end = next((k for k, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
    if end is None:
        return {}, 0
    out, listed = {}, False
    for x in filter(str.strip, lines[1:end]):
        if listed and (m := re.match(r"\s*-\s+(.*)", x)):
            out["tags"].append(_scalar(m[1]))
            continue
        key, colon, value = x.partition(":")
        key, value, listed = key.strip().lower(), value.strip(), False
        if colon and key in ("category", "sensitivity"):
            out[key] = [_scalar(value)]
        elif colon and key == "tags":
            out["tags"], listed = _several(value) if value else [], not value
    return out, end + 1


def blocks(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(level, text) of each block: level 0 for paragraphs, else a heading. Fences are taken whole."""
    held: list[str] = []
    fence = None

    def flush():
        text = "\n".join(held).strip()
        held.clear()
        return [(0, text)] if text else []

    for line in lines:
        mark = re.match(r" {0,3}(`{3,}|~{3,})", line)
        if fence or mark:
            held.append(line)
            if mark and not fence:
                fence = mark[1]
            elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
                fence = None
        elif len(held) == 1 and held[0].strip() and (m := re.match(r" {0,3}(=+|-+)\s*$", line)):
            text = held.pop().strip()
            yield (1 if m[1][0] == "=" else 2), text
        elif m := re.match(r"(#{1,6})\s+(.+)$", line):
            yield from flush()
            yield len(m[1]), re.sub(r"\s+#+\s*$", "", m[2]).strip()
        elif line.strip():
            held.append(line)
        else:
            yield from flush()
    yield from flush()


def parse_md(data: bytes) -> Parsed:
    lines = decoded(data).split("\n")
    meta, start = front_matter(lines)
    one = lambda k: (meta.get(k) or [None])[0]
    out, above = Parsed(category=one("category"), tags=meta.get("tags", []), sensitivity=one("sensitivity")), {}
    for level, text in blocks(lines[start:]):
        if level:
            above = {k: v for k, v in above.items() if k < level} | {level: text}
            out.title = text if level == 1 and out.title is None else out.title
        out.entries.append((text, " > ".join(above[k] for k in sorted(above)) or None, None))
    out.title = out.title or (out.entries[0][0] if out.entries else None)
    return out


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(data: bytes) -> Parsed:
    """Body paragraphs and table rows in order, from the package's XML; headings by style name."""
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParseError("parse_failed") from e

    def text(node) -> str:
        return "".join(x.text or "" if x.tag == f"{_WORD}t" else "\t" if x.tag == f"{_WORD}tab" else "\n" if x.tag == f"{_WORD}br" else "" for x in node.iter()).strip()

    out, above = Parsed(), {}
    for node in body if body is not None else []:
        if node.tag == f"{_WORD}p":
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            m = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{_WORD}val", "") if style is not None else "")
            if (t := text(node)) and m:
                above = {k: v for k, v in above.items() if k < int(m[1])} | {int(m[1]): t}
            texts = [t] if t else []
        elif node.tag == f"{_WORD}tbl":
            texts = [" | ".join(text(c) for c in row.findall(f"{_WORD}tc")) for row in node.findall(f"{_WORD}tr")]
        else:
            continue
        out.entries += [(t, " > ".join(above[k] for k in sorted(above)) or None, None) for t in texts if t]
    title, category, tags = core_properties(data)
    out.title, out.category, out.tags = title or (out.entries[0][0] if out.entries else None), category, tags
    return out


def core_properties(data: bytes) -> tuple[str | None, str | None, list[str]]:
    """Title, category and keywords of a package's core properties, if it has any that can be read."""
    try:
        with zipfile.ZipFile(BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("docProps/core.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, None, []
    said = {x.tag.rpartition("}")[2]: (x.text or "").strip() for x in root}
    return said.get("title") or None, said.get("category") or None, _several(said.get("keywords", ""))


def parse_pdf(data: bytes) -> Parsed:
    """Text by page, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ModuleNotFoundError as e:
        raise ParseError("parse_unsupported") from e
    pages = [(p.extract_text() or "") for p in PdfReader(BytesIO(data)).pages]
    entries = [(x.strip(), None, k) for k, t in enumerate(pages, 1) for x in re.split(r"\n\s*\n", t) if x.strip()]
    return Parsed(entries, entries[0][0] if entries else None)


PARSERS: dict[str, Callable[[bytes], Parsed]] = {"txt": parse_txt, "md": parse_md, "docx": parse_docx, "pdf": parse_pdf}


def parse(file_type: str | None, data: bytes | None, parsers: dict[str, Callable[[bytes], Parsed]] = PARSERS, denied: str | None = None) -> dict:
    """Parse one file; failures are codes, never exceptions; ``denied`` says why there are no bytes. Offsets are into raw_text: raw_text[start:end] is the paragraph."""
    failed = {"title": None, "parse_status": "failed", "raw_text": "", "category": None, "tags": [], "sensitivity": None, "paragraphs": []}
    if file_type not in parsers:
        return failed | {"error_code": "unsupported_format"}
    if data is None:
        return failed | {"error_code": denied or "io_error"}
    try:
        got = parsers[file_type](data)
    except ParseError as e:
        return failed | {"error_code": e.code}
    except Exception:
        return failed | {"error_code": "unexpected_error"}
    paragraphs, at = [], 0
    for t, heading, page in got.entries:
        if t := normalized(t).strip():
            paragraphs.append({"text": t, "start": at, "end": at + len(t), "index": len(paragraphs), "page_no": page, "heading_path": normalized(heading) if heading else None})
            at += len(t) + 1
    if not paragraphs:
        return failed | {"error_code": "no_extractable_text"}
    tags = list(dict.fromkeys(t for x in got.tags if (t := " ".join(x.split()).lower())))
    clean = lambda x: " ".join(x.split()).lower() if x else None
    return {"title": normalized(got.title or "").strip() or None, "parse_status": "success", "error_code": None, "raw_text": "\n".join(p["text"] for p in paragraphs), "category": clean(got.category), "tags": tags, "sensitivity": clean(got.sensitivity), "paragraphs": paragraphs}


def read_files(listing: DataFrame) -> DataFrame:
    """``listing`` (path on a mounted folder) with content, and error_code where it can't be read: each file by the task that has its row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = []
            for p in f["path"]:
                try:
                    with open(p, "rb") as x:
                        got.append((x.read(), None))
                except PermissionError:
                    got.append((None, "permission_denied"))
                except OSError:
                    got.append((None, "io_error"))
            yield f.assign(content=[c for c, _ in got], error_code=[e for _, e in got])

    return listing.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in listing.dtypes) + ", content binary, error_code string")


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """``files``: doc_id, path, file_type, content (and error_code, where it could not be read). One row each, whatever fails."""
    why = F.col("error_code") if "error_code" in files.columns else F.lit(None).cast("string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = re.findall(r"(\w+) (?:long|string|array)", PARSED)
        for f in frames:
            yield pd.DataFrame([{"doc_id": r.doc_id, "path": r.path, "file_type": r.file_type, **parse(r.file_type, r.content, parsers or PARSERS, r.why)} for r in f.itertuples()], columns=names)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), "path", "file_type", "content", why.alias("why")).mapInPandas(run, PARSED)

"""Chunks of parsed documents that keep their place: spans of the text, by section, with overlap."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

CJK_LIMIT, LATIN_LIMIT, OVERLAP, SHORTEST, LOOK_BACK = 900, 2400, 0.12, 50, 80
# Where a long paragraph may be parted, best first.
SEPARATORS = ["\n", "。", "！", "？", ". ", "；", ";", "，", ",", " "]
_CJK = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f]")
_SPACE = re.compile("[\x00-\x20]")
CHUNK = "doc_id long, chunk_index int, text string, char_start int, char_end int, page_no int, paragraph_start int, paragraph_end int, heading_path string, token_estimate int"


def token_estimate(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return max(1, int(cjk / 1.5) + int((len(text) - len(_SPACE.findall(text)) - cjk) / 4))


def limit_for(text: str, cjk_limit: int = CJK_LIMIT, latin_limit: int = LATIN_LIMIT) -> int:
    visible = len(text) - len(_SPACE.findall(text))
    return cjk_limit if visible and len(_CJK.findall(text)) / visible >= 0.3 else latin_limit


def break_point(text: str, end: int) -> int:
    """Where to part a text at or before ``end``: after the last of the best separator that the last 80 characters hold."""
    if end >= len(text):
        return end
    low = max(0, end - LOOK_BACK)
    for sep in SEPARATORS:
        if (at := text.rfind(sep, low, end)) >= 0:
            return at + len(sep)
    return end


def spans(text: str, paragraphs: list[dict], limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, last paragraph) of each chunk before short ones are merged. Paragraphs are packed up to the limit within
    a section (equal heading and page); from its second chunk on, a chunk starts ``overlap`` characters before the end
    of the one before it, but not before that one's start. The overlap counts against the limit of parted paragraphs only.
    """
    for _, section in groupby(paragraphs, key=lambda p: (p["heading_path"], p["page_no"])):
        carried, start, end, last, held = None, None, 0, 0, 0

        def closed(end: int, last: int) -> tuple[int, int, int]:
            nonlocal carried, start, held
            span = (start if carried is None else carried, end, last)
            carried = max(span[0], end - overlap) if overlap > 0 else None
            start, held = None, 0
            return span

        for p in section:
            size = p["end"] - p["start"]
            if start is not None and (held + 1 + size > limit or size > limit):
                yield closed(end, last)
            if size > limit:
                at = 0
                while at < size:
                    start = p["start"] + at
                    room = limit - (start - (start if carried is None else carried))
                    hard = min(at + room, size)
                    cut = break_point(text[p["start"] : p["end"]], hard)
                    at = cut if cut > at else hard
                    yield closed(p["start"] + at, p["index"])
                continue
            held = size if start is None else held + 1 + size
            start, end, last = p["start"] if start is None else start, p["end"], p["index"]
        if start is not None:
            yield closed(end, last)


def merged(chunks: list[dict], text: str, shortest: int) -> list[dict]:
    """Short chunks join the one before them, else the one after, of the same heading and page."""
    out, todo = [], list(reversed(chunks))
    alike = lambda a, b: (a["heading_path"], a["page_no"]) == (b["heading_path"], b["page_no"])
    while todo:
        c = todo.pop()
        if c["char_end"] - c["char_start"] < shortest and len(out) + len(todo):
            if out and alike(out[-1], c):
                out[-1] = out[-1] | {k: c[k] for k in ("char_end", "paragraph_end")}
                continue
            if todo and alike(c, todo[-1]):
                todo[-1] = todo[-1] | {k: c[k] for k in ("char_start", "paragraph_start", "heading_path", "page_no")}
                continue
        out.append(c)
    return out


def chunk(text: str, paragraphs: list[dict], status: str = "ok", cjk_limit: int = CJK_LIMIT, latin_limit: int = LATIN_LIMIT, ratio: float = OVERLAP, shortest: int = SHORTEST) -> list[dict]:
    """Chunks of one document; a paragraph is a dict of text's start and end, index, page_no and heading_path."""
    if status == "failed" or not text.strip():
        return []
    if not paragraphs:
        got = [{"char_start": 0, "char_end": len(text), "page_no": None, "paragraph_start": None, "paragraph_end": None, "heading_path": None}]
    else:
        limit = limit_for(text, cjk_limit, latin_limit)
        ends, got = [p["end"] for p in paragraphs], []
        for start, end, last in spans(text, paragraphs, limit, int(limit * ratio)):
            first = paragraphs[min(bisect_right(ends, start), len(paragraphs) - 1)]
            got.append({"char_start": start, "char_end": end, "page_no": first["page_no"], "paragraph_start": first["index"], "paragraph_end": last, "heading_path": first["heading_path"]})
        if shortest > 1:
            got = merged(got, text, shortest)
    for k, c in enumerate(got):
        c |= {"chunk_index": k, "text": text[c["char_start"] : c["char_end"]]}
        c["token_estimate"] = token_estimate(c["text"])
    return got


def chunks(parsed: DataFrame, **config) -> DataFrame:
    """Chunks of every document. ``parsed``: doc_id, raw_text, parse_status, paragraphs (array of structs)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CHUNK.split(", ")]
        for f in frames:
            rows = []
            for r in f.itertuples():
                ps = [dict(p) if isinstance(p, dict) else p.asDict() for p in r.paragraphs] if r.paragraphs is not None else []
                rows += [{"doc_id": r.doc_id, **c} for c in chunk(r.raw_text or "", ps, r.parse_status, **config)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("page_no", "paragraph_start", "paragraph_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return parsed.select("doc_id", "raw_text", "parse_status", "paragraphs").mapInPandas(run, CHUNK)

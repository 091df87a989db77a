"""Lexical search: query sanitising, expansion, a small boolean grammar over substrings, and BM25."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Phrases shorter than a trigram can't be looked up.
SHORTEST = 3

# Clusters of queries that mean the same.
LEXICON = {
    "project_progress": ["项目进度", "进展汇报", "项目计划书", "项目进度汇报", "project progress"],
    "meeting_notes": ["会议纪要", "讨论记录", "会议记录", "meeting notes"],
    "login_system": ["authentication module", "login system", "身份验证模块", "登录系统", "身份认证模块"],
    "roadmap": ["Project Plan", "roadmap", "milestones", "项目路线图"],
    "nlp": ["自然语言处理", "NLP", "language processing"],
    "budget_plan": ["budget plan", "cost plan", "project budget", "budget", "预算计划", "预算方案"],
}


#: Full-width letters, digits and space, and what they become.
_NARROW = {c + 0xFEE0: chr(c) for c in range(33, 127) if chr(c).isalnum()} | {0x3000: " "}


class QuerySyntaxError(ValueError):
    pass


def lookup_key(text: str) -> str:
    return unicodedata.normalize("NFC", " ".join(text.split())).casefold()


def check_lexicon(lexicon: dict[str, list[str]]) -> None:
    """Every term non-empty and in one place only."""
    seen: dict[str, str] = {}
    for name, terms in lexicon.items():
        for t in terms:
            k = lookup_key(t)
            if not k:
                raise ValueError(f"{name} has an empty term")
            if k in seen:
                raise ValueError(f"{t!r} is in {seen[k]} and in {name}")
            seen[k] = name


def expand(query: str, lexicon: dict[str, list[str]] | None = None) -> list[str]:
    """The query and, if it is a lexicon term as a whole, the other terms of its cluster."""
    text = re.sub(r"[ \f\v\r]+", " ", unicodedata.normalize("NFC", query).translate(_NARROW)).strip()
    if not text:
        raise ValueError("the query is blank")
    for terms in (lexicon or LEXICON).values():
        if lookup_key(text) in {lookup_key(t) for t in terms}:
            return [text, *(t for t in terms if lookup_key(t) != lookup_key(text))]
    return [text]


def tokens(query: str) -> list[tuple[str, str]]:
    """(kind, text): operators in capitals, phrases in quotes, words. Characters of the match syntax are blanks; an odd
    number of quotes makes all of them void; what has no letter or digit goes."""
    if query.count('"') % 2:
        query = query.replace('"', "")
    query = re.sub(r"[*^{}():]", " ", query)
    out = []
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        text = (bare or quoted).strip()
        if bare in ("AND", "OR", "NOT"):
            out.append(("op", bare))
        elif any(ch.isalnum() for ch in text):
            out.append(("phrase", text))
    return out


@dataclass(frozen=True)
class Node:
    """kind: phrase, all, any, but (first and not second) or none."""

    kind: str
    text: str = ""
    parts: tuple[Node, ...] = ()

    def phrases(self) -> list[str]:
        return [self.text] if self.kind == "phrase" else [t for p in self.parts for t in p.phrases()]

    def matches(self, text: Column) -> Column:
        if self.kind == "phrase":
            return F.lower(text).contains(self.text.lower())
        got = [p.matches(text) for p in self.parts]
        if self.kind == "all":
            return _fold(got, lambda a, b: a & b)
        if self.kind == "any":
            return _fold(got, lambda a, b: a | b)
        return got[0] & ~got[1] if self.kind == "but" else F.lit(False)


def _fold(columns: list[Column], f) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = f(out, c)
    return out


def parse(query: str) -> Node:
    """Neighbouring phrases bind first (short ones don't count), then NOT, AND, OR. A query of nothing matches nothing."""
    items = tokens(query)
    at = 0

    def run() -> Node:
        nonlocal at
        start = at
        while at < len(items) and items[at][0] == "phrase":
            at += 1
        if at == start:
            raise QuerySyntaxError(query)
        long = [Node("phrase", t) for _, t in items[start:at] if len(t) >= SHORTEST]
        return Node("none") if not long else long[0] if len(long) == 1 else Node("all", parts=tuple(long))

    def level(op: str, below) -> Node:
        nonlocal at
        parts = [below()]
        while at < len(items) and items[at] == ("op", op):
            at += 1
            parts.append(below())
            if op == "NOT":
                parts = [Node("but", parts=tuple(parts))]
        return parts[0] if len(parts) == 1 else Node({"AND": "all", "OR": "any"}[op], parts=tuple(parts))

    if not items:
        return Node("none")
    tree = level("OR", lambda: level("AND", lambda: level("NOT", run)))
    if at < len(items):
        raise QuerySyntaxError(query)
    return tree


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, ignoring case; overlaps count."""
    p = phrase.lower()
    if any(p.startswith(p[k:]) for k in range(1, len(p))):
        return F.regexp_count(F.lower(text), F.lit(f"(?=\\Q{p}\\E)"))
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("long")


def size() -> Column:
    """A chunk's length in trigrams."""
    return F.greatest(F.lit(0), F.length("text") - 2)


def holders(phrases: list[str]) -> list[Column]:
    """df0, df1, ...: how many chunks hold each phrase."""
    return [F.count_if(F.lower("text").contains(p)).alias(f"df{k}") for k, p in enumerate(phrases)]


def scored(chunks: DataFrame, tree: Node, phrases: list[str], stats: DataFrame) -> DataFrame:
    """The chunks that match with ``bm25``; ``stats`` is one row of n, avgdl and the phrases' counts."""
    hits = chunks.where(tree.matches(F.col("text"))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k, p in enumerate(phrases):
        idf = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        f = occurrences(F.col("text"), p).cast("double")
        score = score - F.when(idf > 0, idf).otherwise(F.lit(1e-6)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size() / F.col("avgdl")))
    return hits.withColumn("bm25", score).select(*chunks.columns, "bm25")


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """Chunks that match, with ``bm25`` (lower is better). Statistics are those of all chunks, whatever is searched later.

    Length is in trigrams. A phrase's idf is at least 1e-6. The statistics are one row, gathered in one pass.
    """
    tree = parse(query)
    phrases = list(dict.fromkeys(p.lower() for p in tree.phrases()))
    if not phrases:
        return chunks.where("false").withColumn("bm25", F.lit(0.0))
    return scored(chunks, tree, phrases, chunks.agg(F.count("*").alias("n"), F.avg(size()).alias("avgdl"), *holders(phrases)))


def search(chunks: DataFrame, variants: list[str], k: int, allowed: DataFrame | None = None, scores: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """The best (least) score of each chunk over the variants, the first k of each variant and then of all.

    ``allowed`` (doc_id) restricts what is found, not the statistics. If a variant breaks the grammar nothing is found.
    ``scores`` gives a variant's matches by other means than reading all ``chunks``, such as a stored index.
    """
    out = None
    try:
        for v in variants:
            hits = (scores(v) if scores else bm25(chunks, v)).select("doc_id", "chunk_index", "bm25")
            if allowed is not None:
                hits = hits.join(allowed.select("doc_id"), "doc_id", "left_semi")
            hits = hits.orderBy("bm25", "doc_id", "chunk_index").limit(k)
            out = hits if out is None else out.unionByName(hits)
    except QuerySyntaxError:
        return chunks.where("false").select("doc_id", "chunk_index", F.lit(0.0).alias("bm25"))
    return out.groupBy("doc_id", "chunk_index").agg(F.min("bm25").alias("bm25")).orderBy("bm25", "doc_id", "chunk_index").limit(k)


def min_max(hits: DataFrame) -> DataFrame:
    """``lex`` in 0..1 from bm25: best 1, worst 0, all equal 1. The window spans the candidates only, at most k rows."""
    w = W.partitionBy(F.lit(0))
    low, high, s = F.min(-F.col("bm25")).over(w), F.max(-F.col("bm25")).over(w), -F.col("bm25")
    return hits.withColumn("lex", F.when(high == low, 1.0).otherwise((s - low) / (high - low)))

"""Pre-filters, score fusion and the hybrid search plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import dense, lexical, postings

LEX, DENSE, FRESH, DECAY = 0.55, 0.35, 0.10, 0.023
TOP_K, NEGLIGIBLE = 12, 0.01


@dataclass
class Filter:
    """Any of the values within a field, all of the fields together; deleted documents never pass."""

    source_roots: list[str] = field(default_factory=list)
    directories: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    file_types: list[str] = field(default_factory=list)
    sensitivities: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    modified: tuple[datetime | None, datetime | None] = (None, None)

    def predicate(self, columns: list[str]) -> Column:
        out = ~F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in columns else F.lit(True)
        for values, name in ((self.categories, "category"), (self.file_types, "file_type"), (self.sensitivities, "sensitivity"), (self.source_roots, "source_root")):
            if values:
                out = out & F.col(name).isin(values)
        if self.directories:
            under = F.lit(False)
            for d in self.directories:
                for name in ("directory", "relative_directory"):
                    if name in columns:
                        under = under | (F.col(name) == d) | F.lower(F.col(name)).startswith(d.lower() + "/")
            out = out & under
        if all(self.modified):
            start, end = (t.replace(microsecond=0) for t in self.modified)
            out = out & F.col("modified_at").between(F.lit(start), F.lit(end))
        if self.tags:
            out = out & F.arrays_overlap("tags", F.array(*map(F.lit, self.tags)))
        return out

    def apply(self, docs: DataFrame) -> DataFrame:
        return docs.where(self.predicate(docs.columns))


def freshness(age_days: Column) -> Column:
    return F.exp(-DECAY * F.greatest(age_days, F.lit(0)))


def age(modified: Column, now: Column) -> Column:
    return (now.cast("timestamp").cast("double") - modified.cast("timestamp").cast("double")) / 86400.0


def fused(lex: DataFrame, near: DataFrame, docs: DataFrame, now: Column, k: int = TOP_K) -> DataFrame:
    """Candidates of either channel, joined with their documents, scored, cut at k. ``lex`` has (doc_id, chunk_index, lex),
    ``near`` has (doc_id, chunk_index, distance); what a channel lacks counts as 0 and as distance 2."""
    both = lex.join(near, ["doc_id", "chunk_index"], "full_outer")
    # Candidates are at most a few per result asked for, so they are what is broadcast, not the documents.
    rows = docs.join(F.broadcast(both), "doc_id")
    rows = rows.withColumn("lex", F.coalesce("lex", F.lit(0.0))).withColumn("dense", F.greatest(F.lit(0.0), 1 - F.coalesce("distance", F.lit(2.0))))
    rows = rows.withColumn("fresh", freshness(age(F.col("modified_at"), now)))
    rows = rows.withColumn("total_candidates", F.count("*").over(W.partitionBy(F.lit(0))))  # of candidates only, a few per result asked for
    rows = rows.where((F.col("lex") >= NEGLIGIBLE) | (F.col("dense") >= NEGLIGIBLE))
    return rows.withColumn("score", LEX * F.col("lex") + DENSE * F.col("dense") + FRESH * F.col("fresh")).orderBy(F.desc("score"), "doc_id", "chunk_index").limit(k or TOP_K)


def first_chunks(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits on documents as hits on each document's first chunk; a document without chunks has nothing to show."""
    first = chunks.join(F.broadcast(hits.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index"))
    return hits.join(first, "doc_id").select("doc_id", "chunk_index", "distance")


def hybrid_search(docs: DataFrame, chunks: DataFrame | postings.Postings, vectors: DataFrame, query: str, probes: list[list[float]] | dense.Embedder, now: Column, top_k: int = 0, where: Filter | None = None) -> DataFrame:
    """The whole plan: expand, pre-filter, search both channels for three times the results asked for, fuse, cite.

    ``chunks`` is a table, which is scanned, or a stored index, of which only matches are read. ``vectors`` are those of chunks; vectors
    of whole documents stand for each document's first chunk, whatever its number. ``probes`` are vectors, or the embedder that makes
    them from the query and what it expands to.
    """
    k = 3 * (top_k or TOP_K)
    variants = lexical.expand(query)
    if isinstance(probes, dense.Embedder):
        probes = [probes.embed_query(docs.sparkSession, v) for v in variants]
    allowed = where.apply(docs) if where else None
    stored = isinstance(chunks, postings.Postings)
    hits = postings.search(chunks, variants, k, allowed) if stored else lexical.search(chunks, variants, k, allowed)
    lex = lexical.min_max(hits).select("doc_id", "chunk_index", "lex")
    near = dense.nearest(vectors, probes, k, allowed)
    if "chunk_index" not in near.columns:
        near = first_chunks(chunks.chunks if stored else chunks, near)
    top = fused(lex, near, docs.drop("text"), now, top_k)
    texts = postings.texts(chunks, top) if stored else chunks
    return F.broadcast(top).join(texts.select("doc_id", "chunk_index", "text", "char_start", "char_end"), ["doc_id", "chunk_index"]).select(
        "doc_id", "chunk_index", "score", "lex", "dense", "fresh", "total_candidates", "display_path", F.col("chunk_index").alias("paragraph"),
        F.concat_ws("-", "char_start", "char_end").alias("char_range"), tx.preview(F.col("text"), 120).alias("quote"), tx.preview(F.col("text"), 200).alias("summary"),
    ).orderBy(F.desc("score"), "doc_id", "chunk_index").limit(top_k or TOP_K)

"""Questions answered from evidence: units, subjects, candidates, and one path for each intent.

Evidence is what a search returned, a row for each item: doc_id, chunk_index, title, path, score, modified_at, preview. Searches
cut at their top results, so windows over all items are small by construction. A question is a constant of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import answers, dense, fusion, lexical, postings, qa
from docloom.operators import evidence as around

KINDS = ("decision", "risk", "todo")
MOST_CHECKED = 5
# What an answer says about how it was found, and how kinds of insight are headed.
NOTE_MANY, NOTE_ONE = "当前回答基于已检索片段，建议在引用面板继续核验原文。", "当前没有发现显式冲突，但仍建议核验原文。"
NOTES = {
    "fact_list": "当前答案按结构化事实去重后展开。", "insights": "当前答案来自多文档汇总路径，建议继续核验引用原文。", "summary": "当前答案来自摘要路径，建议继续核验引用原文。",
    "compare": "当前答案来自对比路径，差异已按来源展开。", "timeline": "当前答案来自时间线路径，按文档时间顺序排列。",
}
HEADINGS = dict(answers.KINDS)
LABELS = {k: names[0] for k, names in qa.FACT_KEYS}


@dataclass(frozen=True)
class Plan:
    question: str
    intent: str
    keys: tuple[str, ...]
    kinds: tuple[str, ...]
    subject: tuple[str, ...]
    terms: tuple[str, ...]


def plan(spark: SparkSession, question: str) -> Plan:
    """What a question asks for: one row of column expressions, evaluated once."""
    if not question.strip():
        raise ValueError("the question is blank")
    q = F.lit(question)
    r = spark.range(1).select(qa.intent(q).alias("i"), qa.requested_keys(q).alias("k"), tx.subject_terms(q).alias("s"), tx.terms(q).alias("t")).first()
    return Plan(question, r.i, tuple(r.k), tuple(k for k in KINDS if k in r.k), tuple(r.s), tuple(r.t))


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def bundle(items: DataFrame, subject: tuple[str, ...] = ()) -> DataFrame:
    """Items in the order of their score, with whether they are about the subject (a question without one is about anything)."""
    about = F.arrays_overlap(tx.terms(F.concat_ws(" ", "title", "path", "preview")), _array(subject)) if subject else F.lit(True)
    order = F.row_number().over(W.orderBy(F.desc("score"), "doc_id", "chunk_index"))
    return items.withColumn("item", order).withColumn("about", about).withColumn("label", source_label(F.col("title"), F.col("path")))


def source_label(title: Column, path: Column) -> Column:
    return F.concat(title, F.lit("（"), path, F.lit("）"))


def units(items: DataFrame) -> DataFrame:
    """The lines of each item's preview, with the facts they state and the kinds of insight they are."""
    got = items.select("*", F.posexplode(tx.lines(F.col("preview"))).alias("position", "line"))
    return got.withColumns({"facts": qa.facts(F.col("line")), "kinds": qa.insight_kinds(F.col("line"))})


def fact_rows(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each fact about the subject, of the keys asked for if any are."""
    got = lines.where("about").withColumn("fact", F.explode("facts"))
    got = got.where(F.col("fact.key").isin(list(keys))) if keys else got
    name = F.trim(F.regexp_extract("line", r"^([^:：]{1,80})[:：]", 1))
    label = F.when(qa.fact_line(F.col("line")).isNotNull(), name).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("fact.key")))
    return got.select("*", "fact.key", "fact.value", tx.fact_value(F.col("fact.value")).alias("norm"), label.alias("key_label"))


def score(line: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms are among the line's; half a point if one is only part of it."""
    if not terms:
        return F.lit(0.0)
    n = F.size(F.array_intersect(tx.terms(line), _array(terms)))
    return F.when(n > 0, n.cast("double")).when(F.exists(_array(terms), lambda t: F.contains(F.lower(line), t)), 0.5).otherwise(0.0)


def candidates(lines: DataFrame, p: Plan) -> DataFrame:
    """Lines that may answer: (text, match, item, position, doc_id, chunk_index), the best of each text, best first."""
    wanted = _array(p.keys)
    named = F.arrays_overlap(qa.requested_keys(F.col("line")), wanted) if p.keys else F.lit(True)
    stated = F.exists("facts", lambda f: F.array_contains(wanted, f["key"])) if p.keys else F.size("facts") > 0
    got = lines.where("about").withColumn("points", score(F.col("line"), p.terms)).withColumns({"named": named, "stated": stated})
    by_fact = F.col("stated") & ((F.col("points") > 0) | (F.col("named") if p.keys else F.lit(False)))
    got = got.where(by_fact | (F.col("named") & (F.col("points") > 0)))
    got = got.where(F.contains(tx.question(F.col("preview")), tx.question(F.col("line"))))
    rows = got.select(F.col("line").alias("text"), (F.col("points") + F.col("score")).alias("match"), "item", "position", "doc_id", "chunk_index", F.lower("line").alias("low"))
    return qa.first_of_each(rows, ["low"], [F.desc("match"), "item", "position"]).orderBy(F.desc("match"), "item", "position").drop("low")


def conflicting(lines: DataFrame, p: Plan) -> DataFrame:
    """The sources of the first key asked for that has two values or more: (rank, summary, label), three at most."""
    got = qa.first_of_each(fact_rows(lines, p.keys), ["key", "norm"], ["item", "position"])
    got = got.withColumn("n", F.count("*").over(W.partitionBy("key"))).where("n > 1").withColumn("asked", F.array_position(_array(p.keys), F.col("key")))
    got = got.withColumn("first", F.min("asked").over(W.partitionBy(F.lit(0)))).where("asked = first")
    return got.orderBy("item", "position").limit(qa.MOST["conflicts"]).select("item", "position", F.concat("key_label", F.lit("："), "value").alias("summary"), "label")


def summary_lines(lines: DataFrame) -> DataFrame:
    """The first two units of each item, the best items first, each text once, six at most."""
    got = lines.where("position < 2").withColumn("low", F.lower("line"))
    got = qa.first_of_each(got, ["low"], [F.desc("score"), "item", "position"])
    return got.orderBy(F.desc("score"), "item", "position").limit(qa.MOST["summary"]).select(F.col("line").alias("text"), "item", "position", "doc_id", "chunk_index")


def insight_lines(lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Insights of the kinds asked for, each once, by kind and text."""
    got = lines.withColumn("kind", F.explode("kinds")).where(F.col("kind").isin(list(kinds))).withColumn("said", qa.clean_insight(F.col("line")))
    got = qa.first_of_each(got.withColumn("low", F.lower("said")), ["kind", "low"], ["said", "item", "position"])
    heading = F.element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), F.col("kind"))
    return got.orderBy("kind", "said").select(F.concat(heading, F.lit("："), "said").alias("text"), "item", "position", "doc_id", "chunk_index", "kind")


def insight_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def bundle_docs(items: DataFrame) -> DataFrame:
    return items.agg(F.count_distinct("doc_id").alias("source_count"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def list_lines(lines: DataFrame, p: Plan) -> DataFrame:
    got = qa.first_of_each(fact_rows(lines, p.keys), ["key", "norm"], ["modified_at", "item", "position"])
    return got.orderBy("key", "modified_at", "norm").limit(qa.MOST["facts"]).select(F.col("line").alias("text"), "item", "position", "doc_id", "chunk_index")


def compare_lines(lines: DataFrame, p: Plan) -> DataFrame:
    """Nothing unless two documents state two values between them."""
    rows = fact_rows(lines, p.keys)
    gate = rows.agg(F.count_distinct("norm").alias("values"), F.count_distinct("doc_id").alias("docs")).where("values > 1 and docs > 1")
    got = rows.crossJoin(F.broadcast(gate))  # one row or none
    text = F.concat("title", F.lit("："), "key_label", F.lit(" = "), "value")
    return got.orderBy("item", "position").limit(qa.MOST["facts"]).select(text.alias("text"), "item", "position", "doc_id", "chunk_index")


def timeline_lines(lines: DataFrame, p: Plan) -> DataFrame:
    """Facts by time; without any, the first line of each item. Fewer than two entries are no timeline."""
    facts = fact_rows(lines, p.keys).select("modified_at", "line", "item", "position", "doc_id", "chunk_index", F.lit(1).alias("how"))
    first = lines.where("about and position = 0").select("modified_at", "line", "item", "position", "doc_id", "chunk_index", F.lit(2).alias("how"))
    got = facts.unionByName(first).withColumn("best", F.min("how").over(W.partitionBy(F.lit(0)))).where("how = best")
    got = got.withColumn("n", F.count("*").over(W.partitionBy(F.lit(0)))).where("n > 1").orderBy("modified_at", "item", "position").limit(qa.MOST["facts"])
    text = F.concat(F.date_format("modified_at", "yyyy-MM-dd"), F.lit("："), "line")
    return got.select(text.alias("text"), "item", "position", "doc_id", "chunk_index", "modified_at")


def cited_once(lines: DataFrame) -> DataFrame:
    """One citation for each chunk, in the order of its first line."""
    return lines.groupBy("doc_id", "chunk_index").agg(F.min("rank").alias("rank"))


def result(items: DataFrame, lines: DataFrame, notes: Column, conflicts: DataFrame | None = None) -> DataFrame:
    """One row: what ``answers.rendered`` needs, gathered from ``items`` and the ordered ``lines`` (rank, text, doc_id, chunk_index)."""
    ordered = lambda df, c: F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(c).alias("x")))), lambda s: s["x"])
    said = lines.agg(ordered(lines, "text").alias("lines"), F.count("*").alias("n_lines"))
    used = items.join(F.broadcast(cited_once(lines).select("doc_id", "chunk_index")), ["doc_id", "chunk_index"], "left_semi").withColumn("rank", F.col("item"))
    sources = used.agg(ordered(used, "label").alias("sources"), F.array_sort(F.collect_set(F.struct("doc_id", "chunk_index"))).alias("citations"))
    looked = items.withColumn("rank", F.col("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda s: s["label"]).alias("checked"))
    out = said.crossJoin(sources).crossJoin(looked)  # one row each
    if conflicts is None:
        out = out.withColumn("conflicts", F.lit(None).cast("array<struct<summary:string,label:string>>"))
    else:
        pairs = F.array_sort(F.collect_list(F.struct("item", "position", "summary", "label")))
        out = out.crossJoin(conflicts.agg(F.transform(pairs, lambda s: F.struct(s["summary"].alias("summary"), s["label"].alias("label"))).alias("conflicts")))
        out = out.withColumn("conflicts", F.when(F.size("conflicts") > 1, F.col("conflicts")))
    return answers.rendered(out.withColumn("notes", notes)).select("result_type", "answer", "lines", "citations", "checked")


def _ranked(lines: DataFrame, *order) -> DataFrame:
    return lines.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def answer(items: DataFrame, question: str) -> DataFrame:
    """(result_type, answer, lines, citations, checked): answered, conflict or insufficient_evidence, by the question's intent."""
    p = plan(items.sparkSession, question)
    of = bundle(items, p.subject)
    lines = units(of)
    conflicts, notes = None, F.array(F.lit(NOTES.get(p.intent, "")))
    if p.intent == "summary" and p.kinds:
        found, notes = _ranked(insight_lines(lines, p.kinds), "kind", "text"), F.array(F.lit(NOTES["insights"]))
    elif p.intent == "summary":
        found = _ranked(summary_lines(lines), "item", "position")
    elif p.intent == "compare":
        found = _ranked(compare_lines(lines, p), "item", "position")
    elif p.intent == "timeline":
        found = _ranked(timeline_lines(lines, p), "modified_at", "item", "position")
    elif p.intent == "fact_list":
        found = _ranked(list_lines(lines, p), "item", "position")
    else:
        found = candidates(lines if p.keys else lines.where("false"), p).limit(qa.MOST["answers"])
        found = _ranked(found, F.desc("match"), "item", "position")
        conflicts, notes = conflicting(lines, p) if p.keys else None, F.array(F.when(F.col("n_lines") > 1, NOTE_MANY).otherwise(NOTE_ONE))
    return result(of, found, notes, conflicts)


def evidence(docs: DataFrame, chunks: DataFrame | postings.Postings, p: Plan, now: Column, vectors: DataFrame | None = None, probes: list[list[float]] | None = None, top_k: int = 0, where: fusion.Filter | None = None) -> DataFrame:
    """What a search for a question's subject (else its terms) finds, as items with the chunks next to each hit as preview.

    Each word is a search of its own, and the best of them count. Without vectors the search is lexical.
    """
    words = [t for t in (p.subject or p.terms) if len(t) >= lexical.SHORTEST]
    k = 3 * (top_k or fusion.TOP_K)
    allowed = (where or fusion.Filter()).apply(docs)
    stored = isinstance(chunks, postings.Postings)
    table = chunks.chunks if stored else chunks
    if words:
        hits = postings.search(chunks, words, k, allowed) if stored else lexical.search(chunks, words, k, allowed)
    else:
        hits = table.where("false").select("doc_id", "chunk_index", F.lit(0.0).alias("bm25"))
    none = table.where("false").select("doc_id", "chunk_index", F.lit(0.0).alias("distance"))
    near = dense.nearest(vectors, probes, k, allowed) if vectors is not None and probes else none
    found = fusion.fused(lexical.min_max(hits).select("doc_id", "chunk_index", "lex"), near, docs.drop("text"), now, top_k)
    spans = F.broadcast(found.select("doc_id", "chunk_index", "score", "title", F.col("display_path").alias("path"), "modified_at"))
    rows = spans.join(table.select("doc_id", "chunk_index", "char_start", "char_end", "text"), ["doc_id", "chunk_index"])
    hits = rows.select("doc_id", "chunk_index", "char_start", "char_end", F.lit(None).cast("int").alias("page_no"), tx.preview(F.col("text"), 120).alias("quote"))
    paragraphs = table.select("doc_id", F.col("chunk_index").alias("index"), F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit(None).cast("int").alias("page_no"))
    shown = around.stored_previews(hits, paragraphs, docs.select("doc_id", F.col("text").alias("raw_text")))
    return rows.drop("text", "char_start", "char_end").join(shown.select("doc_id", "chunk_index", "preview"), ["doc_id", "chunk_index"])


def ask(docs: DataFrame, chunks: DataFrame | postings.Postings, question: str, now: Column, vectors: DataFrame | None = None, probes: list[list[float]] | None = None, top_k: int = 0, where: fusion.Filter | None = None) -> DataFrame:
    """From a question to its answer: (result_type, answer, lines, citations, checked, evidence). ``docs`` has title, display_path, text and
    modified_at beside doc_id; a table of chunks is scanned, a stored index read by its postings. ``evidence`` are the
    items in which the answer's keys are stated about its subject."""
    p = plan(docs.sparkSession, question)
    found = evidence(docs, chunks, p, now, vectors, probes, top_k, where)
    # A search's few results, which every step below reads again: they are fetched once, so that it is made once.
    of = docs.sparkSession.createDataFrame(found.collect(), found.schema)
    told = fact_rows(units(bundle(of, p.subject)), p.keys).agg(F.array_sort(F.collect_set(F.struct("doc_id", "chunk_index"))).alias("evidence"))
    return answer(of, question).crossJoin(told)  # one row each

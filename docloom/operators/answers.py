"""Answers as text: rendering of results with their sources, and Markdown export.

Rows carry what a template needs; the text of each result is one aggregate of its rows, so any number of results is rendered in
one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The templates' headings and sentences.
CONCLUSION, GROUNDS, DOUBTS, SOURCE = "结论：", "依据：", "不确定性：", "来源："
INSUFFICIENT, CHECKED, NONE_CHECKED = "当前证据不足以可靠回答该问题。", "已检查来源：", "当前未检索到可用来源"
NEXT, STEPS = "建议下一步：", ["扩大检索范围", "指定时间范围 / 项目 / 目录"]
CONFLICT, CONFLICT_SOURCE, ADVICE = "发现冲突信息，暂不输出单一结论。", "冲突来源 {}：", "建议："
CONFLICT_STEPS = ["由用户确认哪个版本为最新", "或查看时间更晚、级别更高的记录", "若后续接入记忆，记忆可能陈旧或错误"]
CITATIONS, SUMMARY, OVERVIEW, NONE = "## 引用", "## 摘要", "## 概览", "- 无"
KINDS = [("decision", "决策"), ("risk", "风险"), ("todo", "待办")]
MOST_CHECKED = 5


def _lines(*parts: Column) -> Column:
    """Arrays of lines, one after the other, as one text."""
    return F.array_join(F.concat(*parts), "\n")


def _said(*lines: str) -> Column:
    return F.array(*map(F.lit, lines))


def _list(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def bullets(c: Column) -> Column:
    return F.transform(_list(c), lambda x: F.concat(F.lit("- "), x))


def numbered(c: Column, prefix: str = "") -> Column:
    return F.transform(_list(c), lambda x, k: F.concat((k + 1).cast("string"), F.lit(". " + prefix), x))


def answered(lines: Column, sources: Column, notes: Column) -> Column:
    """The conclusion's lines, its distinct sources and what is uncertain."""
    return _lines(_said(CONCLUSION), bullets(lines), _said("", GROUNDS), numbered(F.array_distinct(_list(sources)), SOURCE), _said("", DOUBTS), bullets(notes))


def insufficient(checked: Column) -> Column:
    """A refusal that names up to five distinct sources that were looked at."""
    some = F.slice(F.array_distinct(_list(checked)), 1, MOST_CHECKED)
    return _lines(_said(INSUFFICIENT, "", CHECKED), F.when(F.size(some) > 0, numbered(some)).otherwise(_said("1. " + NONE_CHECKED)), _said("", NEXT, *["- " + s for s in STEPS]))


def conflict(sources: Column) -> Column:
    """The first two of ``sources``, an array of structs (summary, label)."""
    parts = []
    for k, letter in enumerate("AB"):
        s = F.get(sources, F.lit(k))
        block = F.array(F.lit(CONFLICT_SOURCE.format(letter)), F.concat(F.lit("- "), s["summary"]), F.concat(F.lit("- " + SOURCE), s["label"]), F.lit(""))
        parts.append(F.when(s.isNotNull(), block).otherwise(F.array().cast("array<string>")))
    return _lines(_said(CONFLICT, ""), *parts, _said(ADVICE, *["- " + s for s in CONFLICT_STEPS]))


def rendered(results: DataFrame) -> DataFrame:
    """``results`` with result_type and answer. Columns: lines, sources, notes, checked (arrays of text), conflicts (array of
    (summary, label)). Conflicts come first; without a line or a source the answer is a refusal."""
    kind = F.when(F.size(F.coalesce("conflicts", F.array().cast("array<struct<summary:string,label:string>>"))) > 0, "conflict")
    kind = kind.when((F.size(_list(F.col("lines"))) > 0) & (F.size(_list(F.col("sources"))) > 0), "answered").otherwise("insufficient_evidence")
    text = F.when(F.col("result_type") == "conflict", conflict(F.col("conflicts"))).when(F.col("result_type") == "answered", answered(*map(F.col, ("lines", "sources", "notes")))).otherwise(insufficient(F.col("checked")))
    return results.withColumn("result_type", kind).withColumn("answer", text)


def citation_lines(c: Column) -> Column:
    """``c``: array of structs (path, char_range, quote)."""
    return F.transform(c, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". `"), x["path"], F.lit("` @"), x["char_range"], F.lit(" — "), x["quote"]))


def _page(title: Column, *parts: Column) -> Column:
    return F.concat(F.regexp_replace(_lines(F.array(F.concat(F.lit("# "), title), F.lit("")), *parts), r"^\s+|\s+$", ""), F.lit("\n"))


def answer_page(title: Column, answer: Column, citations: Column) -> Column:
    some = citation_lines(citations)
    return _page(title, F.array(answer, F.lit(""), F.lit(CITATIONS)), F.when(F.size(some) > 0, some).otherwise(_said(NONE)))


def summary_page(title: Column, summary: Column, citations: Column) -> Column:
    return _page(title, F.array(F.lit(SUMMARY), summary, F.lit(""), F.lit(CITATIONS)), citation_lines(citations))


def insight_page(title: Column, overview: Column, items: Column) -> Column:
    """``items``: array of structs (kind, text, path, char_range); path null without a citation."""
    line = lambda x: F.concat(F.lit("- "), x["text"], F.when(x["path"].isNotNull(), F.concat(F.lit(" (`"), x["path"], F.lit("` @"), x["char_range"], F.lit(")"))).otherwise(""))
    of = lambda kind: F.filter(items, lambda x: x["kind"] == kind)
    parts = [F.array(F.lit(OVERVIEW), overview, F.lit(""))]
    for kind, heading in KINDS:
        some = F.transform(of(kind), line)
        parts += [_said("## " + heading), F.when(F.size(some) > 0, some).otherwise(_said(NONE)), _said("")]
    return _page(title, *parts)


def export(spark: SparkSession, markdown: str, target: str, confirmed: bool) -> str:
    """Write one previewed page through Hadoop's file systems; an unconfirmed export, or one over a file, is refused."""
    if not confirmed:
        raise ValueError("an export has to be confirmed")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        raise FileExistsError(target)
    out = fs.create(path, False)
    try:
        out.write(bytearray(markdown.encode()))
    finally:
        out.close()
    return target

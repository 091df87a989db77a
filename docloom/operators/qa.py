"""Extractive question answering over evidence lines: intents, facts, insights, conflicts, lists, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx

# Fact keys and what they are called, in the order in which a name is tried.
FACT_KEYS = [
    ("contract_no", ["合同编号", "合同号", "contractno", "contract number"]),
    ("publish_time", ["发布时间", "发布日期", "上线时间", "release date", "publish time"]),
    ("owner", ["项目负责人", "负责人", "owner"]),
    ("budget", ["项目预算", "预算", "budget"]),
    ("vendor", ["供应商", "合作方", "vendor"]),
    ("status", ["项目状态", "状态", "status"]),
    ("phase", ["项目阶段", "阶段", "phase"]),
    ("project_name", ["项目名称", "名称", "project name"]),
    ("decision", ["关键决策", "决策", "决定", "decision"]),
    ("risk", ["风险项", "关键风险", "风险", "risk"]),
    ("todo", ["行动项", "待办", "todo", "action"]),
]
# Words that ask for a kind of answer.
COMPARE, TIMELINE = ["对比", "比较", "compare"], ["时间线", "时间轴", "timeline"]
SUMMARY, LIST = ["总结", "摘要", "汇总", "summarize", "summary"], ["列出", "哪些", "有哪些", "列表", "清单"]
# Sentences that state a fact without a key.
_VALUE = "([^，。；;]+)"
NATURAL = [
    ("owner", rf"(?i)[a-z0-9一-鿿_-]+\s*项目(?:的)?负责人(?:是|为|[:：])\s*{_VALUE}"),
    ("publish_time", r"(?i)(?:发布时间|发布日期|上线时间)(?:是|为|[:：])\s*(\d{4}(?:[-/年])\d{1,2}(?:[-/月])\d{1,2}日?)"),
    ("budget", rf"(?i)(?:项目预算|预算)(?:是|为|[:：])\s*{_VALUE}"),
    ("vendor", rf"(?i)(?:供应商|合作方)(?:是|为|[:：])\s*{_VALUE}"),
    ("contract_no", r"(?i)(?:合同编号|合同号)(?:是|为|[:：])\s*([a-z0-9._-]+)"),
    ("phase", rf"(?i)(?:项目阶段|阶段)(?:是|为|[:：])\s*{_VALUE}"),
    ("status", rf"(?i)(?:项目状态|状态)(?:是|为|[:：])\s*{_VALUE}"),
]
# What marks a decision, a risk or something to do.
INSIGHTS = [
    ("decision", ["决策:", "决策：", "决定:", "决定：", "decision:"], "(?i)(?:决定|决议|确定|采用|冻结|统一使用|开放|不再)"),
    ("risk", ["风险:", "风险：", "风险项:", "风险项：", "risk:"], "(?i)(?:风险|不稳定|冲突|延期|抖动|误判)"),
    ("todo", ["待办:", "待办：", "行动项:", "行动项：", "todo:", "action:"], "(?i)(?:待办|行动项|需要|需|补齐|准备|梳理|整理|限制)"),
]
MOST = {"answers": 3, "summary": 6, "facts": 6, "conflicts": 3}


def _has(c: Column, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(c, t))


def requested_keys(c: Column) -> Column:
    """Fact keys that a question names, in the table's order."""
    q = tx.fact_value(c)
    return F.array_compact(F.array(*[F.when(_has(q, [a.replace(" ", "") for a in names]), F.lit(k)) for k, names in FACT_KEYS]))


def canonical_key(c: Column) -> Column:
    return F.get(requested_keys(c), F.lit(0))


def intent(c: Column) -> Column:
    q, keys = tx.question(c), requested_keys(c)
    return (
        F.when(_has(q, COMPARE), "compare").when(_has(q, TIMELINE), "timeline")
        .when(F.arrays_overlap(keys, F.array(*map(F.lit, ("decision", "risk", "todo")))), "summary")
        .when(F.size(keys) > 0, F.when(_has(q, LIST), "fact_list").otherwise("fact"))
        .when(_has(q, SUMMARY), "summary").otherwise("fact")
    )


def fact_line(c: Column) -> Column:
    """A struct (key, value) of a ``name: value`` line with a known name, else null."""
    line = F.trim(c)
    name = F.trim(F.regexp_extract(line, r"^([^:：]{1,80})[:：]\s*.+$", 1))
    value = F.trim(F.regexp_extract(line, r"^[^:：]{1,80}[:：]\s*(.+)$", 1))
    return F.when((name != "") & (value != "") & canonical_key(name).isNotNull(), F.struct(canonical_key(name).alias("key"), value.alias("value")))


def facts(c: Column) -> Column:
    """The facts of a line: the one it states as ``name: value``, else those of sentences."""
    said = F.array_compact(F.array(*[F.when(F.regexp_extract(c, p, 1) != "", F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract(c, p, 1)).alias("value"))) for k, p in NATURAL]))
    return F.when(fact_line(c).isNotNull(), F.array(fact_line(c))).otherwise(said)


def insight_kinds(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(low, s)) | c.rlike(p), F.lit(k)) for k, starts, p in INSIGHTS]))


def clean_insight(c: Column) -> Column:
    """Without the first prefix that fits, unless nothing else is there."""
    starts = "|".join(sorted((s for _, ss, _ in INSIGHTS for s in ss), key=len, reverse=True))
    rest = F.trim(F.regexp_replace(F.trim(c), f"(?i)^(?:{starts})", ""))
    return F.when(rest == "", F.trim(c)).otherwise(rest)


def fact_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, modified_at, position, line, key, value, norm): one row for each fact of each line."""
    got = lines.withColumn("fact", F.explode(facts(F.col("line"))))
    return got.select("doc_id", "modified_at", "position", "line", "fact.key", "fact.value", tx.fact_value(F.col("fact.value")).alias("norm"))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    names = rows.columns
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rn = 1").select(*names)


def conflicts(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys (of those asked for) with two values or more: the first source of each value, three at most."""
    rows = rows.where(F.col("key").isin(keys)) if keys else rows
    first = first_of_each(rows, ["key", "norm"], ["modified_at", "doc_id", "position"])
    many = first.groupBy("key").agg(F.count("*").alias("n_values")).where("n_values > 1")
    ranked = first.join(many, "key").withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("modified_at", "doc_id", "position")))
    return ranked.where(F.col("rank") <= MOST["conflicts"]).select("key", "rank", "value", "doc_id", "n_values")


def fact_list(rows: DataFrame) -> DataFrame:
    """Distinct values by key, time and value, six at most."""
    return first_of_each(rows, ["key", "norm"], ["modified_at", "doc_id", "position"]).orderBy("key", "modified_at", "value").limit(MOST["facts"]).select("key", "value", "doc_id")


def timeline(rows: DataFrame, key: str) -> DataFrame:
    return first_of_each(rows.where(F.col("key") == key), ["norm"], ["modified_at", "doc_id", "position"]).orderBy("modified_at", "doc_id").limit(MOST["facts"]).select("modified_at", "value", "doc_id")


def comparable(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).agg(F.count_distinct("norm").alias("n_values"), F.count_distinct("doc_id").alias("n_docs")).select("*", ((F.col("n_values") >= 2) & (F.col("n_docs") >= 2)).alias("comparable"))


def insights(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("kind", F.explode(insight_kinds(F.col("line")))).withColumn("text", clean_insight(F.col("line")))
    rows = rows.withColumn("low", F.lower("text"))
    return first_of_each(rows, ["kind", "low"], ["text", "doc_id", "position"]).select("kind", "text", "doc_id")


def summary(units: DataFrame, per_item: int = 2) -> DataFrame:
    """The first units of each item, the best items first, each text once, six at most. ``units``: item, item_score, position, line."""
    first = units.withColumn("rn", F.row_number().over(W.partitionBy("item").orderBy("position"))).where(F.col("rn") <= per_item)
    first = first_of_each(first.withColumn("low", F.lower("line")), ["low"], [F.desc("item_score"), "item", "position"])
    return first.orderBy(F.desc("item_score"), "item", "position").limit(MOST["summary"]).select("item", "position", "line")


def cited(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether each claim is found in the evidence lines of its document. ``claims``: claim_id, doc_id, text, and key, which
    makes it a fact: then the document has to state that key with the same value. Other claims have to be part of a line."""
    lines = evidence.select("doc_id", tx.question(F.col("line")).alias("n"), facts(F.col("line")).alias("facts"))
    key = F.col("key") if "key" in claims.columns else F.lit(None).cast("string")
    got = claims.withColumns({"q": tx.question(F.col("text")), "k": key, "v": tx.fact_value(F.col("text"))}).join(lines, "doc_id", "left")
    stated = F.exists("facts", lambda f: (f["key"] == F.col("k")) & (tx.fact_value(f["value"]) == F.col("v")))
    said = (F.col("q") != "") & F.contains(F.col("n"), F.col("q"))
    return got.groupBy("claim_id").agg(F.coalesce(F.bool_or(F.when(F.col("k").isNotNull(), stated).otherwise(said)), F.lit(False)).alias("valid"))

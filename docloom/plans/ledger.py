"""Questions over a corpus of facts about suppliers, and the same as SQL.

Each supplier is a unit with a page of facts, and every second one a later page that states its budget again, for half of these
another one. All of it is computed from ``supplier`` and ``nation``; so are the answers that the SQL expects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators import answering, answers, qa
from docloom.plans import views
from docloom.plans.catalogue import query
from docloom.plans.views import table

#: Lines of a page, with the fact that each states: (line, key, value) as SQL that both engines read. The third depends on the unit.
_UNIT = "concat('unit', lpad(cast(k as string), 5, '0'))"
PAGE = [
    (f"concat({_UNIT}, ' 负责人：', nation)", "'owner'", "nation"),
    (f"concat({_UNIT}, ' 预算：', cast(bal as string))", "'budget'", "cast(bal as string)"),
    (f"case k % 3 when 0 then concat('风险：余额 ', cast(bal as string)) when 1 then concat('决策：采用 ', nation) else concat('待办：补齐 ', {_UNIT}) end", "case k % 3 when 0 then 'risk' when 1 then 'decision' else 'todo' end", f"case k % 3 when 0 then concat('余额 ', cast(bal as string)) when 1 then concat('采用 ', nation) else concat('补齐 ', {_UNIT}) end"),
    (f"concat({_UNIT}, ' 项目的负责人是 ', nation, '，按期接手')", "'owner'", "nation"),
]
AGAIN = [(f"concat({_UNIT}, ' 预算：', cast(bal + (k % 4) * 50 as string))", "'budget'", "cast(bal + (k % 4) * 50 as string)")]


def _pages() -> str:
    """The lines of all pages in the other engine's SQL."""
    when = "timestamp '2024-01-01' + to_days(({})::int)".format
    parts = [f"select 2 * k as doc_id, k, concat('台账 ', {_UNIT}) as title, concat('ledger/', k, '.md') as path, {when('k % 28')} as modified_at, {p} as position, {line} as line, {key} as key, {value} as value from units" for p, (line, key, value) in enumerate(PAGE)]
    parts += [f"select 2 * k + 1, k, concat('修订 ', {_UNIT}), concat('ledger/', k, '-2.md'), {when('30 + k % 28')}, {p}, {line}, {key}, {value} from units where k % 2 = 0" for p, (line, key, value) in enumerate(AGAIN)]
    return " union all ".join(parts).replace("as string)", "as varchar)")


SQL = f"""units as (select s_suppkey as k, n_name as nation, cast(floor(s_acctbal) as bigint) as bal from supplier join nation on s_nationkey = n_nationkey),
stated as ({_pages()}),
firsts as (select * from stated qualify row_number() over (partition by key, value order by modified_at, doc_id, position) = 1),
items as (select doc_id, any_value(k) as k, any_value(title) as title, any_value(path) as path, any_value(modified_at) as modified_at, 1.0::double / (1 + doc_id) as score, string_agg(line, chr(10) order by position) as preview from stated group by doc_id)"""


def stated(spark, sf_dir) -> DataFrame:
    """One row for each line: doc_id, k, title, path, modified_at, position, line; and the key and value that it states."""
    units = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    units = units.select(F.col("s_suppkey").alias("k"), F.col("n_name").alias("nation"), F.floor("s_acctbal").cast("long").alias("bal"))
    said = [_line("2 * k", "台账 ", "concat('ledger/', k, '.md')", "k % 28", p, *x) for p, x in enumerate(PAGE)]
    again = [F.when(F.col("k") % 2 == 0, _line("2 * k + 1", "修订 ", "concat('ledger/', k, '-2.md')", "30 + k % 28", p, *x)) for p, x in enumerate(AGAIN)]
    return units.select("k", F.explode(F.array_compact(F.array(*said, *again))).alias("x")).select("k", "x.*")


def _line(doc: str, title: str, path: str, days: str, position: int, line: str, key: str, value: str) -> F.Column:
    when = F.expr(f"timestampadd(DAY, cast({days} as int), timestamp '2024-01-01')")
    return F.struct(F.expr(doc).alias("doc_id"), F.concat(F.lit(title), F.expr(_UNIT)).alias("title"), F.expr(path).alias("path"), when.alias("modified_at"), F.lit(position).alias("position"), F.expr(line).alias("line"), F.expr(key).alias("key"), F.expr(value).alias("value"))


def _lines(spark, sf_dir) -> DataFrame:
    return stated(spark, sf_dir).select("doc_id", "modified_at", "position", "line")


def items(spark, sf_dir) -> DataFrame:
    rows = stated(spark, sf_dir).groupBy("doc_id", "title", "path", "modified_at").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("x"))
    return rows.select("doc_id", F.lit(0).alias("chunk_index"), "title", "path", (F.lit(1.0) / (1 + F.col("doc_id"))).alias("score"), "modified_at", F.array_join("x.line", "\n").alias("preview"))


def _written(spark, df: DataFrame, name: str) -> DataFrame:
    """Each question is a plan of its own; what they all read is made once."""
    path = views.scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


# --- facts ----------------------------------------------------------------------------------------------------------------

_ASKS = {"fact": "{} 的负责人是谁", "compare": "请对比 {} 两页的预算", "timeline": "{} 预算的时间轴", "summary": "{} 定下了哪些决策", "fact_list": "列出 {} 的预算"}


@query("intent", f"with {SQL} " + " union all ".join(f"select '{q.split('{}')[0]}' || {_UNIT.replace('as string', 'as varchar')} || '{q.split('{}')[1]}' as question, '{i}' as intent from units" for i, q in _ASKS.items()))
def intent(spark, sf_dir):
    unit = table(spark, sf_dir, "supplier").select(F.expr(_UNIT.replace("(k as", "(s_suppkey as")).alias("u"))
    asks = F.array(*[F.concat(F.lit(q.split("{}")[0]), "u", F.lit(q.split("{}")[1])) for q in _ASKS.values()])
    return unit.select(F.explode(asks).alias("question")).withColumn("intent", qa.intent(F.col("question")))


@query("fact_lines", f"with {SQL} select doc_id, position, key, value from stated where position <> 3")
def fact_lines(spark, sf_dir):
    return _lines(spark, sf_dir).withColumn("f", qa.fact_line(F.col("line"))).where("f is not null").select("doc_id", "position", "f.key", "f.value")


@query("natural_facts", f"with {SQL} select doc_id, position, key, value from stated")
def natural_facts(spark, sf_dir):
    return qa.fact_rows(_lines(spark, sf_dir)).select("doc_id", "position", "key", "value")


@query("conflicts", f"""with {SQL}, many as (select key, count(*) as n_values from firsts group by key having count(*) > 1)
select key, (row_number() over (partition by key order by modified_at, doc_id, position))::int as rank, value, doc_id, n_values from firsts join many using (key) qualify rank <= 3""")
def conflicts(spark, sf_dir):
    return qa.conflicts(qa.fact_rows(_lines(spark, sf_dir)))


@query("fact_list", f"with {SQL} select key, value, doc_id from firsts order by key, modified_at, value limit 6")
def fact_list(spark, sf_dir):
    return qa.fact_list(qa.fact_rows(_lines(spark, sf_dir)))


@query("compare", f"with {SQL} select count(distinct value) as n_values, count(distinct doc_id) as n_docs, count(distinct value) > 1 and count(distinct doc_id) > 1 as comparable from stated where key = 'budget'")
def compare(spark, sf_dir):
    return qa.comparable(qa.fact_rows(_lines(spark, sf_dir)), "budget")


@query("timeline", f"with {SQL} select modified_at, value, doc_id from firsts where key = 'budget' order by modified_at, doc_id limit 6")
def timeline(spark, sf_dir):
    return qa.timeline(qa.fact_rows(_lines(spark, sf_dir)), "budget")


@query("insights", f"with {SQL} select key as kind, value as text, doc_id from stated where key in ('decision', 'risk', 'todo') qualify row_number() over (partition by key, lower(value) order by value, doc_id, position) = 1")
def insights(spark, sf_dir):
    return qa.insights(_lines(spark, sf_dir))


@query("citation_check", f"with {SQL} select doc_id * 10 + c as claim_id, c in (0, 2) as valid from (select distinct doc_id from stated where position = 1), range(3) r(c)")
def citation_check(spark, sf_dir):
    """Of each page: its budget under its key, its budget under another, and a part of its first line."""
    rows = stated(spark, sf_dir).where("doc_id % 2 = 0 and position < 2").groupBy("doc_id").agg(F.max_by("value", "position").alias("bal"), F.min_by("line", "position").alias("first"))
    claim = lambda text, key: F.struct(text.alias("text"), F.lit(key).cast("string").alias("key"))
    claims = rows.select("doc_id", F.posexplode(F.array(claim(F.col("bal"), "budget"), claim(F.col("bal"), "owner"), claim(F.substring("first", 3, 9), None))).alias("c", "x"))
    return qa.cited(claims.select((F.col("doc_id") * 10 + F.col("c")).alias("claim_id"), "doc_id", "x.text", "x.key"), _lines(spark, sf_dir))


_CONFLICT = "concat_ws(chr(10), '发现冲突信息，暂不输出单一结论。', '', {parts}, '', '建议：', '- 由用户确认哪个版本为最新', '- 或查看时间更晚、级别更高的记录', '- 若后续接入记忆，记忆可能陈旧或错误')"
_SOURCE = "'冲突来源 {letter}：', '- ' || {said}, '- 来源：' || {label}"


@query("conflict_rendered", f"""with {SQL}, r as (select value, doc_id, row_number() over (order by modified_at, doc_id, position) as n from firsts where key = 'budget')
select 'conflict' as result_type, {_CONFLICT.format(parts=", '', ".join(_SOURCE.format(letter=x, said=f"max(value) filter (n = {n})", label=f"max(doc_id::varchar) filter (n = {n})") for n, x in enumerate("AB", 1)))} as answer from r""")
def conflict_rendered(spark, sf_dir):
    said = qa.conflicts(qa.fact_rows(_lines(spark, sf_dir))).where("key = 'budget'")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("value").alias("summary"), F.col("doc_id").cast("string").alias("label"))))
    none = F.lit(None).cast("array<string>")
    rows = said.agg(F.transform(ordered, lambda s: F.struct(s["summary"].alias("summary"), s["label"].alias("label"))).alias("conflicts"))
    return answers.rendered(rows.select("conflicts", none.alias("lines"), none.alias("sources"), none.alias("notes"), none.alias("checked"))).select("result_type", "answer")


# --- answers --------------------------------------------------------------------------------------------------------------

#: Question, and SQL for its (result_type, lines); lines of a conflict aren't compared here. Of a unit's two lines on its owner the sentence
#: shares more runs of characters with the question, so it comes first.
_ARRAY = "coalesce(list({} order by {}), []::varchar[])"
_OF = "from stated join items using (doc_id, title, path, modified_at) where "
ASKED = [
    ("unit00005 负责人是谁？", f"select 'answered', {_ARRAY.format('line', 'position desc')} {_OF} stated.k = 5 and key = 'owner'"),
    ("unit00006 预算是多少？", f"select case when count(distinct value) > 1 then 'conflict' else 'answered' end, null::varchar[] {_OF} stated.k = 6 and key = 'budget'"),
    ("unit00008 预算是多少？", f"select case when count(distinct value) > 1 then 'conflict' else 'answered' end, {_ARRAY.format('distinct line', 'line')} {_OF} stated.k = 8 and key = 'budget'"),
    ("unit00006 有哪些预算？", f"select 'answered', {_ARRAY.format('line', 'modified_at')} {_OF} stated.k = 6 and key = 'budget'"),
    ("比较 unit00006 的预算", f"select 'answered', {_ARRAY.format('''title || '：' || split_part(line, '：', 1) || ' = ' || value''', 'score desc')} {_OF} stated.k = 6 and key = 'budget'"),
    ("unit00006 预算时间线", f"select 'answered', {_ARRAY.format('''strftime(modified_at, '%Y-%m-%d') || '：' || line''', 'modified_at')} {_OF} stated.k = 6 and key = 'budget'"),
    ("unit00004 有哪些决策和风险？", f"select 'answered', {_ARRAY.format('''case key when 'risk' then '风险' else '决策' end || '：' || value''', 'key, value')} from (select distinct key, value from stated where key in ('decision', 'risk'))"),
    ("总结 unit00002", f"select 'answered', (select list(line order by score desc, position) from (select line, score, position {_OF} position < 2 qualify row_number() over (partition by line order by score desc) = 1 order by score desc, position limit 6))"),
    ("unit99999 合同编号是多少？", "select 'insufficient_evidence', []::varchar[]"),
]


@query("qa_answer", f"with {SQL} " + " union all ".join(f"select '{q}' as question, * from ({sql}) t(result_type, lines)" for q, sql in ASKED))
def qa_answer(spark, sf_dir):
    out, of = None, _written(spark, items(spark, sf_dir), "items")
    for q, _ in ASKED:
        got = answering.answer(of, q).select(F.lit(q).alias("question"), "result_type", F.when(F.col("result_type") != "conflict", F.col("lines")).alias("lines"))
        out = got if out is None else out.unionByName(got)
    return out


@query("qa_conflict", f"""with {SQL}, r as (select split_part(line, '：', 1) || '：' || value as said, title || '（' || path || '）' as label, row_number() over (order by score desc) as n {_OF} stated.k = 6 and key = 'budget')
select 'conflict' as result_type, {_CONFLICT.format(parts=", '', ".join(_SOURCE.format(letter=x, said=f"max(said) filter (n = {n})", label=f"max(label) filter (n = {n})") for n, x in enumerate("AB", 1)))} as answer from r""")
def qa_conflict(spark, sf_dir):
    return answering.answer(items(spark, sf_dir), "unit00006 预算是多少？").select("result_type", "answer")


@query("qa_bundle", f"with {SQL} select count(distinct doc_id) as source_count, list_sort(list(distinct doc_id)) as doc_ids, " + ", ".join(f"count(distinct case when key = '{k}' then value end) as {k}" for k in answering.KINDS) + " from stated")
def qa_bundle(spark, sf_dir):
    of = items(spark, sf_dir)
    lines = answering.units(answering.bundle(of))
    return answering.bundle_docs(of).crossJoin(answering.insight_counts(answering.insight_lines(lines, answering.KINDS)))


@query("subject_terms", f"with {SQL} select k as id, [{_UNIT.replace('as string', 'as varchar')}] as terms from units")
def subject_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.expr(_UNIT.replace("(k as", "(s_suppkey as")), F.lit(" 负责人是谁？")).alias("s"))
    return rows.select("id", tx.subject_terms(F.col("s")).alias("terms"))


def corpus(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks): a page is a document, each of its lines a chunk."""
    rows = stated(spark, sf_dir)
    docs = rows.groupBy("doc_id", "title", "path", "modified_at").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("x"))
    docs = docs.select("doc_id", "title", "path", F.col("path").alias("display_path"), "modified_at", F.lit(False).alias("is_deleted"), F.array_join("x.line", "\n").alias("text"))
    w = views.W.partitionBy("doc_id").orderBy("position").rowsBetween(views.W.unboundedPreceding, -1)
    chunks = rows.withColumn("char_start", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("int"))
    return docs, chunks.select("doc_id", F.col("position").alias("chunk_index"), F.col("line").alias("text"), "char_start", (F.col("char_start") + F.length("line")).cast("int").alias("char_end"))


_EVERY = ["unit00006 预算是多少？", "unit00008 预算是多少？", "unit00007 负责人是谁？"]


@query("qa_ask", f"with {SQL} " + " union all ".join(f"""select '{q}' as question, case when count(*) = 0 then 'insufficient_evidence' when count(distinct value) > 1 then 'conflict' else 'answered' end as result_type,
 list_sort(list(distinct doc_id)) as documents from stated where k = {int(q[4:9])} and key = '{'budget' if '预算' in q else 'owner'}'""" for q in _EVERY))
def qa_ask(spark, sf_dir):
    """From the question to the answer in one go: search, evidence, previews, answer; with the documents that hold the evidence."""
    docs, chunks = (_written(spark, df, "corpus") for df in corpus(spark, sf_dir))
    out = None
    for q in _EVERY:
        got = answering.ask(docs, chunks, q, F.lit(views.NOW)).select(F.lit(q).alias("question"), "result_type", F.array_sort(F.array_distinct("evidence.doc_id")).alias("documents"))
        out = got if out is None else out.unionByName(got)
    return out

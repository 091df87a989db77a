"""One query per operator, at production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import conversations, decontam, embeddings, importance, langid, linededup, packing, pieces, simhash, tokencount, toxicity, urlfilter, warc
from docloom.llm._common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=3)
    return got.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json", capacity=2048)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", limit=512)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(table(spark, sf_dir, "documents")).drop("text_key")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.withColumn("score", F.round("score", 6))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.RULES)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op5_warc": op5_warc,
    "op8_embeddings": op8_embeddings,
    "op6_langid": op6_langid,
    "op10_url_filters": op10_url_filters,
    "op9_token_counts": op9_token_counts,
    "op11_importance": op11_importance,
    "op12_conversations": op12_conversations,
    "op13_pieces": op13_pieces,
}
_LINES = """
words as (
  select doc_id, unnest(range(len(string_split(text, chr(10))))) as line_no,
         list_filter(string_split_regex(translate(unnest(string_split(text, chr(10))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
lines as (select doc_id, line_no, w, doc_id * 2147483648::hugeint + line_no as place from words where len(w) >= 1),
uniq as (select w, min(place) as first from lines group by w)
"""
ORACLE: dict[str, str] = {
    "op10_url_filters": urlfilter.oracle(),
    "op11_importance": importance.oracle(),
    "op12_conversations": conversations.oracle(),
    "op4_line_dedup": f"""
with {_LINES},
variants as (
  select w, first, md5(array_to_string(w, ' ')) as v, -1 as p from uniq where len(w) >= 5
  union all
  select w, first, md5(array_to_string(list_concat(w[1:p], w[p + 2:]), ' ')), p
  from (select w, first, unnest(range(len(w))) as p from uniq where len(w) >= 5)),
same as (select v, p, min(first) as f from variants group by v, p),
less as (select v, min(first) as f from variants where p >= 0 group by v),
near as (
  select w, min(f) as near from (
    select a.w, a.first, s.f from variants a join same s on a.v = s.v and a.p = s.p where a.p >= 0
    union all select a.w, a.first, s.f from variants a join same s on a.v = s.v where a.p >= 0 and s.p = -1
    union all select a.w, a.first, l.f from variants a join less l on a.v = l.v where a.p = -1)
  where f < first group by w),
kept as (select u.w, u.first, n.near, least(u.first, coalesce(n.near, u.first)) as best from uniq u left join near n on u.w = n.w)
select l.doc_id, l.line_no::int as line_no, (k.best // 2147483648)::bigint as kept_doc_id, (k.best % 2147483648)::int as kept_line_no,
       case when k.near is not null then 1 else 0 end::int as edits
from lines l join kept k on l.w = k.w where l.place > k.first or k.near is not null
""",
}

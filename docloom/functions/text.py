"""String functions as Columns: normalisation, estimates, previews, terms, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

CJK = r"[一-鿿㐀-䶿豈-﫿\x{20000}-\x{2FA1F}]"
HAN = r"[一-鿿]"
_WIDE = "".join(chr(c + 0xFEE0) for c in (*range(48, 58), *range(65, 91), *range(97, 123))) + "　"
_NARROW = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123))) + " "

# Words that carry no meaning in a question.
GENERIC_TERMS = ["什么", "多少", "是否", "谁", "何时", "哪里", "如何", "为什么", "情况", "项目", "文档", "请问", "一下", "告诉", "说明", "介绍", "当前", "最新", "是多少", "是谁", "哪些", "列出"]


def narrow(c: Column) -> Column:
    """Full-width letters, digits and the ideographic space to their usual width; punctuation stays."""
    return F.translate(c, _WIDE, _NARROW)


@F.pandas_udf(StringType())
def composed(s: pd.Series) -> pd.Series:
    """Unicode composed form, for which Spark has no function of its own."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def collapsed(c: Column) -> Column:
    """Runs of blanks, form feeds and carriage returns to one space; trailing white space of each line goes."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \f\x0B\r]+", " "), r"(?m)[^\S\n]+$", "")


def normalized(c: Column) -> Column:
    return collapsed(narrow(composed(c)))


def token(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def path(c: Column) -> Column:
    """Forward slashes, no trailing slash but for the root and a drive."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    cut = F.regexp_replace(p, "/+$", "")
    return F.when(cut == "", F.when(p == "", "").otherwise("/")).when(cut.rlike("^[A-Za-z]:$") & p.endswith("/"), F.concat(cut, F.lit("/"))).otherwise(cut)


def directory(c: Column) -> Column:
    return F.when(F.locate("/", c) > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))


def relative_directory(path_: Column, root: Column) -> Column:
    """The directory of a path below a root; empty for files right in it."""
    return directory(F.when(path_.startswith(F.concat(root, F.lit("/"))), F.substring(path_, F.length(root) + 2, F.length(path_))).otherwise(path_))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))


def chars(c: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(c, kind, ""))


def cjk_count(c: Column) -> Column:
    return F.length(c) - chars(c, CJK)


def visible_count(c: Column) -> Column:
    return chars(c, r"[\x00-\x20]")


def token_estimate(c: Column) -> Column:
    cjk = cjk_count(c)
    return F.greatest(F.lit(1), F.floor(cjk / F.lit(1.5)) + F.floor((visible_count(c) - cjk) / F.lit(4.0))).cast("int")


def cjk_ratio(c: Column) -> Column:
    n = visible_count(c)
    return F.when(n > 0, cjk_count(c).cast("double") / n).otherwise(0.0)


def preview(c: Column, n: int) -> Column:
    """The first n characters on one line, with an ellipsis if there is more."""
    head = F.trim(F.translate(F.substring(c, 1, n), "\n", " "))
    return F.when(F.length(c) > n, F.concat(head, F.lit("..."))).otherwise(head)


def question(c: Column) -> Column:
    """Lower case, a plain colon, and single spaces for all but letters, digits and ``_ : . -``."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("："), F.lit(":")), r"[^\p{L}\p{N}_:.\-]+", " "))


def fact_value(c: Column) -> Column:
    return F.replace(question(c), F.lit(" "), F.lit(""))


def ngrams(blocks: Column, n: int) -> Column:
    """All runs of n characters within each of an array of strings."""
    long = F.filter(blocks, lambda b: F.length(b) >= n)
    return F.flatten(F.transform(long, lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - (n - 1)), lambda k: F.substring(b, k, F.lit(n)))))


def terms(c: Column) -> Column:
    """Distinct search terms: Latin words of two letters or more, runs of Han and their bigrams and trigrams."""
    q = question(c)
    words = F.filter(F.regexp_extract_all(q, F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 2)
    blocks = F.filter(F.regexp_extract_all(q, F.lit(f"({HAN}+)"), 1), lambda b: F.length(b) >= 2)
    return F.array_sort(F.array_except(F.array_distinct(F.concat(words, blocks, ngrams(blocks, 2), ngrams(blocks, 3))), F.array(*map(F.lit, GENERIC_TERMS))))


# Nouns that name an attribute, before which a subject stands, and those that are none themselves.
ATTRIBUTES = ["项目", "负责人", "发布时间", "预算", "供应商", "合同", "阶段", "状态", "决策", "风险", "待办"]
NO_SUBJECT = ["负责人", "发布", "发布时间", "日期", "预算", "供应商", "合同", "合同编号", "决策", "风险", "待办", "行动项", "状态", "阶段", "关键", "时间线", "时间轴", "比较", "对比"]


def subject_terms(c: Column) -> Column:
    """What a question is about: Latin words of three letters or more, and runs of Han before an attribute."""
    q = question(c)
    words = F.filter(F.regexp_extract_all(q, F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 3)
    before = F.transform(F.regexp_extract_all(q, F.lit(f"({HAN}{{2,12}})(?={'|'.join(ATTRIBUTES)})"), 1), lambda w: F.regexp_replace(w, "的+$", ""))
    rest = F.array_except(F.array_distinct(F.concat(words, F.array_except(before, F.array(*map(F.lit, NO_SUBJECT))))), F.array(*map(F.lit, GENERIC_TERMS)))
    return F.array_sort(F.filter(rest, lambda w: w != ""))


def lines(c: Column) -> Column:
    """Short units of a text: its lines, stripped of blanks and dashes, parted after full stops and semicolons."""
    trimmed = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^[ \-\t]+|[ \-\t]+$", ""))
    parts = F.flatten(F.transform(trimmed, lambda x: F.transform(F.split(x, r"(?<=[。！？!?；;])\s*"), lambda y: F.trim(y))))
    return F.filter(parts, lambda x: x != "")


# What a secret looks like. The value is quoted, or goes up to white space (also after a quote that is never closed).
SECRETS = [
    (r"(?i)([\"']?)(api[_-]?key|token|password|secret)\1\s*([:=])\s*(?:([\"']).*?\4|[^\s]+)", "$1$2$1$3$4[REDACTED]$4"),
    (r"(?i)\bbearer\s+[a-z0-9\-._~+/=]+", "Bearer [REDACTED]"),
    (r"\bsk-[a-zA-Z0-9\-_]{8,}\b", "sk-[REDACTED]"),
]


def redacted(c: Column) -> Column:
    """Secrets replaced: assignments to key, token, password or secret, bearer tokens, and sk- keys."""
    for pattern, to in SECRETS:
        c = F.regexp_replace(c, pattern, to)
    return c


def redacted_value(c: Column, kind: DataType) -> Column:
    """The same for every string inside arrays, maps and structs; keys of maps stay."""
    if isinstance(kind, StringType):
        return redacted(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: redacted_value(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: redacted_value(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[redacted_value(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def redacted_rows(df: DataFrame) -> DataFrame:
    return df.select(*[redacted_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])


def digest(c: Column) -> tuple[Column, Column]:
    """SHA-256 and length of the stripped text; the text itself is never kept."""
    return F.sha2(F.trim(c), 256), F.length(F.trim(c))

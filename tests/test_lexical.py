import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(1, 0, "aaaaaa needle"), (2, 0, "shared-needle and other words"), (3, 0, "项目进度 汇报 needle needle"), (4, 0, "nothing here")]
    return spark.createDataFrame(rows, "doc_id long, chunk_index int, text string")


def found(chunks, q):
    return sorted(r.doc_id for r in lexical.search(chunks, [q], 10).collect())


@pytest.mark.parametrize(
    ("query", "docs"),
    [("needle", [1, 2, 3]), ("shared-needle", [2]), ("项目进度", [3]), ("项目", []), ("needle of", [1, 2, 3]), ("needle AND of", []), ("needle OR of", [1, 2, 3]),
     ("needle NOT other", [1, 3]), ("NOT needle", []), ("needle OR", []), ('"other words"', [2]), ('"other words', [2]), ("zzz", []), ("()", [])],
)
def test_match(chunks, query, docs):
    assert found(chunks, query) == docs


def test_overlaps_count(spark):
    df = spark.createDataFrame([("aaaaaa", "abcabc")], "a string, b string")
    assert tuple(df.select(lexical.occurrences(F.col("a"), "aaa"), lexical.occurrences(F.col("b"), "abc")).first()) == (4, 2)


def test_bm25_by_hand(chunks):
    got = {r.doc_id: r.bm25 for r in lexical.bm25(chunks, "other").collect()}
    sizes = [len(t) - 2 for t in ("aaaaaa needle", "shared-needle and other words", "项目进度 汇报 needle needle", "nothing here")]
    want = -math.log((4 - 1 + 0.5) / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * sizes[1] / (sum(sizes) / 4)))
    assert got == {2: pytest.approx(want, abs=1e-12)}


def test_lexicon():
    lexical.check_lexicon(lexical.LEXICON)
    assert lexical.expand("nlp")[1:] == ["自然语言处理", "language processing"]
    with pytest.raises(ValueError):
        lexical.expand("  ")
    with pytest.raises(ValueError):
        lexical.check_lexicon({"a": ["x"], "b": ["X"]})

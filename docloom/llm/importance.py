"""Importance resampling towards a target distribution, over a stored document-by-bucket count matrix.

Texts become rows of a sparse matrix of how often each hashed feature occurs. The matrix is written once, as CSR blocks of
some hundred documents each. Column sums of the documents' and of the target's blocks are the two distributions; their
log ratio is a gain for each bucket, and the product of the matrix with the gains gives each document's weight. Gumbel noise
made from doc_id turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import _crc
from docloom.llm._common import ARROW_ROWS, id_and_text, mapped, saved

BUCKETS, LONGEST_RUN, LEAST_WORDS = 10_000, 1, 20
#: Features after which a block ends early.
BLOCK_FEATURES = 2_000_000
BLOCKS = "doc_id array<long>, n_words array<long>, indptr array<long>, indices array<int>, counts array<int>"
#: Lower-cases A-Z; whatever is no digit, letter or byte beyond ASCII becomes a space.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


def features(found: list[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to ``longest`` neighbouring words, repeats included."""
    yield from found
    for n in range(2, longest + 1):
        yield from (b" ".join(found[k : k + n]) for k in range(len(found) - n + 1))


def csr(ids: list[int | None], n_words: list[int], hashed: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One block: the rows' features, sorted by (row, bucket) and counted."""
    rows = np.repeat(np.arange(len(ids)), [len(x) for x in hashed])
    flat = np.concatenate(hashed) if hashed else np.zeros(0, np.int64)
    keys, counts = np.unique(rows * buckets + flat, return_counts=True)
    indptr = np.searchsorted(keys, np.arange(len(ids) + 1) * buckets)
    cols = [(ids, pa.int64()), (n_words, pa.int64()), (indptr, pa.int64()), (keys % buckets, pa.int32()), (counts, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(kind)) for x, kind in cols], [c.split()[0] for c in BLOCKS.split(", ")])


def _blocks(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n_words, hashed, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                ids.append(doc)
                n_words.append(len(found))
                hashed.append(np.fromiter(map(zlib.crc32, features(found, longest)), np.int64) % buckets)
                held += len(hashed[-1])
                if held >= BLOCK_FEATURES or len(ids) >= ARROW_ROWS:
                    yield csr(ids, n_words, hashed, buckets)
                    ids, n_words, hashed, held = [], [], [], 0
        if ids:
            yield csr(ids, n_words, hashed, buckets)

    return run


def matrix(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> DataFrame:
    """The count matrix of ``docs`` as CSR blocks, one row each; a text without words is an empty row of its block."""
    return mapped(id_and_text(docs), _blocks(buckets, longest), BLOCKS)


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The blocks of a batch: (ids, words, indptr, indices, counts)."""
    for k in range(batch.num_rows):
        ids, n_words, *rest = (c[k].values for c in batch.columns)
        yield (ids, n_words, *(x.to_numpy(zero_copy_only=False) for x in rest))


def _sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, indices, counts in _arrays(batch):
                np.add.at(total, indices, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs. Each task adds up its own blocks; ``buckets`` numbers reach the driver, whatever the input."""
    out = np.zeros(buckets, np.int64)
    for r in mapped(blocks, _sums(buckets), "bucket int, n long", 8).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed distributions, rounded down."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weights(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n_words, indptr, indices, counts in _arrays(batch):
                so_far = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[indptr]
                n, total = np.diff(so_far(counts)), np.diff(so_far(counts * gain[indices]))
                cols = [ids, n_words, pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight"])

    return run


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains, divided by the row's features and rounded down."""
    return mapped(blocks, _weights(gain), "doc_id long, n_words long, n_features long, weight long", 8)


def noise(seed: int):
    """Thousandths of a Gumbel variate made from doc_id alone, rounded down; null counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(scored: DataFrame, percent: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows with ``rank``, null where they aren't drawn. ``scored`` should be a written table.

    Scores are whole thousandths of logarithms, so there are at most some 200,000 of them however many rows there are: a count for each
    tells the last score drawn and how many rows stand above each, and only rows of one score are ordered among
    themselves, by doc_id (null last). Rows alike in all columns are ordered once and take neighbouring ranks.
    """
    fit = scored.where(F.col("n_words") >= least_words)
    counts = sorted(((r.score, r["n"]) for r in fit.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    most, above, places = sum(n for _, n in counts) * percent // 100, 0, []
    for score, n in counts:
        if above >= most:
            break
        places.append((score, above))
        above += n
    taken = F.lit(False) if not places else (F.col("n_words") >= least_words) & (F.col("score") >= places[-1][0])
    rest = scored.where(~taken).withColumn("rank", F.lit(None).cast("long"))
    ahead = scored.sparkSession.createDataFrame(places, "score long, above long")
    w = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features").rowsBetween(Window.unboundedPreceding, 0)
    alike = scored.where(taken).groupBy(*scored.columns).agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(w))
    ranked = alike.join(F.broadcast(ahead), "score").withColumn("rank", F.explode(F.sequence(F.col("above") + F.col("upto") - F.col("m") + 1, F.col("above") + F.col("upto"))))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return ranked.select(*scored.columns, "rank").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, buckets: int = BUCKETS, longest: int = LONGEST_RUN, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_features, weight, score, rank), rank null where the document is not drawn.

    ``target`` has a column text. Null and empty texts have no features and weigh zero; they and other short texts are scored but
    never drawn. Very long texts are whole rows of a block of their own. Repeated rows count as often as they stand there; a
    null doc_id is drawn like any other, last in ties. Columns other than doc_id and text aren't read, whatever their names.
    An empty table of documents gives an empty result, an empty target the distribution of no text at all.
    """
    blocks = saved(matrix(docs, buckets, longest), "csr")
    aim = matrix(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets))
    scored = weights(blocks, gain).withColumn("score", F.col("weight") + noise(seed))
    return drawn(saved(scored, "scored"), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def oracle(percent: int = 10, seed: int = 2024, buckets: int = BUCKETS, least_words: int = LEAST_WORDS) -> str:
    """The same in DuckDB, with the checksum spelled out byte by byte, for runs of one word."""
    found = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with {_crc.STEPS},
doc as (select doc_id, {found} as w from documents),
aim as (select unnest({found}) as w from benchmark),
vocabulary as (select distinct w, hex(encode(w)) as h from (select unnest(w) as w from doc union all select w from aim)),
hashed as (
  select w, ({_crc.of_hex('h')} % {buckets})::int as b
  from vocabulary, steps),
words as (select doc_id, unnest(w) as w from doc),
s as (select b, count(*) as s from words join hashed using (w) group by b),
t as (select b, count(*) as t from aim join hashed using (w) group by b),
gain as (
  select b, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select sum(s) from s) + {buckets})::double / ((s + 1)::double * (coalesce((select sum(t) from t), 0) + {buckets})::double)))::bigint as g
  from s left join t using (b)),
sums as (select doc_id, sum(g) as g from words join hashed using (w) join gain using (b) group by doc_id),
scored as (
  select doc_id, coalesce(len(w), 0)::bigint as n_features, case when coalesce(len(w), 0) = 0 then 0 else ((g - ((g % len(w)) + len(w)) % len(w)) // len(w)) end::bigint as weight
  from doc left join sums using (doc_id)),
noisy as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
  from scored),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from noisy where n_features >= {least_words})
select doc_id, n_features, weight, score, case when place <= n * {percent} // 100 then place end::bigint as rank
from noisy left join placed using (doc_id)
"""

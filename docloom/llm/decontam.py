"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the words around them.

One pass over all documents finds where they hold an n-gram of some item: a bitmap of bounded size, however large the
benchmark is, leaves most places out, and those left are rows (document, place, n-gram). How often an n-gram occurs is counted from them over
all documents; each item's rarer n-grams are its seeds. Seeds are a table that is joined to those rows, which gives each
document's candidate items, and each candidate is aligned with the passages around its seeds. Neither items nor n-grams are
gathered on the driver, but for the bitmap and, where they are counted to be few, the benchmark's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import mapped, saved

NGRAM = 3
#: Match 1, substitution and gap -0.5. A copy of which a fifth of the words are replaced scores 0.8 - 0.1 = 0.7 of its length.
PENALTY, LEAST_SCORE = 0.5, 0.7
#: Most of the benchmark's words that tasks get as a dictionary; with more, every word of a text is hashed.
MOST_KNOWN = 200_000
#: Words whose hashes a worker keeps; bits of the bitmap, least and most; most rows that are broadcast.
MOST_WORDS, LEAST_BITS, MOST_BITS, BROADCAST_ROWS = 200_000, 1 << 16, 1 << 26, 200_000
_STRIP = ".,;:!?\"'()[]{}<>«»¡¿-–—*_"
_B = np.uint64(0x9E3779B97F4A7C15)
#: What stands for a word that no item has, and for bare punctuation, which is left out.
UNKNOWN, NOTHING = 0, -1


def words(text: str | None) -> list[str]:
    return [w for x in (text or "").lower().split() if (w := x.strip(_STRIP))]


def word_hash(word: str) -> int:
    """Positive, and neither of the two marks."""
    return xxhash.xxh64_intdigest(word, 31) >> 1 | 4


class Words(dict):
    """Hashes of words as they stand in a text, made when first seen, or looked up among those of the benchmark."""

    def __init__(self, known: dict[str, int] | None = None):
        super().__init__(known or {})
        self.known = known

    def __missing__(self, word: str) -> int:
        core = word.strip(_STRIP)
        if self.known is not None:
            return (self.known.get(core, UNKNOWN) if core else NOTHING)
        got = word_hash(core) if core else NOTHING
        if len(self) >= MOST_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        ids = np.fromiter(map(self.__getitem__, text.lower().split()), np.int64)
        return ids[ids != NOTHING]


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of n words."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ out >> np.uint64(29)) * _B + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return (out ^ out >> np.uint64(32)).view(np.int64)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local score of ``item`` in ``passage`` and the place after its last word; gaps along a row by a running maximum."""
    n = len(passage)
    slope = PENALTY * np.arange(n + 1)
    row, best, end = np.zeros(n + 1), 0.0, 0
    for x in item:
        new = np.maximum(row - PENALTY, 0)
        np.maximum(new[1:], row[:-1] + np.where(passage == x, 1.0, -PENALTY), out=new[1:])
        row = np.maximum.accumulate(new + slope) - slope
        k = int(row.argmax())
        if row[k] > best:
            best, end = float(row[k]), k
    return best, end


def aligned(item: np.ndarray, text: np.ndarray, starts: list[int]) -> tuple[float, int, int] | None:
    """(score, first word, word after the last) of the best passage of ``text`` around the places where ``item`` would start
    by its seeds (ascending); None below the least score."""
    reach, best = len(item) // 2 + 1, (0.0, 0, 0)
    first = last = starts[0]
    for s in [*starts[1:], None]:
        if s is not None and s - last <= len(item):
            last = s
            continue
        lo, hi = max(0, first - reach), min(len(text), last + len(item) + reach)
        score, end = smith_waterman(item, text[lo:hi])
        if score > best[0]:
            best = (score, lo, lo + end)
        first = last = s
    if best[0] < LEAST_SCORE * len(item) - 1e-9:
        return None
    back = smith_waterman(item[::-1], text[best[1] : best[2]][::-1])[1]
    return best[0] / len(item), best[2] - back, best[2]


# --- the steps, each a table --------------------------------------------------------------------------------------------

ITEMS = "item long, item_id long, tokens array<string>, words array<long>"
GRAMS = "item long, place int, gram long, n int"
HITS = "doc_id long, text_key long, at int, gram long"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, k, w, [word_hash(x) for x in w]) for i, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (w := words(t))]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["item", "item_id", "tokens", "words"])


def _item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, ws in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n = min(NGRAM, len(ws))
            g = gram_keys(np.array(ws, np.int64), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), item)), pa.array(np.arange(len(g), dtype=np.int32)), pa.array(g), pa.array(np.full(len(g), n, np.int32))], ["item", "place", "gram", "n"])


def _hits(known: dict[str, int] | None, bitmap: np.ndarray, sizes: list[int]):
    mask = np.uint64(64 * len(bitmap) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Words(known)
        for batch in batches:
            rows, places, grams = [], [], []
            for row, t in enumerate(batch.column(2).to_pylist()):
                if not t:
                    continue
                ids = lookup.of(t.decode("utf-8", "replace"))
                for n in sizes:
                    at = np.arange(max(0, len(ids) - n + 1))
                    for k in range(n):
                        at = at[ids[at + k] != UNKNOWN]
                    if len(at):
                        g = gram_keys(ids, n)[at]
                        bit = g.view(np.uint64) & mask
                        hit = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                        rows.append(np.full(hit.sum(), row))
                        places.append(at[hit].astype(np.int32))
                        grams.append(g[hit])
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate(places)), pa.array(np.concatenate(grams))], ["doc_id", "text_key", "at", "gram"])

    return run


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lookup, seen = Words(), (None, None)
    for batch in batches:
        rows = []
        for doc, item_id, item, starts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen[0] != text:
                seen = (text, lookup.of(text.decode("utf-8", "replace")))
            if (got := aligned(np.array(item, np.int64), seen[1], starts)) is not None:
                rows.append((doc, item_id, *got))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "score", "start_word", "end_word"])


def _few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """For a join: broadcast if counted to be small. Both sides of the joins below are written tables or plain scans, so
    where they are shuffled AQE can split a key that very many rows have."""
    return F.broadcast(df) if df.count() <= most else df


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _same_document(a: str, b: str) -> F.Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Candidates aligned: (doc_id, text_key, item_id, score, start_word, end_word), one row for each row of ``docs`` and item."""
    spark = docs.sparkSession
    out = "doc_id long, item_id long, score double, start_word long, end_word long"
    text = F.col("text").cast("string")
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).where("text is not null").distinct()
    items = saved(mapped(rows.select(F.xxhash64("item_id", "text", F.lit(41)).alias("item"), "item_id", "text"), _items, ITEMS), "items")
    grams = saved(mapped(items.select("item", "words"), _item_grams, GRAMS), "item_grams")
    sizes, count = sorted(r.n for r in grams.select("n").distinct().collect()), grams.count()  # three sizes at most
    if not count:
        return spark.createDataFrame([], out)
    vocabulary = saved(items.select(F.explode("tokens").alias("w")).distinct(), "words")
    known = {r.w: word_hash(r.w) for r in vocabulary.collect()} if vocabulary.count() <= MOST_KNOWN else None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * count).bit_length()))
    bit = F.col("gram").bitwiseAND(F.lit(bits - 1))
    # At most MOST_BITS / 64 rows, whatever the benchmark.
    part = grams.select(F.shiftright(bit, 6).alias("k"), F.expr(f"shiftleft(1L, cast(gram & {min(bits, 64) - 1}L as int))").alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    bitmap = np.zeros(bits // 64, np.int64)
    for r in part.collect():
        bitmap[r.k] = r.b
    hits = saved(mapped(_keyed(docs), _hits(known, bitmap.view(np.uint64), sizes), HITS), "hits")
    often = hits.groupBy("gram").agg(F.count("*").alias("often"))
    counted = saved(grams.join(often, "gram"), "counted")
    # N-grams that don't occur at all can't be seeds and don't count for the median, lest those that an edited copy has
    # kept look frequent beside those that it has lost.
    limit = counted.groupBy("item").agg((4 * F.expr("percentile(often, 0.5)")).alias("most"))
    seeds = saved(counted.join(limit, "item").where("often <= most").select("gram", "item", "place"), "seeds")
    near = hits.join(_few(seeds), "gram").groupBy("doc_id", "text_key", "item").agg(F.array_sort(F.collect_set(F.col("at") - F.col("place"))).alias("starts"))
    near = saved(near, "candidates")
    size = near.agg(F.sum(F.size("starts"))).first()[0] or 0
    near = near.join(_few(items.select("item", "item_id", "words"), 20_000), "item")
    near = F.broadcast(near) if size <= BROADCAST_ROWS else near
    both = _keyed(docs).alias("d").join(near.alias("n"), _same_document("d", "n")).select("d.doc_id", "n.item_id", "n.words", "n.starts", "d.text", "d.text_key")
    return both


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: (doc_id, item_id, score, start_word, end_word).

    Words are lower-cased, parted by white space and stripped of punctuation. The score is that of the best local
    alignment, divided by the item's words; rows have 0.7 or more. Null, empty and wordless texts on either side match
    nothing; an item of one or two words is its own seed; items with a null id are reported with a null item_id. Repeated
    documents each get their rows, and so do null doc_ids; repeated items count once. Very long texts are aligned around
    their seeds only. Without items, or without documents, there are no rows.
    """
    got = _found(docs, benchmark)
    if "text" not in got.columns:
        return got
    return mapped(got.drop("text_key"), _alignments, "doc_id long, item_id long, score double, start_word long, end_word long")


def _keyed_alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lookup, seen = Words(), (None, None)
    for batch in batches:
        ok = []
        for item, starts, text in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            if seen[0] != text:
                seen = (text, lookup.of(text.decode("utf-8", "replace")))
            ok.append(aligned(np.array(item, np.int64), seen[1], starts) is not None)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok, pa.bool_())) for k in (0, 5)], ["doc_id", "text_key"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns as they were, that hold no item. Null and empty texts stay; repeated rows are
    treated alike; without items, or without documents, all stay as they are."""
    got = _found(docs, benchmark)
    if "text" not in got.columns:
        return docs
    gone = saved(mapped(got, _keyed_alignments, "doc_id long, text_key long").distinct(), "contaminated")
    here = (F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id"))) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("g.text_key"))
    return docs.alias("d").join(_few(gone, 1_000_000).alias("g"), here, "left_anti")

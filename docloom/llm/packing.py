"""Packing token sequences into bins of fixed length: a configuration linear program over the length histogram.

Variables are patterns (how many pieces of each length share a sequence); each length must be covered as often as it
occurs. Multiplicative weights raise the price of lengths that lag behind, a knapsack dynamic program finds patterns of
greatest price, and the fractional solution is rounded. The program is solved anew for what rounding leaves, until that is
a few hundredths of the pieces, which are placed best-fit decreasing. All of this works on counts by length, at most
``capacity`` of them, so its cost does not grow with the number of documents.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm._bpe import byte_letters
from docloom.llm._common import id_and_text, mapped, saved

CAPACITY = 2048
#: Rounds in which each length is covered a like share; how far a lagging length's price rises; share of pieces left to best-fit.
ROUNDS, RAISE, REST = 12, 2e-3, 0.06
#: The same, where no pattern fills a sequence any more.
SPARE = 0.1
#: Most words that a worker keeps encoded before they become the older half of what it keeps.
MOST_WORDS = 150_000
#: Below this, lower case maps letter to letter and every text is in composed form.
PLAIN = "\u0130"
#: Pieces of a length that one task numbers, at least, and most shares of the numbering beyond one a length.
TURN, MOST_SHARES = 500, 65_536

_PACKED = [struct.Struct(f"<{n}I").pack for n in range(64)]
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordEncoder(dict):
    """Little-endian ids of the words between white space, each encoded when first seen. When full, the words become the older half; of
    these, those that are used again come along.

    The vocabulary's pre-tokens never span white space, and its normalisation (composed form, lower case) never looks
    across it, so a text's ids are those of its words in turn.
    """

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model.tokenize
        special = [regex.escape(x.content) for x in self.library.get_added_tokens_decoder().values()]
        self.marks = regex.compile("|".join(special) or r"(?!)").search
        self.older: dict[str, bytes] = {}
        self.letters = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MOST_WORDS:
            self.older = dict(self)
            self.clear()
        core = word[:-1]
        if (got := self.older.get(word)) is not None:
            pass
        elif word[-1:] in (".", ",") and core.isalpha():
            got = self[core] + self[word[-1]]
        elif not word.isalnum() and self.marks(word):
            got = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            plain = word.lower() if word.isascii() or max(word) < PLAIN else self.library.normalizer.normalize_str(word)
            ids: list[int] = []
            for piece in (plain,) if plain.isalpha() else _PRETOKEN.findall(plain):
                if not piece.isascii():
                    piece = "".join(map(self.letters.__getitem__, piece.encode()))
                ids += [t.id for t in self.model(piece)]
            got = _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)
        if len(word) < 64:
            self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the vocabulary's patterns
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def encoder(name: str) -> WordEncoder:
    """Kept from task to task in each Python worker."""
    return WordEncoder(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(name: str, capacity: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(name)
        for batch in batches:
            rows, ids = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = words.ids(text.decode("utf-8", "replace")) + bytes(4) if text else bytes(4)
                for piece, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    ids.append(part)
            cols = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            if keep:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*(c.split()[0] for c in PIECES.split(", ")), *["ids"] * keep])

    return run


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The documents' tokens, an end token (id 0) after each, cut only where longer than ``capacity``."""
    return mapped(id_and_text(docs), _pieces(vocabulary, capacity, keep_ids), PIECES + ", ids array<int>" * keep_ids)


# --- the configuration program, on counts by length ---------------------------------------------------------------


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the greatest total value that fits in 0..capacity."""
    best = np.zeros(capacity + 1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            best[c] = max(best[c], (best[c - lengths[: fits[c]]] + values[: fits[c]]).max())
    return best


def pattern(first: int, best: np.ndarray, values: np.ndarray, lengths: np.ndarray, counts: np.ndarray, covered: np.ndarray) -> dict[int, int]:
    """Piece ``first`` and a best use of the rest by the table ``best``: (number of a length: times).

    Among pieces that are within less than a token's worth of the best, the one of the least covered length is taken. Lengths that are
    covered, or used as often as they occur, are closed.
    """
    capacity = len(best) - 1
    out, c = {first: 1}, capacity - int(lengths[first])
    while c > 0 and (n := int(np.searchsorted(lengths, c, side="right"))):
        worth = np.where(covered[:n] < 1 - 1e-9, best[c - lengths[:n]] + values[:n], -1.0)
        for k, times in out.items():
            if k < n and times + 1 > counts[k]:
                worth[k] = -1.0
        if (top := worth.max()) <= 0:
            break
        near = np.flatnonzero(worth >= top - 0.8 / capacity)
        k = int(near[covered[near].argmin()])
        out[k] = out.get(k, 0) + 1
        c -= int(lengths[k])
    return out


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Multiplicative weights for the configuration program: a fractional number of each pattern that covers all counts.

    A price is a length's share of the capacity times a weight that rises with how far its coverage lags behind the
    round's goal. Each round prices once and then serves the lagging lengths in turn.
    """
    covered, use = np.zeros(len(lengths)), {}
    for r in range(rounds):
        goal = (r + 1) / rounds
        values = lengths / capacity * np.exp(RAISE * np.clip(goal - covered, -1, 1))
        values[covered >= 1 - 1e-9] = 0
        best = price(values, lengths, capacity)
        for k in np.argsort(covered if r % 2 else -lengths, kind="stable"):
            if covered[k] >= goal - 1e-9:
                continue
            p = pattern(int(k), best, values, lengths, counts, covered)
            which, times = np.array(list(p)), np.array(list(p.values()))
            amount = min((goal - covered[k]) * counts[k] / p[int(k)], float(((1 - covered[which]) * counts[which] / times).min()))
            if amount > 1e-9:
                covered[which] += amount * times / counts[which]
                name = tuple(sorted((int(lengths[q]) for q, n in p.items() for _ in range(n)), reverse=True))
                use[name] = use.get(name, 0.0) + amount
    return use


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: equal bins are filled together."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            room = next((r for r in range(size, capacity) if bins.get(r)), None)
            if room is None:
                per = capacity // size
                full, rest = divmod(n, per)
                for items, times in ((per, full), (rest, 1)):
                    if items and times:
                        of = bins.setdefault(capacity - items * size, {})
                        of[(size,) * items] = of.get((size,) * items, 0) + times
                n = 0
                break
            p, times = next(iter(bins[room].items()))
            per = room // size
            if n >= per:
                uses, items = min(times, n // per), per
            else:
                uses, items = 1, n
            n -= uses * items
            if times == uses:
                del bins[room][p]
            else:
                bins[room][p] = times - uses
            of = bins.setdefault(room - items * size, {})
            of[p + (size,) * items] = of.get(p + (size,) * items, 0) + uses
    return [(p, n) for of in bins.values() for p, n in of.items()]


def programmed(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns of the rounded program and how often each is used, and the counts by length that they leave.

    Whole parts of the solution are taken first, then patterns once each as long as their pieces last; of those patterns that leave
    least room, so that none is wasted while full ones are to be had. What is left is a smaller program of the same kind.
    """
    left, out = counts.astype(np.int64).copy(), []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    total = int(left.sum())
    while left.sum() > REST * total:
        lengths = np.flatnonzero(left)
        use = sorted(fractional(lengths, left[lengths].astype(float), capacity).items(), key=lambda x: (-x[1], x[0]))
        placed, room = 0, 0
        while not placed:
            for whole in (True, False):
                for p, x in use:
                    if sum(p) < capacity - room:
                        continue
                    which, times = np.unique(p, return_counts=True)
                    n = int(min(np.floor(x + 1e-9) if whole else 1, (left[which] // times).min()))
                    if n > 0:
                        left[which] -= n * times
                        placed += n * len(p)
                        out.append((p, n))
            if not placed and left.sum() <= SPARE * total:
                return out, left
            room = 2 * room + 1
    return out, left


def packed(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, for ``counts`` pieces by length (index 0 unused): every piece exactly once."""
    out, left = programmed(counts, capacity)
    return out + best_fit(left, capacity)


def runs(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """The plan by length: rows (length, first rank, first sequence, pieces a sequence, offset), sorted by length and rank."""
    rows, rank, sequence = [], {}, 0
    for p, n in plan:
        offset = 0
        for size in sorted(set(p), reverse=True):
            per = p.count(size)
            rows.append((size, rank.get(size, 0), sequence, per, offset))
            rank[size] = rank.get(size, 0) + per * n
            offset += per * size
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray):
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1]
            turn = rank - row[:, 1]
            keep = [c for c in names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in keep), pa.array(row[:, 2] + turn // row[:, 3]), pa.array(row[:, 4] + turn % row[:, 3] * length)],
                [*keep, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    A null or empty text is the end token alone. Repeated rows are packed once each; null doc_ids are kept. An empty
    table gives an empty result; a very long text is cut into pieces like any other. Only lengths and checksums are
    shuffled, unless ``keep_ids``. The driver gets the histogram (at most ``capacity`` rows) and counts by length and share
    (at most 65,536 more), whatever the input.
    """
    got = saved(pieces(docs, vocabulary, capacity, keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    spark = docs.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in got.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    # A length's pieces are dealt out to be numbered: at most capacity + MOST_SHARES shares in all, so their tables may be broadcast.
    turn = max(TURN, int(counts.sum()) // MOST_SHARES)
    shares = spark.createDataFrame([(int(x), -(-int(counts[x]) // turn)) for x in np.flatnonzero(counts)] or [(0, 1)], "length long, shares long")
    dealt = got.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares")))
    base, at = [], {}
    for length, share, n in dealt.groupBy("length", "share").agg(F.count("*").alias("n")).orderBy("length", "share").collect():
        base.append((length, share, at.get(length, 0)))
        at[length] = at.get(length, 0) + n
    first = spark.createDataFrame(base or [(0, 0, 0)], "length long, share long, base long")
    ranked = dealt.selectExpr("*", "row_number() over (partition by length, share order by row) - 1 as turn")
    ranked = ranked.join(F.broadcast(first), ["length", "share"]).withColumn("rank", F.col("turn") + F.col("base"))
    names = [c for c in got.columns if c != "row"]
    table = runs(packed(counts, capacity))
    schema = ", ".join(f"{c} {t}" for c, t in got.drop("row").dtypes) + ", sequence_id long, offset long"
    return mapped(ranked.select(*names, "rank"), _placed(table), schema, 512 if keep_ids else 10_000)

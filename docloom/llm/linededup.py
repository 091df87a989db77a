"""Line deduplication by a deletion-neighbourhood join.

Lines are compared as sequences of words; a line goes if an earlier one equals it or, from five words on, is within one word
of it (replaced, added or taken away); in ``deduplicated`` also if it is within a fifth of the longer one's words. Two lines are
that near exactly if they share a variant: the whole line, or the line less one word. Variants are joined as keys of 128 bits,
so that no two different ones meet by chance, the edit distance is verified all the same, and the earliest line stays.

Variants of a line are many, so only lines that can have a partner emit them: two lines within one edit agree in their
first or in their last half. All holders of a variant with the same place taken out are within one edit of each other,
and so is the whole line that equals the variant; hence a least place in order for each (variant, place) finds every
line's earliest partner, and no group is ever expanded into pairs or gathered in one place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm import _common
from docloom.llm._common import dropped, fresh, mapped

#: Lines of fewer words have no edits to spare (one edit in five is a similarity of 0.8): only equal ones can repeat.
LEAST_WORDS = 5
#: Fewest words of a line that may be two edits from one of ten.
LEAST_SIMILAR = 8
#: Most words whose hashes a worker keeps; grams that it packs at once; grams a part should hold.
MOST_WORDS, MOST_HELD, PART = 60_000, 250_000, 500_000
#: How often lines that others rule out are put aside; each time the rest hold fewer blocks in common.
ROUNDS = 2
#: Lines that each line is compared with before pairs are made.
FIRST = 6
#: Most runs whose counts are sent to the tasks that choose among runs; words that are chosen from at once.
MOST_OFTEN, PIECE = 100_000, 400
#: Bits of a gram as dealt (the others tell its cell), and a length at least 1.25 times another is at most one class further.
GRAM_BITS, LENGTHS = 30, np.log(1.2501)
#: Most candidate lines whose keys are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 400_000
_B = np.uint64(0x9E3779B97F4A7C15)
_BASES = (_B, np.uint64(0xD1342543DE82EF95))
#: Variants that a task packs at once.
MOST_VARIANTS = 200_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """These tables are many at once, so they are packed more tightly than others. What was shuffled for one goes before the next is made:
    the shuffles of two neighbouring steps together take several times the disk of the input."""
    out = _common.saved(df, name, "zstd")
    _common.unreferenced(df.sparkSession)
    return out


def small(df: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it has at most BROADCAST_ROWS rows: what it is joined with is not shuffled then."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def joined(rows: DataFrame, facts: DataFrame, on: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """``_common.joined``, but facts of at most BROADCAST_ROWS rows are all looked up where the rows are."""
    if facts.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(facts.drop("held")), on, how)
    return _common.joined(rows, facts, on, total, how)


def key(*parts: bytes) -> int:
    return xxhash.xxh64_intdigest(b"\x00".join(parts), 17) - (1 << 63)


def line_key(w: list[bytes]) -> bytes:
    """128 bits: at any number of lines, two with the same key are equal."""
    return xxhash.xxh3_128_digest(b"\x00".join(w), 17)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of 16 bytes as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, 16 * len(rows) + 1, 16, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def line_words(line: bytes) -> list[bytes]:
    """ASCII lower case, ASCII white space."""
    return line.lower().split()


def half_keys(w: list[bytes]) -> list[int]:
    """Keys of the first and last halves, as against a partner of as many words and of one more."""
    out = []
    for most in (len(w), len(w) + 1):
        c = most // 2  # ceil((most - 1) / 2)
        out += [key(b"p%d" % most, *w[:c]), key(b"s%d" % most, *w[len(w) - c :])]
    return out


def variants(w: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the whole line (place -1) and of the line less each word (place: that word's), each two lanes of 64 bits."""
    h = np.array([xxhash.xxh64_intdigest(x, 19) for x in w], np.uint64)
    n = len(w)
    lanes = []
    for base in _BASES:
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(n, base, np.uint64))
        term = h * power[:n]
        before = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(term)])
        shifted = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(h[1:] * power[: n - 1])])  # words after the first, one place down
        less = before[:n] + (shifted[n - 1] - shifted)
        keys = np.concatenate([before[n:] + np.uint64(n), less + np.uint64(n - 1)])
        keys ^= keys >> np.uint64(29)
        keys = keys * np.uint64(0xBF58476D1CE4E5B9)
        lanes.append(keys ^ keys >> np.uint64(32))
    return np.stack(lanes, 1), np.arange(-1, n)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= max(len(a), len(b)) - 1


def bound(n: int) -> int:
    """Most edits at which a line of ``n`` words and one no longer have a similarity of 0.8."""
    return n // 5


def within(a: list[bytes], b: list[bytes], most: int) -> bool:
    """Whether the edit distance in words is at most ``most``: columns of the table as bits of one integer."""
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    a, b = a[p : len(a) - s], b[p : len(b) - s]
    if not a or not b:
        return len(a) + len(b) <= most
    at: dict[bytes, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for k, x in enumerate(b):
        same = at.get(x, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = (down | ~(h | up)) & full, up & h
        distance += bool(more & top) - bool(less & top)
        if distance - (len(b) - 1 - k) > most:
            return False
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = (less | ~(v | more)) & full, more & v
    return distance <= most


class _Hash(dict):
    """Hashes of words, each made when first seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 23)
        return got


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def single(lines: list[list[bytes]], hashes: _Hash) -> Runs:
    """The lines' words in the place of runs, all of which count."""
    n = np.array([len(w) for w in lines], np.int64)
    g = np.array([hashes[x] for w in lines for x in w], np.uint64)
    return g, np.repeat(np.arange(len(n)), n), np.ones(len(g), bool), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def grams(lines: list[list[bytes]], hashes: _Hash) -> Runs:
    """The lines' runs of three words: their keys, the numbers of their lines, whether they are blocks (start at 0, 3, 6 ...), and their places.

    The shortest lines have too few blocks, and all their runs count as such.
    """
    n = np.array([len(w) for w in lines], np.int64)
    h = np.array([hashes[x] for w in lines for x in w], np.uint64)
    g = h[:-2] * _B + h[1:-1]
    g = (g ^ g >> np.uint64(31)) * _B + h[2:]
    g = (g ^ g >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    line = np.repeat(np.arange(len(n)), n)[:-2]
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))[:-2]
    whole = at <= n[line] - 3
    return g[whole], line[whole], ((at % 3 == 0) | (n[line] == LEAST_SIMILAR))[whole], at[whole]


def cells(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cell of a run at ``at`` in a line of ``n`` words: six bits of length, three of place.

    Of two lines within the bound, the longer has at most 5/4 of the other's words, and what is whole in both has places that are, as shares
    of their lines, at most a fifth apart: with x edits before it and y after it, (1 - share) * x + share * y at most, of na // 5 in all.
    So in either respect the cells are equal or neighbours. No length is at either end of its range, and no place.
    """
    length = np.clip((np.log(np.maximum(n, LEAST_SIMILAR)) / LENGTHS).astype(np.int64) - 8, 1, 62)
    return (length << 3 | at * 5 // n + 1).astype(np.uint64)


LINES = "doc_id long, text_key long, line_no int, n int, line binary, k0 long, k1 long, k2 long, k3 long"
TEXTS = "doc_id long, text_key long, line_no int, line binary, words binary"
VARIANTS = "id long, first decimal(38,0), variant binary, place int"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.replace("38,0", "38").split(", ")]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        rows = []
        for doc, text_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, line in enumerate((text or b"").split(b"\n")):
                if w := line_words(line):
                    own = line_key(w)
                    # One row of a line is enough to carry its halves, as the least ones are taken.
                    halves = (None,) * 4 if len(w) < LEAST_WORDS or own in seen else half_keys(w)
                    if len(seen) >= MOST_WORDS:
                        seen.clear()
                    seen.add(own)
                    rows.append((doc, text_key, k, len(w), own, *halves))
        cols = list(zip(*rows, strict=True)) or [()] * 9
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _names(LINES))


def _wanted_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text_key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, line in enumerate((text or b"").split(b"\n")):
                w = line_words(line)
                if len(w) >= LEAST_WORDS:
                    rows.append((doc, text_key, k, line_key(w), b" ".join(w)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], _names(TEXTS))


def _chunks(words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs of lines that hold about ``most`` words."""
    start = size = 0
    for k, w in enumerate(words):
        size += w.count(b" ") + 1
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(words):
        yield start, len(words)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(2).to_pylist()
        for s, e in _chunks(words, MOST_VARIANTS):
            got = [variants(w.split(b" ")) for w in words[s:e]]
            take = pa.array(np.repeat(np.arange(s, e), [len(p) for _, p in got]))
            keys, places = np.concatenate([k for k, _ in got]), np.concatenate([p for _, p in got])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), _binary(keys), pa.array(places.astype(np.int32))], _names(VARIANTS))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        ok = [within_one(x.split(b" "), y.split(b" ")) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], ["id", "near"])


def _dealt(parts: int, column: str, runs=grams):
    """Grams by part, packed: 40 bits (30 of the gram, 9 of its cell, and whether it is a block), and the line's tag of 32 bits.

    A gram that a task meets in several lines, in one cell, is settled there: their blocks are counted as shared (``kind`` 1: tag and count), and
    only two of the tags are passed on, so that what is dealt of a gram grows with the tasks and not with its holders.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, held, size = _Hash(), set(), [], 0

        def flushed():
            g, tag, block, cell = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((g >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
            gram = (g & np.uint64((1 << GRAM_BITS) - 1)) << np.uint64(9) | cell
            order = np.lexsort((tag, gram, part))
            part, gram, tag, block = part[order], gram[order], tag[order], block[order]
            new = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(gram, prepend=~gram[:1]) != 0))
            size = np.diff(new, append=len(gram))
            several = tag[new] != tag[new + size - 1]  # sorted by tag within a gram
            of_several = np.repeat(several, size)
            tags, n = np.unique(tag[of_several & block], return_counts=True)
            ends = np.zeros(len(gram), bool)
            ends[new[several]] = ends[(new + size - 1)[several]] = True
            block &= ~of_several
            kept = ends | ~of_several
            part, gram, tag, block = part[kept], gram[kept], tag[kept], block[kept]
            value = gram << np.uint64(1) | block.astype(np.uint64)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(part)]
            data = [value[i:j].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + tag[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]
            told = np.stack([tags, n.astype(np.uint32)], 1).tobytes()
            own = int(part[0])
            return pa.RecordBatch.from_arrays([pa.array([*part[cuts[:-1]].tolist(), own], pa.int32()), pa.array([0] * len(data) + [1], pa.int32()), pa.array([*data, told], pa.binary())], ["part", "kind", "data"])

        for batch in batches:
            lines, tags = [], []
            for text in batch.column(batch.schema.names.index(column)).to_pylist():
                for line in (text or b"").split(b"\n"):
                    w = line_words(line)
                    if len(w) >= LEAST_SIMILAR and (k := line_key(w)) not in seen:
                        if len(seen) >= MOST_WORDS:
                            seen.clear()
                        seen.add(k)
                        lines.append(w)
                        tags.append(int.from_bytes(k[:4], "big"))
            if lines:
                g, line, block, at = runs(lines, hashes)
                held.append((g, np.array(tags, np.uint32)[line], block, cells(np.array([len(w) for w in lines])[line], at)))
                size += len(g)
            if size >= MOST_HELD:
                yield flushed()
                held, size = [], 0
        if held:
            yield flushed()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many blocks of a tag are also in lines of other tags, in the same cell or one beside it, by part."""
    values, tags = [], []
    for batch in batches:
        for part, kind, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if kind:
                told = np.frombuffer(data, np.uint32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(told[:, 0].astype(np.int64)), pa.array(told[:, 1].astype(np.int64))], ["tag", "shared"])
                continue
            n = len(data) // 9
            v = np.zeros((n, 8), np.uint8)
            v[:, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(n, 5)
            values.append(v.reshape(-1).view(np.uint64) | np.uint64(part << 40))
            tags.append(np.frombuffer(data, np.uint32, n, 5 * n))
    if values:
        value, tag = np.concatenate(values), np.concatenate(tags)
        order = np.argsort(value)
        value, tag = value[order], tag[order]
        new = np.flatnonzero(np.diff(value >> np.uint64(1), prepend=np.uint64(1 << 63)))
        here, least, most = value[new] >> np.uint64(1), np.minimum.reduceat(tag, new), np.maximum.reduceat(tag, new)
        low, high = least.copy(), most.copy()
        for step in (1, 7, 8, 9):  # to the cells after this one; from each of these to this one
            at = np.searchsorted(here, here + np.uint64(step))
            one = np.flatnonzero(here[np.minimum(at, len(here) - 1)] == here + np.uint64(step))
            other = at[one]
            low[one], high[one] = np.minimum(low[one], least[other]), np.maximum(high[one], most[other])
            low[other], high[other] = np.minimum(low[other], least[one]), np.maximum(high[other], most[one])
        many = np.repeat(low != high, np.diff(new, append=len(value)))
        # A line met in several tasks is counted as often: too many shared blocks lose nothing.
        got, n = np.unique(tag[many & (value & np.uint64(1) == 1)], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int64)), pa.array(n)], ["tag", "shared"])


HELD = "gram long, held long, earliest long"
CHOSEN = "gram long, a long, na int, low int, high int, left_low int, left_high int, a0 long, a1 long"
MARKS = "gram long, b long, nb int, least int, most int, b0 long, b1 long"


def _marks(lines: list[list[bytes]], hashes: _Hash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' words and runs of three words: keys, numbers of lines, places."""
    (g, line, _, at), (h, line_, _, at_) = single(lines, hashes), grams(lines, hashes)
    return np.concatenate([g, h]), np.concatenate([line, line_]), np.concatenate([at, at_])


def odd_words(lines: list[list[bytes]], hashes: _Hash) -> np.ndarray:
    """For each line and each of 128 classes of words, as bits of two longs: has it an odd number of words of the class? A word replaced changes two bits
    at most, one added or taken away one: so d edits between lines that differ by x in length change at most 2 * d - x."""
    g, line, _, _ = single(lines, hashes)
    odd = np.bincount(line * 128 + (g >> np.uint64(57)).astype(np.int64), minlength=128 * len(lines)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, 128), axis=1).view(np.int64)


def _in(bits: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return bits[(gram >> np.uint64(6)).astype(np.int64) % len(bits)] >> (gram & np.uint64(63)) & np.uint64(1) == 1


def _marked(bits=None):
    """Each word and run of three words of a line once, with its first and last places there; only those of ``_bits``, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hash()
        for batch in batches:
            words = batch.column(1).to_pylist()
            for s, e in _chunks(words, MOST_VARIANTS):
                lines = [w.split(b" ") for w in words[s:e]]
                gram, line, at = _marks(lines, hashes)
                if bits:
                    some = _in(bits.value, gram)
                    gram, line, at = gram[some], line[some], at[some]
                order = np.lexsort((at, gram, line))
                gram, line, at = gram[order], line[order], at[order]
                new = np.flatnonzero((np.diff(gram, prepend=~gram[:1]) != 0) | (np.diff(line, prepend=-1) != 0))
                last = np.append(new[1:], len(gram))[: len(new)] - 1
                n = np.array([len(w) for w in lines], np.int32)[line[new]]
                odd = odd_words(lines, hashes)[line[new]]
                yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), batch.column(0).take(pa.array(line[new] + s)), pa.array(n), pa.array(at[new].astype(np.int32)), pa.array(at[last].astype(np.int32)), *map(pa.array, odd.T)], _names(MARKS))

    return run


def _only(bits):
    """The rows whose gram, the first column, is one of ``_bits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(bits.value, batch.column(0).to_numpy().view(np.uint64))))

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By how many lines each word and run of three words is held, and the least of these, added up for many lines at once."""
    held, size = [], 0

    def flushed():
        gram, line = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((line, gram))
        gram, line = gram[order], line[order]
        new = np.flatnonzero(np.diff(gram, prepend=~gram[:1]) != 0)
        return pa.RecordBatch.from_arrays([pa.array(gram[new]), pa.array(np.diff(new, append=len(gram))), pa.array(line[new])], _names(HELD))

    for batch in _marked()(batches):
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= 4 * MOST_HELD:
            yield flushed()
            held, size = [], 0
    if held:
        yield flushed()


def disjoint(word: np.ndarray, run: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each row of ``n`` words, ``m`` words and runs of three words that don't overlap and cost least together.

    ``word`` and ``run`` hold costs by place. Returned from the last to the first, as (row, how many are before it, place, is it a run).
    """
    never, width = 1 << 40, int(m.max()) + 1
    best = np.full((word.shape[1] + 1, len(n), width), never, np.int64)
    best[:, :, 0] = 0
    for p in range(1, len(best)):
        np.minimum(best[p - 1, :, 1:], best[p - 1, :, :-1] + word[:, p - 1, None], out=best[p, :, 1:])
        if p >= 3:
            np.minimum(best[p, :, 1:], best[p - 3, :, :-1] + run[:, p - 3, None], out=best[p, :, 1:])
    out, at, left = [], n.copy(), m.copy()
    for p in range(len(best) - 1, 0, -1):
        row = np.flatnonzero((at == p) & (left > 0))
        j = left[row]
        now = best[p, row, j]
        skip = best[p - 1, row, j] == now
        one = ~skip & (best[p - 1, row, j - 1] + word[row, p - 1] == now)
        at[row] -= np.where(skip | one, 1, 3)
        row, one = row[~skip], one[~skip]
        left[row] -= 1
        out.append((row, left[row], np.where(one, p - 1, p - 3), ~one))
    return out


def _chosen(often):
    """Of each line of ten words or more its d + 1 words or runs of three that don't overlap and are held by the fewest lines, d being ``bound``.

    ``often`` has the keys that many lines hold, in order, and by how many; any other choice would find the same. Whatever the d edits, for some i the i-th (from 0) is
    whole with i edits before it (fewer only if i is 0) and at most d - i after it: so its place is at most i from that in the other line, and as counted from the end
    at most d - i. What is chosen twice in a line is one row, with the bounds of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (keys, counts) = _Hash(), often.value

        def cost(gram: np.ndarray, other: int) -> np.ndarray:
            if not len(keys):
                return np.full(len(gram), other, np.int64)
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            return np.where(keys[at] == gram, 2 * counts[at], other)

        for batch in batches:
            words = batch.column(1).to_pylist()
            rows, odd = [], np.zeros((len(words), 2), np.int64)
            for s, e in _chunks(words, MOST_VARIANTS):
                which = [k for k in range(s, e) if words[k].count(b" ") >= 9]
                if not which:
                    continue
                lines = [words[k].split(b" ") for k in which]
                (g, _, _, _), (h, _, _, _) = single(lines, hashes), grams(lines, hashes)
                odd[which] = odd_words(lines, hashes)
                n = np.array([len(w) for w in lines])
                word_at, run_at = np.cumsum(n) - n, np.cumsum(n - 2) - (n - 2)
                word, runs, d = cost(g, 3), cost(h, 2), n // 5
                # Pieces (line, from, to), those of like lengths together; each has its share of the line's choices.
                pieces = [(k, c, min(c + PIECE, n[k])) for k in range(len(n)) for c in range(0, n[k], PIECE)]
                pieces = np.array(sorted(pieces, key=lambda x: x[2] - x[1]))
                for c in range(0, len(pieces), 64):
                    line, start, end = pieces[c : c + 64].T
                    size, many = end - start, d[line] + 1
                    before = many * start // n[line]
                    m = many * end // n[line] - before
                    costs = np.full((2, len(line), int(size.max())), 1 << 40, np.int64)
                    for k in range(len(line)):
                        own = runs[run_at[line[k]] + start[k] : run_at[line[k]] + end[k] - 2]
                        costs[0, k, : size[k]] = word[word_at[line[k]] + start[k] : word_at[line[k]] + end[k]]
                        costs[1, k, : len(own)] = own
                    row, turn, at, is_run = (np.concatenate(x) for x in zip(*disjoint(*costs, size, m), strict=True))
                    k, at, turn = line[row], at + start[row], turn + before[row]
                    gram = np.where(is_run, h[np.minimum(run_at[k] + at, len(h) - 1)], g[word_at[k] + at])
                    rows.append((gram, np.array(which)[k], n[k], at - turn, at + turn, n[k] - at - (d[k] - turn), n[k] - at + (d[k] - turn)))
            if not rows:
                continue
            gram, line, n, *bounds = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.lexsort((gram, line))
            gram, line, n, bounds = gram[order], line[order], n[order], [x[order] for x in bounds]
            new = np.flatnonzero((np.diff(gram, prepend=~gram[:1]) != 0) | (np.diff(line, prepend=-1) != 0))
            bounds = [f.reduceat(x, new).astype(np.int32) for f, x in zip([np.minimum, np.maximum] * 2, bounds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), batch.column(0).take(pa.array(line[new])), pa.array(n[new].astype(np.int32)), *map(pa.array, [*bounds, *odd[line[new]].T])], _names(CHOSEN))

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in (1, 2))
        parted = ((x.split(b" "), y.split(b" ")) for x, y in zip(a, b, strict=True))
        ok = [within(x, y, bound(max(len(x), len(y)))) for x, y in parted]
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["id"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def order_of() -> F.Column:
    """A line's place among all: by doc_id (null last), then by line."""
    return (F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)).cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(38,0)")


def place_of(column: str) -> tuple[F.Column, F.Column]:
    """The doc_id (the greatest long for null) and line number that make up a place; the place of nothing is null and null."""
    at = F.lit(1 << 31).cast("decimal(11,0)")
    doc = F.floor(F.col(column) / at).cast("decimal(20,0)")
    return doc.cast("long").alias("doc"), (F.col(column) - doc * at).cast("int").alias("line_no")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, first, words) of the lines ``wanted`` (id, line, first), once each."""
    texts = mapped(_keyed(docs), _wanted_texts, TEXTS).withColumn("first", order_of())
    texts = texts.join(small(wanted), ["line", "first"]).dropDuplicates(["line", "first"])  # as joined, so not shuffled again
    return saved(texts.select("id", "first", "words"), "texts")


def _by_one_edit(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines, the different ones (``id``: a number of their own, ``held``: by how many rows), and (id, near) of those that
    are one edit from an earlier one, with the place of the earliest such."""
    lines = saved(mapped(_keyed(docs), _lines, LINES).withColumn("place", order_of()), "lines")
    keys = [f"k{k}" for k in range(4)]
    unique = lines.groupBy("line").agg(F.min("place").alias("first"), F.min("n").alias("n"), F.count("*").alias("held"), *[F.min(k).alias(k) for k in keys])
    # Numbers are given once, when the table is written. Minima of numbers aggregate by hash; those of binaries by sorting.
    unique = saved(unique.withColumn("id", F.monotonically_increasing_id()), "unique")
    halves = unique.select("id", F.explode(F.array(*keys)).alias("half")).where("half is not null")
    shared = halves.groupBy("half").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("held")).where("a <> b")
    shared = saved(shared.select("half", "held"), "shared")
    ids = saved(joined(halves, shared, "half", 4 * unique.count()).select("id").distinct(), "ids")
    wanted = saved(unique.select("id", "line", "first").join(small(ids), "id"), "wanted")
    texts = _texts(docs, wanted)
    rows = saved(mapped(texts, _variants, VARIANTS), "variants")
    dropped(shared, ids, wanted)
    joint = rows.groupBy("variant").agg(
        F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("held"),
        F.min(F.when(F.col("place") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("less"),
    ).where("a <> b").drop("a", "b")
    joint = saved(joint, "met")
    both = saved(joined(rows, joint, "variant", rows.count()), "joint")
    dropped(rows, joint)
    same = saved(both.where("place >= 0").groupBy("variant", "place").agg(F.min("first").alias("same"), F.count("*").alias("held")), "same")
    near = joined(both.where("place >= 0"), same, ["variant", "place"], both.count()).select("id", "first", F.least("whole", "same").alias("near"))
    near = near.unionByName(both.where("place < 0").select("id", "first", F.col("less").alias("near")))
    # Written first: a table whose size is known is sent to the texts, where these would be shuffled twice.
    near = saved(near.where("near < first").groupBy("id").agg(F.min("near").alias("near")), "found")
    pairs = texts.select("id", F.col("words").alias("one")).join(small(near), "id").join(texts.select(F.col("first").alias("near"), F.col("words").alias("other")), "near")
    found, near = near, saved(mapped(pairs.select("id", "near", "one", "other"), _verified, "id long, near decimal(38,0)"), "near")
    dropped(both, same, texts, found)
    return lines, unique, near


def _short(docs: DataFrame, unique: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines (id, first, n, tag) that can have a partner beyond one edit, and the texts of these and of some others.

    Of any d + 1 disjoint blocks of three words of a line, one is whole in every line within d edits of it. The longer line
    of n words has d at most n // 5; a line's longest partner has at most 5/4 of its words, so d is at most n // 4 as seen
    from the shorter one, and a line with more blocks than that which no other line holds has no partner. Of a line's words at most
    n // 5 are not in its partner, whichever is longer, as a longer one spends edits on its own words; so the
    same holds for words.
    """
    lines, texts = unique.select("id", "line", "first", "n", F.conv(F.hex(F.substring("line", 1, 4)), 16, 10).cast("long").alias("tag")), None
    blocks = f"n >= {LEAST_SIMILAR} and (n = {LEAST_SIMILAR} or n div 3 - shared <= n div 4)"
    for runs, few in [(grams, blocks)] * ROUNDS + [(single, f"n >= {LEAST_SIMILAR} and n - shared <= n div 5")]:
        parts = -(-(lines.where(f"n >= {LEAST_SIMILAR}").agg(F.sum("n")).first()[0] or 0) // PART) or 1
        dealt = mapped(_keyed(docs) if texts is None else texts, _dealt(parts, "text" if texts is None else "words", runs), "part int, kind int, data binary")
        shared = mapped(dealt.repartitionById(parts, "part"), _shared, "tag long, shared long").groupBy("tag").agg(F.sum("shared").alias("shared"))
        old, lines = (lines, texts), saved(lines.join(shared, "tag").where(few).select("id", "line", "first", "n", "tag"), "short_of_blocks")
        dropped(old[0])
        if runs is single:  # the last: it rules out few lines, whose texts the caller's join leaves out
            break
        texts = _texts(docs, lines.select("id", "line", "first")) if texts is None else saved(texts.join(lines.select("id"), "id", "left_semi"), "texts")
        dropped(*filter(None, old[1:]))
    return lines, texts


def _often(facts: DataFrame):
    """The keys that the most lines hold, in order, and by how many, sent to the tasks: at most MOST_OFTEN, as they only make a choice cheaper."""
    power = F.floor(F.log2("held"))
    least, many = 0, 0
    for p, n in sorted(facts.groupBy(power.alias("p")).count().collect(), reverse=True):
        if (many := many + n) > MOST_OFTEN:
            least = p + 1
            break
    rows = facts.where(power >= least).select("gram", "held").toArrow()
    keys, counts = rows.column("gram").to_numpy().view(np.uint64), rows.column("held").to_numpy()
    order = np.argsort(keys)
    return facts.sparkSession.sparkContext.broadcast((keys[order], counts[order]))


def _bits(rows: DataFrame):
    """A bit for each gram of ``rows``, 8 MB sent to the tasks. Others may share it: it only leaves out what no join would find."""
    words = rows.groupBy(F.expr(f"cast(shiftrightunsigned(gram, 6) % {1 << 20} as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(gram & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << 20, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


def _by_similarity(docs: DataFrame, unique: DataFrame, gone: DataFrame) -> DataFrame:
    """The lines (of ten words or more) that go, besides ``gone``, for an earlier one at most a fifth of the longer one's words away.

    Lines are compared if one holds, near its place, one of the words and runs chosen of the longer one (``_chosen``). First each with a
    few lines only: of the earliest holders of what it has chosen those that it shares most with, which is where most of a group of
    copies go. Then pairs are made for those lines alone that stay. So a group of copies costs as many comparisons as it has
    lines, and a passage or word that many lines hold costs none where their own words tell them apart.
    """
    lines, texts = _short(docs, unique)
    # Numbered in the order of their places, so that the least number is the earliest.
    numbered = saved(lines.select("id", "first").repartitionByRange("first").sortWithinPartitions("first").withColumn("at", F.monotonically_increasing_id()), "numbered")
    out = numbered.join(gone.select("id"), "id", "left_semi").selectExpr("at as id")
    texts_ = saved(texts.join(numbered.select("id", "at"), "id").select("at", "first", "words"), "texts")
    dropped(texts, lines)
    plain = texts_.select("at", "words")
    facts = saved(mapped(plain, _held, HELD).groupBy("gram").agg(F.sum("held").alias("held"), F.min("earliest").alias("earliest")).where("held > 1").select(*_names(HELD)), "holders")
    chosen = saved(mapped(plain, _chosen(_often(facts)), CHOSEN), "chosen")
    total, old = facts.agg(F.sum("held")).first()[0] or 0, facts
    facts = saved(mapped(old, _only(_bits(chosen)), HELD), "held")
    dropped(old)
    met = saved(joined(chosen, facts, "gram", total), "met")  # what no other line holds is left out
    dropped(chosen, facts)
    one, other = texts_.selectExpr("at as id", "first as one_first", "words as one"), texts_.selectExpr("at as other", "first as other_first", "words as two")

    def near(pairs: DataFrame) -> DataFrame:
        """Of pairs (id, other), the ids that are as near; lines of one place (rows that share a doc_id) are not before each other."""
        both = pairs.join(one, "id").join(other, "other").where("other_first < one_first").select("id", "one", "two")
        return saved(mapped(both, _similar, "id long").distinct(), "similar")

    found, keep = [], saved(numbered.selectExpr("at as id").join(out, "id", "left_anti"), "keep")
    for to in (["gram"], ["gram", "na"]):  # the earliest holder of what is chosen, then the earliest line as long that has chosen it too
        star = met.join(small(keep.withColumnRenamed("id", "a")), "a", "left_semi")
        if "na" in to:
            star = star.drop("earliest").join(met.groupBy(*to).agg(F.min("a").alias("earliest"), F.count("*").alias("held")).where("held > 1"), to)
        star = star.where("earliest < a").groupBy(F.col("a").alias("id"), "earliest").agg(F.count("*").alias("n"))
        best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "earliest"))
        star = saved(star.withColumn("turn", best).where(F.col("turn") <= FIRST).select("id", F.col("earliest").alias("other")), "star")
        found.append(near(star))
        old, keep = keep, saved(keep.join(small(found[-1]), "id", "left_anti"), "keep")
        dropped(star, old)
    stays = keep.select("id", F.lit(True).alias("stays"))
    a = saved(met.join(small(stays.withColumnRenamed("id", "a")), "a", "left").withColumnRenamed("stays", "a_stays").drop("earliest"), "rarest")
    b = mapped(plain, _marked(_bits(a)), MARKS).join(small(stays.withColumnRenamed("id", "b")), "b", "left").withColumnRenamed("stays", "b_stays")
    alike = "nb <= na and nb >= na - na div 5 and least <= high and most >= low and nb - most <= left_high and nb - least >= left_low"
    alike += " and bit_count(a0 ^ b0) + bit_count(a1 ^ b1) <= 2 * (na div 5) - (na - nb)"
    pairs = b.join(small(a), "gram").where(f"{alike} and (b < a and a_stays or a < b and b_stays)")
    # Written first: what was shuffled for them is gone when their texts are.
    pairs = saved(pairs.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("other")).distinct(), "pairs")
    found.append(near(pairs))
    dropped(pairs, met)
    out = saved(functools.reduce(DataFrame.union, found).withColumnRenamed("id", "at").join(numbered.select("id", "at"), "at").select("id").distinct(), "gone")
    dropped(a, keep, texts_, numbered, *found)
    return out


def _kept(unique: DataFrame, near: DataFrame) -> DataFrame:
    """(line, first, held, near) of the lines that have a row to lose: a line of one row goes only for one near it."""
    return unique.select("id", "line", "first", "held").join(small(near), "id", "left").drop("id").where("held > 1 or near is not null")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """One row for each line that goes: (doc_id, text_key, line_no, kept_doc_id, kept_line_no, edits).

    A document's lines are numbered from 0, parted by line feeds. A line goes if a line before it, in the order of doc_id
    and number, equals it, or, where both have five words or more, is within one word of it; kept_... names the earliest
    such line (which may itself go for one earlier still), edits is 0 if that one is equal and 1 if not. Lines without a
    word stay. Rows with the same doc_id share their order, so repeated rows don't displace each other. Null doc_ids come
    last; null and empty texts have no lines; a very long line is a line like any other.
    """
    lines, unique, near = _by_one_edit(docs)
    kept = saved(_kept(unique, near), "kept")
    gone = joined(lines, kept, "line", lines.count()).where("place > first or near is not null")
    gone = gone.withColumn("best", F.least("first", "near"))
    doc, line_no = place_of("best")
    return gone.select(
        "doc_id", "text_key", "line_no", F.when(doc < (1 << 63) - 1, doc).alias("kept_doc_id"),
        line_no.alias("kept_line_no"), F.when(F.coalesce(F.col("near") < F.col("first"), F.lit(False)), 1).otherwise(0).alias("edits"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns as they were but for ``text``, which loses its repeated lines (and n_chars, if there
    is one, which follows): those equal to an earlier one, at any length, and those of five words or more within floor(0.2 x
    words of the longer one) word edits of an earlier one. A document of which nothing but white space would be left goes; one that lost no line
    stays as it is. Rows that repeat a doc_id and text are treated alike. Null and empty texts stay; so does an empty table."""
    lines, unique, near = _by_one_edit(docs)
    similar = near.select("id").union(_by_similarity(docs, unique, near)).select("id", F.lit(True).alias("similar"))
    marked = unique.select("id", "line", "first", "held").join(small(similar), "id", "left").drop("id").where("held > 1 or similar")
    marked = saved(marked, "marked")
    gone = joined(lines, marked, "line", lines.count()).where("place > first or similar").groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("lines"))
    key_, id_, lines_, left_ = (fresh(docs, c) for c in ("text_key", "line_doc", "lines_gone", "text_left"))
    out = docs.withColumns({key_: F.xxhash64(F.col("text").cast("string")), id_: F.col("doc_id").cast("long")})
    out = out.alias("d").join(gone.alias("g"), F.col(f"d.{id_}").eqNullSafe(F.col("g.doc_id")) & (F.col(f"d.{key_}") == F.col("g.text_key")), "left").select("d.*", F.col("g.lines").alias(lines_))
    # Parted once, as a variable; what stays is found by hash, so that a text of very many lines is gone through once.
    kept = lambda c: F.transform(F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col(lines_)), lambda k: F.get(c, k))
    left = F.array_join(F.transform(F.array(F.split(F.col("text"), "\n", -1)), kept)[0], "\n")
    whole = F.col(lines_).isNull()
    out = out.withColumn(left_, F.when(whole, F.col("text")).otherwise(left)).where(whole | F.col(left_).rlike(r"\S"))
    made = {"text": F.col(left_)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.length(left_).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])

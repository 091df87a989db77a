"""Token counts by compiled finite-state transducers over a byte-level BPE vocabulary.

Two machines are compiled from the vocabulary file, state by state as they are first needed:

* ``PieceTransducer`` reads the bytes of one pre-token. A token sequence is what BPE yields exactly if each two
  neighbouring tokens stay as they are when BPE is run on the two alone; so the machine follows, for every place where
  the last token may have begun, the one valid sequence up to there. Those hypotheses are determinised into states whose
  transitions carry the number of tokens that is certain by then; what differs stays in the state.
* Chunks of a text are summarised by ``ChunkMap``: what the chunk adds for any state it may be entered in. A place where
  white space follows other text always parts two pre-tokens, whatever comes before or after, so every state is the same
  there and the map needs only the text before its first such place, the count between, and the text after its last.
  ``compose`` is associative, so maps are composed in any bracketing: those of a very long text's chunks are rows, made in
  different tasks and composed by a scan in two levels, of runs of ``RUN`` chunks and of what these give.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._bpe import Vocabulary
from docloom.llm._common import id_and_text, mapped

LIMIT = 512
#: Characters of a chunk, and the most states and words that a worker keeps compiled before it starts afresh.
CHUNK, MOST_STATES, MOST_WORDS = 65_536, 250_000, 500_000
#: Bytes from which a text's chunks are dealt out, and chunks of a run: two levels hold more than a text can have.
SPREAD, RUN = 1 << 20, 256

_PRETOKEN = regex.compile(public_tokenizers.PATTERN)
_PARTED = regex.compile(r"(?<=\S)(?=\s)")
#: White space other than the space and the line break.
_ODD = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]


def even(text: str) -> bool:
    """Whether a text is words parted by one space or one line break each, and nothing else."""
    return len(text.split()) == text.count(" ") + text.count("\n") + 1 and not any(c in text for c in _ODD)


class PieceTransducer(Vocabulary):
    """Deterministic transducer over bytes; a state is a tuple of hypotheses (last whole token, trie node, tokens ahead)."""

    def __init__(self, path: str):
        super().__init__(path)
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[int, ...]] = [(self.packed(-1, 0, 0),)]
        self.number: dict[tuple[int, ...], int] = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}  # state << 8 | byte: (state, tokens)
        self.ends: dict[int, int] = {}

    @staticmethod
    def packed(last: int, node: int, ahead: int) -> int:
        """A hypothesis as one number; ``ahead`` lies between -512 and 511, for tokens have at most 128 bytes."""
        return (last + 1) << 40 | node << 10 | ahead + 512

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compile one transition: (state, tokens). Hypotheses stand in the order of where their last token begins; a
        state's counts are relative to its first, so the transition carries by how much that one's count has moved."""
        after, child, word = [], self.child, self.word
        new = 0
        for h in self.states[state]:
            last, node, ahead = (h >> 40) - 1, h >> 10 & 0x3FFFFFFF, (h & 1023) - 512
            to = child.get(node << 8 | byte)
            if to is not None:
                after.append((last, to, ahead))
            w = word[node]
            if w >= 0 and self.neighbours(last, w):
                new = (w, child[byte], ahead + 1)
        if new:
            after.append(new)
        base = after[0][2]
        key = tuple([(last + 1) << 40 | node << 10 | ahead - base + 512 for last, node, ahead in after])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = to, base
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state = n = 0
        moves = self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte) or self.step(state, byte)
            state = move[0]
            n += move[1]
        end = self.ends.get(state)
        if end is None:
            for h in self.states[state]:
                w = self.word[h >> 10 & 0x3FFFFFFF]
                if w >= 0 and self.neighbours((h >> 40) - 1, w):
                    end = self.ends[state] = (h & 1023) - 511
        return n + end


class Words(dict):
    """Transitions over whole words, compiled at first use: the tokens of a string from one certain parting to the next."""

    def __init__(self, piece: PieceTransducer, before: str = ""):
        self.piece, self.before = piece, before

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        core = word[:-1]
        if word[-1:] in (".", ",") and core.isalpha():
            n = self[core] + 1
        else:
            whole = self.before + word
            n = sum(self.piece.count(x.encode()) for x in ((whole,) if word.isalpha() else _PRETOKEN.findall(whole)))
        if len(word) < 64:
            self[word] = n
        return n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk adds: ``head`` joins what was pending before it, ``count`` is certain, ``tail`` is pending after it."""

    head: str
    count: int
    tail: str | None  # None: no certain parting within, and all of the chunk is in head


class TokenCounter:
    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.piece = PieceTransducer(public_tokenizers.path(name))
        self.words, self.spaced = Words(self.piece), Words(self.piece, " ")
        self.specials = regex.compile("|".join(map(regex.escape, self.piece.special))) if self.piece.special else None

    def chunk_map(self, text: str) -> ChunkMap:
        if even(text):
            first = min(k for k in (text.find(" "), text.find("\n"), len(text)) if k >= 0)
            last = max(text.rfind(" "), text.rfind("\n"))
            return ChunkMap(text[:first], self.regular(text[first:last]), text[last:]) if last >= 0 else ChunkMap(text, 0, None)
        cuts = [m.start() for m in _PARTED.finditer(text)]
        if not cuts:
            return ChunkMap(text, 0, None)
        return ChunkMap(text[: cuts[0]], self.between(text[cuts[0] : cuts[-1]]), text[cuts[-1] :])

    def between(self, text: str) -> int:
        """Tokens of a text that starts and ends at certain partings."""
        return sum(map(self.words.__getitem__, _PARTED.split(text))) if text else 0

    def regular(self, text: str) -> int:
        """The same where words are parted by one space or one line break each."""
        words, spaced, n = self.words, self.spaced.__getitem__, 0
        lines = text.split("\n")
        for line in lines:
            first, *rest = line.split(" ")
            n += words[first] + sum(map(spaced, rest))
        return n + (len(lines) - 1) * words["\n"]

    def joined(self, a: str, b: str) -> ChunkMap:
        """The map of a pending text, which may have a parting where the two meet."""
        if a and b and not a[-1].isspace() and b[0].isspace():
            return ChunkMap(a, 0, b)
        return ChunkMap(a + b, 0, None)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None and b.tail is None:
            return self.joined(a.head, b.head)
        if a.tail is None:
            mid = self.joined(a.head, b.head)
            return ChunkMap(mid.head, b.count + (self.words[mid.tail] if mid.tail is not None else 0), b.tail)
        mid = self.joined(a.tail, b.head)
        if b.tail is None:
            return ChunkMap(a.head, a.count, mid.head) if mid.tail is None else ChunkMap(a.head, a.count + self.words[mid.head], mid.tail)
        return ChunkMap(a.head, a.count + b.count + self.words[mid.head] + (self.words[mid.tail] if mid.tail is not None else 0), b.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Compose neighbours in rounds of halving length; any bracketing gives the same map."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def finished(self, m: ChunkMap) -> int:
        """The tokens of a map's text where nothing comes before or after it."""
        return m.count + self.words[m.head] + (self.words[m.tail] if m.tail is not None else 0)

    def parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is it a special string, text): chunks, and the special strings that part them."""
        at = 0
        for m in [*(self.specials.finditer(text) if self.specials else ()), None]:
            end = m.start() if m else len(text)
            yield from ((False, text[k : min(end, k + CHUNK)]) for k in range(at, end, CHUNK))
            if m:
                yield True, m[0]
                at = m.end()

    def map_of(self, special: bool, text: str) -> ChunkMap:
        """A special string is one token and ends what is pending before it."""
        return ChunkMap("", 1, "") if special else self.chunk_map(text)

    def count(self, text: str) -> int:
        maps = [self.map_of(*p) for p in self.parts(text)]
        return self.finished(self.scan(maps)) if maps else 0


@functools.cache
def compiled(name: str) -> TokenCounter:
    """Compiled once in each Python worker and kept from task to task."""
    return TokenCounter(name)


def _counts(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


CHUNKS = "row long, doc_id long, n_bytes long, no int, special boolean, text string"
MAPS = "row long, doc_id long, n_bytes long, no int, head string, count long, tail string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], [n for n, _ in names])


def _cut(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(name)
        for batch in batches:
            for row, doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = []
                for no, part in enumerate(counter.parts(data.decode("utf-8", "replace"))):
                    held.append((row, doc, len(data), no, *part))
                    if len(held) >= 64:
                        yield _batch(held, CHUNKS)
                        held = []
                yield _batch(held, CHUNKS)

    return run


def _maps(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(name)
        for batch in batches:
            rows = []
            for row, doc, size, no, special, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = counter.map_of(special, text)
                rows.append((row, doc, size, no, m.head, m.count, m.tail))
            yield _batch(rows, MAPS)

    return run


def _folded(name: str):
    """Compose neighbouring maps of one run: a stream sorted by (row, run, no), of which one map is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, at, held = compiled(name), None, None
        for batch in batches:
            done = []
            for row, doc, size, no, head, count, tail, run_no in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = ChunkMap(head, count, tail)
                if at is not None and at[0] == row and at[3] == run_no:
                    held = counter.compose(held, m)
                    continue
                if at is not None:
                    done.append((*at, held.head, held.count, held.tail))
                at, held = (row, doc, size, run_no), m
            yield _batch(done, MAPS)
        if at is not None:
            yield _batch([(*at, held.head, held.count, held.tail)], MAPS)

    return run


def _finished(name: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(name)
        for batch in batches:
            rows = [(doc, size, n := counter.finished(ChunkMap(head, count, tail)), n > limit) for _, doc, size, _, head, count, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(rows, COUNTS)

    return run


COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_tokens, over_limit). Null and empty texts count zero.

    A text is counted where it is read, but for texts of more than ``SPREAD`` bytes, whose chunks are dealt out to all
    tasks. Repeated rows and null doc_ids come out as they went in; an empty table gives an empty result. Bytes that aren't
    UTF-8 count as U+FFFD.
    """
    rows = id_and_text(docs)
    long = F.coalesce(F.octet_length("text") > SPREAD, F.lit(False))
    short = mapped(rows.where(~long), _counts(vocabulary, limit), COUNTS)
    chunks = mapped(rows.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), _cut(vocabulary), CHUNKS, 4)
    maps = mapped(chunks.repartition("row", "no"), _maps(vocabulary), MAPS)
    for run in (F.floor(F.col("no") / RUN).cast("int"), F.lit(0)):
        maps = maps.withColumn("run", run).repartition("row", "run").sortWithinPartitions("row", "run", "no")
        maps = mapped(maps, _folded(vocabulary), MAPS)
    return short.unionByName(mapped(maps, _finished(vocabulary, limit), COUNTS))

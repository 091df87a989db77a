"""Encoding and decoding with a SentencePiece BPE model, from a table of each prefix's last token.

Merging in the order of the pieces' scores gives every text one token sequence, and a sequence is that of its text exactly if
each two neighbouring tokens stay as they are when merged alone: up to the first merge across a border, all merges lie
within tokens, so that merge would be made for the two alone as well. Hence each prefix of a text has one last token: of
the pieces that an automaton finds to end there, the one that may follow the last token of the prefix before it. The table
of these is filled from left to right, and the ids are read off it backwards.

No piece has a space mark behind another character, and some characters (the line break) are in no piece of several: texts
part there for certain, so each worker keeps what it has found for words.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from array import array
from collections.abc import Iterator

import ahocorasick
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import fresh, id_and_text, mapped

MARK = "▁"
#: Words and pairs that a worker keeps before it starts afresh, and the longest word that is kept.
MOST_WORDS, MOST_PAIRS, LONGEST_KEPT = 120_000, 500_000, 48
#: The longest text whose table is a list.
LONGEST_LIST = 4096
_PARTS = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PrefixTable:
    """Tokens are numbered as in the model; a character that is no piece is the token -1 - its code point."""

    def __init__(self, name: str = "piece_bpe_32k.model"):
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.silent = {k for k in range(model.get_piece_size()) if model.is_control(k)}
        self.bytes = {k: int(model.id_to_piece(k)[1:-1], 16) for k in range(model.get_piece_size()) if model.is_byte(k)}
        self.of_byte = {b: k for k, b in self.bytes.items()}
        self.piece = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.written = ["" if k in self.silent else " ⁇ " if k == self.unknown else p.replace(MARK, " ") for k, p in enumerate(self.piece)]
        self.last_byte, self.numeral = max(self.bytes, default=-1), list(map(str, range(len(self.piece))))
        plain = [k for k in range(len(self.piece)) if not (k in self.silent or k in self.bytes or model.is_unknown(k))]
        self.score = {self.piece[k]: model.get_score(k) for k in plain}
        self.spine: dict[int, list[tuple[float, str, str]]] = {}
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for k in plain:
            if len(self.piece[k]) == 1 or self.merges(self.piece[k])[1] == 1:  # others are never what merging gives
                self.automaton.add_word(self.piece[k], (k, len(self.piece[k])))
        self.automaton.make_automaton()
        several = [self.piece[k] for k in plain if len(self.piece[k]) > 1]
        self.by_space = not any(MARK in p.lstrip(MARK) for p in several)
        self.by_line = not any("\n" in p for p in several)
        self.inner = {p[k : k + 2] for p in several for k in range(len(p) - 1)}  # neighbours within pieces
        self.spaced, self.bare = Words(self, MARK), Words(self, "")

    def text_of(self, token: int) -> str:
        return self.piece[token] if token >= 0 else chr(-1 - token)

    def merges(self, text: str) -> tuple[list[tuple[float, str, str]], int]:
        """Best pair first, leftmost of equals: (score of the merge, first symbol, last symbol) at each step, then symbols left."""
        parts, steps = list(text), []
        while True:
            best = max(((self.score.get(a + b, -1e30), -k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(-1e30, 0))
            if best[0] <= -1e30:
                return [*steps, (-1e30, parts[0], parts[-1])], len(parts)
            k = -best[1]
            steps.append((best[0], parts[0], parts[-1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def steps(self, token: int) -> list[tuple[float, str, str]]:
        """By step of the token's own merging: the next merge's score (-1e30 when done), and the first and last symbol before it."""
        found = self.spine.get(token)
        if found is None:
            found = self.spine[token] = self.merges(self.text_of(token))[0]
        return found

    def may_follow(self, x: int, y: int) -> bool:
        """Whether x and y stay two tokens: run both merges side by side; none across the border may come first."""
        key = (x << 16) + y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
                self.spine.clear()
            known = self.pairs[key] = self._apart(self.steps(x), self.steps(y))
        return known

    def _apart(self, left: list[tuple[float, str, str]], right: list[tuple[float, str, str]]) -> bool:
        i = j = 0
        while True:
            a, _, last = left[i]
            b, first, _ = right[j]
            across = self.score.get(last + first)
            if across is not None and across > a and across >= b:  # of equal scores the leftmost goes first
                return False
            if a <= -1e30 and b <= -1e30:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def tokens(self, text: str) -> list[int]:
        """Fill the table of last tokens from left to right, then follow it backwards."""
        # A list is read faster than an array, but takes more memory.
        last, size = [0] * len(text) if len(text) <= LONGEST_LIST else array("q", bytes(8 * len(text))), bytearray(len(text))
        pairs, done = self.pairs, -1  # every place up to ``done`` is filled
        for end, (token, n) in self.automaton.iter(text):
            if size[end]:
                continue
            if done < end - 1:  # characters that no piece ends with
                self._unknown(text, last, size, done + 1, end)
            at = end - n
            if at < 0 or (known := pairs.get((last[at] << 16) + token)) or known is None and self.may_follow(last[at], token):
                last[end], size[end] = token, n
                done = end
        if done < len(text) - 1:
            self._unknown(text, last, size, done + 1, len(text))
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    @staticmethod
    def _unknown(text: str, last: array | list[int], size: bytearray, start: int, end: int) -> None:
        for k in range(start, end):
            if not size[k]:
                last[k], size[k] = -1 - ord(text[k]), 1

    def ids(self, text: str) -> list[int]:
        """The ids of a text whose spaces are marks already; characters that are no piece are written as bytes."""
        out = []
        for t in self.tokens(text):
            if t >= 0:
                out.append(t)
            elif self.of_byte:
                out.extend(self.of_byte[b] for b in chr(-1 - t).encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def surface(self, ids: list[int]) -> str:
        """What ids stand for; runs of bytes are read as UTF-8, each byte that doesn't fit as U+FFFD."""
        if not ids or min(ids) > self.last_byte:
            return "".join(map(self.written.__getitem__, ids))
        out, held = [], bytearray()
        for k in ids:
            if k in self.bytes:
                held.append(self.bytes[k])
                continue
            if held:
                out.append(_read(bytes(held)))
                held.clear()
            out.append(self.written[k])
        return "".join(out) + _read(bytes(held))

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id included."""
        return [*(int(x) for line in self.parts(text) for part, _ in line for x in part.split()), self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts before it."""
        lead = next((k for k, x in enumerate(ids) if x not in self.silent), len(ids))
        text = self.surface(ids)
        return text[1:] if lead < len(ids) and ids[lead] not in self.bytes and self.piece[ids[lead]].startswith(MARK) else text

    def parts(self, text: str) -> Iterator[list[tuple[str, str]]]:
        """A text's (ids, surface) by word, for each line, where it parts for certain."""
        if not text:
            return
        even = self.by_space and MARK not in text and "  " not in text and text[0] != " "
        spaced, bare = self.spaced.__getitem__, self.bare
        for k, line in enumerate(text.split("\n") if self.by_line else [text]):
            found = [bare["\n"]] if k else []
            if even:
                first, *rest = line.split(" ")
                if first:
                    found.append(bare[first] if k else spaced(first))
                found += map(spaced, rest)
            else:
                marked = ("" if k else MARK) + line.replace(" ", MARK)
                found += map(bare.__getitem__, _PARTS.findall(marked) if self.by_space else [marked] if marked else [])
            if not k and not found:  # the mark alone, before a line break
                found = [bare[MARK]]
            yield found

    def digests(self, text: str) -> tuple[int, str, str]:
        """(all ids, hash of the ids, hash of the text that they decode to). No list of all ids is made."""
        n, ids, back, lead, block = 0, hashlib.sha256(), hashlib.sha256(), 1, []
        for found in itertools.chain(self.parts(text), [None]):
            block += found or ()
            if block and (found is None or len(block) >= 4096):
                written = " ".join([a for a, _ in block]) + " "
                n += written.count(" ")
                ids.update(written.encode())
                back.update("".join([b for _, b in block])[lead:].encode())  # the first id begins with the mark put before a text
                lead, block = 0, []
        ids.update(str(self.end).encode())
        return n + 1, ids.hexdigest(), back.hexdigest()


class Words(dict):
    """(ids parted by spaces, surface) of words behind a fixed prefix, found at first use. When full, the words become the older half;
    of these, those that are used again come along."""

    def __init__(self, table: PrefixTable, before: str):
        self.table, self.before, self.older = table, before, {}

    def __missing__(self, word: str) -> tuple[str, str]:
        out = self.older.get(word) or self.found(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def found(self, word: str) -> tuple[str, str]:
        if 1 < len(word) <= LONGEST_KEPT and word[-2:] not in self.table.inner:  # a certain parting before the last character
            (a, x), (b, y) = self[word[:-1]], self.table.bare[word[-1]]
            return f"{a} {b}", x + y
        ids = self.table.ids(self.before + word)
        return " ".join(map(self.table.numeral.__getitem__, ids)), self.table.surface(ids)


def _read(data: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that fits nowhere."""
    out = []
    while data:
        try:
            return "".join(out) + data.decode()
        except UnicodeDecodeError as e:
            out.append(data[: e.start].decode() + "�")
            data = data[e.start + 1 :]
    return "".join(out)


@functools.cache
def compiled(name: str) -> PrefixTable:
    """Built once in each Python worker and kept from task to task."""
    return PrefixTable(name)


def round_trip(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_tokens, ids_sha256, decoded_sha256), with an end id.

    Null and empty texts are an end id alone. Texts are encoded whole where they are read, without a shuffle; a very long one
    without spaces needs some nine bytes a character for its table. Repeated rows and null doc_ids come out as they went in; other columns,
    whatever their names, are not read. An empty table gives an empty result. Bytes that aren't UTF-8 count as U+FFFD.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = compiled(model)
        for batch in batches:
            found = [table.digests(t.as_py().decode("utf-8", "replace") if t.is_valid else "") for t in batch.column(1)]
            n, ids, back = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], [c.split()[0] for c in DIGESTS.split(", ")])

    return mapped(id_and_text(docs), run, DIGESTS)


def _column(df: DataFrame, name: str, kind: str, f, of: Column, model: str) -> DataFrame:
    """``df`` with a column more, made of ``of`` in Arrow batches."""
    given = fresh(df, "_given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = compiled(model)
        for batch in batches:
            made = pa.array([None if x is None else f(table, x) for x in batch.column(batch.num_columns - 1).to_pylist()], pa.list_(pa.int32()) if kind == "array<int>" else pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], name])

    return mapped(df.withColumn(given, of), run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` {kind}")


def encoded(df: DataFrame, model: str = "piece_bpe_32k.model", name: str = "ids") -> DataFrame:
    """``df`` with the ids of its column text, the end id included; a null text has null ids."""
    return _column(df, fresh(df, name), "array<int>", PrefixTable.encode, F.col("text").cast("string"), model)


def decoded(df: DataFrame, ids: str = "ids", model: str = "piece_bpe_32k.model", name: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of ids; null ids have a null text."""
    return _column(df, fresh(df, name), "string", PrefixTable.decode, F.col(ids), model)

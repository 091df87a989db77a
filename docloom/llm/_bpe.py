"""Byte-level pair vocabularies: their merges, their trie, and which tokens may stand side by side."""

from __future__ import annotations

import json


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest follow U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens numbered in the order of their merges, after the 256 bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_letters()
        self.special = [x["content"] for x in spec["added_tokens"]]
        number = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        for a, b in spec["model"]["merges"]:
            a, b = bytes(of[c] for c in a), bytes(of[c] for c in b)
            pair = number[a], number[b]
            self.merge[pair] = len(self.parts)
            number.setdefault(a + b, len(self.parts))
            self.parts.append(pair)
        self.child: dict[int, int] = {}  # node << 8 | byte: node
        self.word: list[int] = [-1]  # by node
        for x, k in number.items():
            node = 0
            for c in x:
                if (to := self.child.get(node << 8 | c)) is None:
                    to = self.child[node << 8 | c] = len(self.word)
                    self.word.append(-1)
                node = to
            self.word[node] = k

    def neighbours(self, x: int, y: int) -> bool:
        """Whether BPE leaves two tokens apart: undo their merges from the last to the first; none across may come earlier."""
        if x < 0:
            return True
        merge, parts, limit = self.merge, self.parts, 1 << 60
        while True:
            k = merge.get((x, y))
            if k is not None and k < limit:
                return False
            if x < 256 and y < 256:
                return True
            if x > y:
                limit, x = x, parts[x][1]
            else:
                limit, y = y + 1, parts[y][0]

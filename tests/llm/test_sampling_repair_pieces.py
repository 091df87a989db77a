"""Importance resampling, conversation repair and piece encoding against plain versions of their definitions."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import sentencepiece

from docloom.llm import conversations, importance, pieces

DOCS = "doc_id long, text string, rank int, score string"
VOCAB = [f"word{k}" for k in range(60)] + ["Éa", "x1", "漢字"]


def documents():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 70))) for _ in range(120)]
    texts += [None, "", " \n.", "A_b-c  D", "long " * 50_000, texts[0], texts[0]]
    return [(k, t, 1, "x") for k, t in enumerate(texts)] + [(0, texts[0], 1, "x"), (None, texts[1], 1, "x"), (None, texts[1], 1, "x")]


def resampled(docs, target, percent, longest):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        return len(w), [" ".join(w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text, *_ in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out, fit = [], []
    for k, (doc, text, *_) in enumerate(docs):
        n_words, f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(f), weight, score, None])
        if n_words >= 20:
            fit.append((-score, math.inf if doc is None else doc, k))
    for rank, (_, _, k) in enumerate(sorted(fit)[: len(fit) * percent // 100], 1):
        out[k][4] = rank
    return sorted(map(str, map(tuple, out)))


def test_resampling(spark):
    docs, target = documents(), [" ".join(VOCAB[:9]), None, "", "word1 word2"]
    df, aim = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for percent, longest in ((10, 1), (60, 2)):
        got = sorted(str(tuple(r)) for r in importance.resample(df, aim, percent=percent, longest=longest).collect())
        assert got == resampled(docs, target, percent, longest)
    assert importance.resample(df.limit(0), aim).count() == 0
    assert {r["rank"] for r in importance.resample(df.where("doc_id < 5"), aim.limit(0)).collect()} == {None}


def test_blocks_end_early(spark, monkeypatch):
    docs, aim = documents(), spark.createDataFrame([("word1",)], "text string")
    monkeypatch.setattr(importance, "ARROW_ROWS", 3)
    got = sorted(str(tuple(r)) for r in importance.resample(spark.createDataFrame(docs, DOCS), aim).collect())
    assert got == resampled(docs, ["word1"], 10, 1)


def plainly(rows, damage=True):
    """Cheapest edits of one conversation by dynamic programming over whole (cost, audit) pairs."""
    hurt = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            hurt += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    hurt.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in hurt:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    best = {(len(hurt), "", 0): (0, "", ()), (len(hurt), "a", 0): (0, "", ())}
    for k in range(len(hurt), -1, -1):
        for inserts in (2, 1, 0):
            for state in ("", "s", "u", "a"):
                ways = [best[k, state, inserts]] if (k, state, inserts) in best else []
                if inserts == 0 and k == len(hurt) and state in ("s", "u"):
                    lines = ("user:", "assistant:") if state == "s" else ("assistant:",)
                    ways.append((3 * len(lines), "I" * len(lines), lines))
                forced = "a" if state == "u" else "u"
                name = {"u": "user", "a": "assistant"}[forced]
                if k < len(hurt):
                    _, role, text = hurt[k]
                    ways.append((4 + best[k + 1, state, 0][0], "D" + best[k + 1, state, 0][1], best[k + 1, state, 0][2]))
                    if faults[k] not in ("blank", "duplicate"):
                        more = 3 * (faults[k] == "truncated")
                        if (to := after[state].get(role[:1])) is not None:
                            c, a, w = best[k + 1, to, 0]
                            ways.append((c + more, "K" + a, (f"{role}:{text}", *w)))
                        c, a, w = best[k + 1, forced, 0]
                        ways.append((c + more + 3, "R" + a, (f"{name}:{text}", *w)))
                    if inserts < 2:
                        c, a, w = best[k, forced, inserts + 1]
                        ways.append((c + 3, "I" + a, (f"{name}:", *w)))
                if ways:
                    best[k, state, inserts] = min(ways, key=lambda x: x[:2])
    cost, audit, lines = best[0, "", 0]
    turns = [t for t, *_ in hurt if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(hurt, hurt[1:])]
    count = functools.partial(faults.count)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talk():
    rng = random.Random(5)
    says = ["Hello.", "Fine?", "no end", "", " \t", None, "é!", "Well. \n", "a.\nb"]
    rows = [(k // 7, k % 7, "user" if k % 2 else "assistant", rng.choice(says)) for k in range(420)]
    rows += [(100 + k, t, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(says)) for k in range(120) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", "x.") for t in range(4)] + [(300, None, "user", "u."), (300, None, "user", "u."), (300, 3, "assistant", "ok."), (300, 3, "system", "ok.")]
    rows += [(301, t, rng.choice(["user", "assistant", "system"]), rng.choice(says) if t % 3 else f"turn {t}.") for t in range(700)] + [(302, 5, "user", "far " * 40_000)]
    rows += [(303, 7, "user", "same.")] * 300
    rng.shuffle(rows)
    return rows


def test_conversations(spark):
    rows = talk()
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for damage, bits in ((True, 3), (False, conversations.BLOCK_BITS)):
        want = sorted(str((c, *plainly(x, damage))) for c, x in by.items())
        assert sorted(str(tuple(r)) for r in conversations.repaired(df, damage, bits).collect()) == want
    assert conversations.repaired(df.limit(0)).count() == 0


def test_solved_signatures_are_cheapest():
    rng, solver = random.Random(2), conversations.Solver()
    rows = {"s": ("system", "."), "u": ("user", "."), "a": ("assistant", "."), "o": ("tool", "."), "x": ("user", "")}
    for _ in range(400):
        sig = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randint(0, 12)))
        given = [(1, k, rows[c.lower()][0], f"{k}{rows[c.lower()][1] if c.islower() else ''}" if c != "x" else "") for k, c in enumerate(sig)]
        cost, audit = plainly(given, False)[5:7]
        assert solver.left(sig, 0, conversations.AT_END) == cost
        done = solver.audit(sig, 0, conversations.AT_END)
        assert audit.rstrip("I") == done.rstrip("I") and audit.startswith(done)


def test_pieces(spark):
    table = pieces.compiled("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    parts = ["a", " the", "  ", "\n", "\n\n", "\t", "don't", "12", "漢字", "<s>", "</s>", "<0x0A>", "...", "x" * 40, "\r\n", "▁", " ▁▁", "𝔘", "\x00", "river", " Über", "aaaa", " " * 37, "lo", "他们"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz▁"[: rng.choice([2, 3, 5, 27])]) for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += [None, "", " ", "\n", "\n a", "word. " * 20_000, "".join(rng.choice("abcdeéf漢") for _ in range(60_000))]
    for t in texts:
        ids = lib.encode(t or "", add_eos=True)
        assert table.encode(t or "") == ids and table.decode(ids) == lib.decode(ids), t
        some = [rng.choice([rng.randrange(32_000), rng.randrange(259), 28705]) for _ in range(6)]
        assert table.decode(some) == lib.decode(some)
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "a b", "x"), (0, texts[0], "x")]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for k, t, _ in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append(str((k, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))))
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    assert sorted(str(tuple(r)) for r in pieces.round_trip(df).collect()) == sorted(want)
    assert pieces.round_trip(df.limit(0)).count() == 0
    back = pieces.decoded(pieces.encoded(df), "ids_").select("text", "decoded").collect()
    assert all(r.decoded == (None if r.text is None else lib.decode(lib.encode(r.text))) for r in back) and len(back) == len(rows)


def test_full_words_caches(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_WORDS", 5)
    monkeypatch.setattr(pieces, "MOST_PAIRS", 7)
    table = pieces.PrefixTable()
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join("".join(rng.choice("etaoin.") for _ in range(rng.randint(1, 7))) for _ in range(12))
        assert table.encode(t) == lib.encode(t, add_eos=True)

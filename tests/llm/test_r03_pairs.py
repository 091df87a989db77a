import itertools
import random

import numpy as np

from docloom.llm import linededup


def test_a_passage_that_many_lines_hold_makes_no_pairs(spark, monkeypatch):
    """Lines of one long passage and words of their own, too many of these to be near any other."""
    sizes, plain = [], linededup.saved

    def saved(df, name):
        out = plain(df, name)
        if name == "pairs":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(linededup, "saved", saved)
    passage = " ".join(f"p{k}" for k in range(42))
    rng, pool = random.Random(2), [f"w{k}x" for k in range(400)]  # so that each of the own words is in some other lines
    lines = [" ".join([*rng.sample(pool, 24), passage]) for _ in range(60)]
    assert linededup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).count() == 60
    assert sum(sizes) <= 300  # of 1,770
    near = [*lines, lines[7].replace(lines[7].split()[3] + " ", "").replace("p9 ", "other "), "a b c d e f g h i j " + lines[9]]
    got = {r.doc_id for r in linededup.deduplicated(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).collect()}
    assert got == set(range(60))


def test_what_is_chosen_costs_least():
    rng = np.random.default_rng(3)
    n, m = np.array([9, 12, 7, 12]), np.array([3, 4, 2, 1])
    word, run = (np.full((4, 12), 1 << 40, np.int64) for _ in range(2))
    for k in range(4):
        word[k, : n[k]], run[k, : n[k] - 2] = rng.integers(1, 30, n[k]), rng.integers(1, 30, n[k] - 2)
    got = [[] for _ in n]
    for row, turn, at, is_run in linededup.disjoint(word, run, n, m):
        for x in zip(row.tolist(), turn.tolist(), at.tolist(), is_run.tolist(), strict=True):
            got[x[0]].append(x[1:])
    for k, own in enumerate(got):
        own.sort()
        assert [t for t, _, _ in own] == list(range(m[k]))
        assert all(p + (3 if r else 1) <= q for (_, p, r), (_, q, _) in itertools.pairwise(own))
        every = [(p, s) for s in (1, 3) for p in range(n[k] - s + 1)]
        apart = (c for c in itertools.combinations(sorted(every), int(m[k])) if all(p + s <= q for (p, s), (q, _) in itertools.pairwise(c)))
        cost = lambda p, s, k=k: int((run if s == 3 else word)[k, p])
        assert sum(cost(p, 3 if r else 1) for _, p, r in own) == min(sum(cost(*x) for x in c) for c in apart)


def test_filters_lose_no_line_within_the_bound():
    """What is whole in two lines lies in cells side by side, one of the chosen is near its place, and few classes of words differ."""
    rng, hashes = random.Random(11), linededup._Hash()
    for _ in range(400):
        a = [b"%d" % rng.randrange(60) for _ in range(rng.randint(10, 70))]
        edits, b, at = len(a) // 5, [], []  # b is the shorter or equal one; at: where each word of a is in b
        for w in a:
            at.append(len(b))
            do = rng.choice("kkkdr") if edits else "k"
            edits -= do != "k"
            at[-1] = at[-1] if do == "k" else None
            b += {"k": [w], "d": [], "r": [b"new"]}[do]
        d, na, nb = len(a) // 5, np.array([len(a)]), np.array([len(b)])
        x, y = linededup.odd_words([a, b], hashes).view(np.uint64)
        assert sum(int(v).bit_count() for v in x ^ y) <= 2 * d - (len(a) - len(b))
        for p, q in enumerate(at):
            if q is not None:
                one, other = (int(linededup.cells(n, np.array([k]))[0]) for n, k in ((na, p), (nb, q)))
                assert abs((one >> 3) - (other >> 3)) <= 1 and abs((one & 7) - (other & 7)) <= 1
        places = sorted(rng.sample(range(len(a)), d + 1))
        assert any((q := at[p]) is not None and abs(p - q) <= i and abs(len(a) - p - (len(b) - q)) <= d - i for i, p in enumerate(places))

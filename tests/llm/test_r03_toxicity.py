import random

import numpy as np
from docloom.llm import toxicity

WORDS = ["river", "stone", "light", "garden", "window", "paper", "north", "letter"]


def test_long_texts_are_learned_from_in_several_parts(spark, monkeypatch):
    """Texts beyond 20,000 characters were no part of the sample, so nothing was learned from these rows."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 40)
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(160):
        words = rng.choices(WORDS, k=4000)
        words[rng.randrange(4000)] = "vile scum" if k % 4 == 0 else "kind folk"
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(k % 4 == 0)))
    assert min(len(r[1]) for r in rows) > 20_000
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).where("held_out").collect()
    assert len(got) > 10 and sum(r.predicted == (r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)


def test_chunks_of_a_text_give_the_same_places(monkeypatch):
    p, ids = toxicity.start(), toxicity.Buckets().of(" ".join(f"{k}x{k}" for k in range(100)))  # no word twice, so no ties
    tops, most = toxicity.greatest(p, ids)
    z = toxicity.tabulated(p).logit(ids)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    tops_, most_ = toxicity.greatest(p, ids)
    assert np.allclose(most, most_, atol=1e-5) and all((a == b).all() for a, b in zip(tops, tops_, strict=True))
    assert np.isclose(z, toxicity.tabulated(p).logit(ids), atol=1e-5)

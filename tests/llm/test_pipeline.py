"""Each stage of the pipeline, and models and queries that SQL can't express, against plain brute-force versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import decontam, embeddings, langid, linededup, packing, toxicity
from docloom.llm._common import joined

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, line string, row_key string, words string, __lines string, __text string, lines_gone int"
WORDS = [w + str(k) for w in "river stone light garden paper window letter morning".split() for k in range(6)]


def row(k, t, lang="en"):
    return (k, t, lang, "src", None if t is None else len(t), "a", "b", "c", "d", "e", 7)


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 80))) for _ in range(30)]
    texts += [t + " " + rng.choice(WORDS) for t in texts[:6]] + texts[:3] + [texts[4] + "\n" + texts[5] + "\nshort one"]
    texts += [None, "", " \n ", "12 34", "word " * 3000, "short one\nshort one"]
    out = [row(k, t) for k, t in enumerate(texts)]
    return out + [out[0], row(None, texts[1]), row(None, texts[1]), row(3, "another text under an id that is taken")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows):
    """A folder with a benchmark of its own: two passages of the documents, one edited, and rows that match nothing."""
    item = rows[7][1].split()[:20]
    edited = [*item[:5], "other", *item[6:12], *item[13:]]
    path = str(tmp_path_factory.mktemp("sf"))
    items = [(1, " ".join(rows[9][1].split()[:18])), (2, " ".join(edited)), (3, None), (None, " ".join(rows[11][1].split()[:16])), (4, "nothing of this is in any text at all here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_language_stage(spark, docs, rows, none):
    model = langid.fit(docs)
    want = [r for r in rows if (p := model.predict(r[1]))[0] != "und" and not p[2]]
    got = stage("language_id")(spark, docs, "")
    assert got.columns == docs.columns and plain(got) == sorted(map(str, want))
    assert stage("language_id")(spark, none, "").count() == 0


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, line = line, [i]
        for j, y in enumerate(b, 1):
            line.append(min(old[j] + 1, line[-1] + 1, old[j - 1] + (x != y)))
    return line[-1]


def test_line_stage(spark, docs, rows, none):
    last = 1 << 62
    lines = [(last if r[0] is None else r[0], k, x.lower().split()) for r in rows for k, x in enumerate((r[1] or "").split("\n"))]
    lines = [x for x in lines if x[2]]

    def gone(d, k, w):
        for e, m, v in lines:
            if (e, m) < (d, k):
                if w == v:
                    return True
                most = max(len(w), len(v)) // 5
                if min(len(w), len(v)) >= 5 and abs(len(w) - len(v)) <= most and len(w) < 500 and distance(w, v) <= most:
                    return True
        return False

    want = []
    for r in rows:
        parts = (r[1] or "").split("\n")
        left = [x for k, x in enumerate(parts) if not x.split() or not gone(last if r[0] is None else r[0], k, x.lower().split())]
        t = r[1] if len(left) == len(parts) else "\n".join(left)
        if t is r[1] or t.strip():
            want.append((r[0], t, *r[2:4], None if t is None else len(t), *r[5:]))
    got = stage("line_dedup")(spark, docs, "")
    assert got.columns == docs.columns and got.dtypes == docs.dtypes and plain(got) == sorted(map(str, want))
    assert stage("line_dedup")(spark, none, "").count() == 0


def test_simhash_stage(spark, docs, rows, none):
    def fp(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps, up = [fp(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                up[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    got = stage("simhash_dedup")(spark, docs, "")
    kept = [tuple(r) for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == len(groups)
    for g in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in g)
        assert sum(1 for r in kept if r in g) == 1
        assert next((r[0] is None, r[0] or 0) for r in kept if r in g) == least
    assert stage("simhash_dedup")(spark, none, "").count() == 0


def test_decontamination_stage(spark, docs, rows, none, sf):
    """All documents against all items, aligned as a whole."""
    path, items = sf
    number = lambda ws: np.array([decontam.word_hash(w) for w in ws], np.int64)
    hit = set()
    for k, r in enumerate(rows):
        text = number(decontam.words(r[1]))
        for i, t in items:
            if (w := decontam.words(t)) and decontam.smith_waterman(number(w), text)[0] >= 0.7 * len(w) - 1e-9:
                hit.add((k, i))
    got = stage("decontaminate")(spark, docs, path)
    assert {i for _, i in hit} == {1, 2, None}
    assert got.columns == docs.columns and plain(got) == sorted(str(r) for k, r in enumerate(rows) if k not in {k for k, _ in hit})
    pairs = decontam.contaminated(docs, spark.read.parquet(f"{path}/benchmark.parquet")).collect()
    assert sorted(str((r.doc_id, r.item_id)) for r in pairs) == sorted(str((rows[k][0], i)) for k, i in hit)
    assert stage("decontaminate")(spark, none, path).count() == 0


def test_packing_stage(spark, docs, rows, none):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want += [(r[0], k, s, len(p := ids[s : s + 2048]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = stage("pack")(spark, docs, "").collect()
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert stage("pack")(spark, none, "").count() == 0


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_program_places_the_pieces():
    """On lengths as uneven as real ones, most pieces that are not full come from the program, near the bound of best-fit."""
    rng = np.random.default_rng(4)
    counts = np.bincount(np.clip(rng.lognormal(5.7, 1.1, 6000).astype(int) + 1, 1, 2048), minlength=2049)
    out, left = packing.programmed(counts)
    total = sum(n for _, n in out + packing.best_fit(left, 2048))
    assert left.sum() <= 0.1 * counts[:2048].sum()
    assert total <= 1.005 * sum(n for _, n in packing.best_fit(counts, 2048)) + 1


def test_hot_keys_lose_no_row(spark):
    rows = spark.createDataFrame([(k % 3 if k % 2 else 0, k) for k in range(2000)] + [(None, -1), (99, -2)], "key int, k int")
    facts = rows.where("key is not null and key < 50").groupBy("key").count().selectExpr("key", "count as held", "key * 10 as fact")
    for how in ("inner", "left"):
        assert plain(joined(rows, facts, "key", 2002, how).select("key", "k", "fact")) == plain(rows.join(facts, "key", how).select("key", "k", "fact"))


def test_session_settings_stay(spark, docs):
    before = dict(spark.conf.getAll)
    langid.identify(docs).count(), linededup.repeated_lines(docs).count()
    assert dict(spark.conf.getAll) == before


def test_convolution_by_hand():
    """The tabulated forward pass against filters applied to word vectors place by place."""
    rng = np.random.default_rng(1)
    word, stem = rng.normal(size=(toxicity.WORDS, toxicity.DIM)), rng.normal(size=(toxicity.STEMS, toxicity.DIM))
    word[0] = stem[0] = 0
    w, bias, out = rng.normal(size=(toxicity.DIM, toxicity.COLUMNS)), rng.normal(size=toxicity.FILTERS * 3), rng.normal(size=toxicity.FILTERS * 3)
    model = toxicity.ToxicityModel(word @ w, stem @ w, bias, out, 0.3)
    ids = toxicity.Buckets().of("The river, of STONE and light; light again")
    e = word[ids >> 16] + stem[ids & 0xFFFF]
    z, at = 0.3, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(e[p + o] @ w[:, at + o * toxicity.FILTERS + f]) for o in range(width)) for p in range(len(e) - width + 1))
            z += max(0.0, best + bias[k * toxicity.FILTERS + f]) * out[k * toxicity.FILTERS + f]
        at += width * toxicity.FILTERS
    assert model.logit(ids) == pytest.approx(z)


def test_toxicity_edges(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    docs = spark.createDataFrame([(1, "a " * 30_000), (1, "a " * 30_000), (None, None)], "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as score")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1


def test_decoding_by_hand():
    rng = np.random.default_rng(3)
    code = langid.codewords(5).astype(float)
    model = langid.LanguageModel(list("abcde"), code, None, None, rng.uniform(0.5, 2, code.shape[1]))
    for _ in range(50):
        m = rng.normal(size=code.shape[1])
        loss = [sum(model.trust[b] * np.log1p(np.exp(-code[c, b] * m[b])) for b in range(code.shape[1])) for c in range(5)]
        p = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        got = model.decode(m)
        two = np.sort(p)[::-1]
        assert got[0] == "abcde"[int(np.argmin(loss))] and got[1] == pytest.approx(p.max()) and got[2] == (two[0] - two[1] < langid.AMBIGUOUS)


def test_embeddings_of_any_length(spark):
    """Every length by itself, in double precision, with repeated rows, hot classes and null ids; all links by brute force."""
    rng = np.random.default_rng(12)
    rows = []
    for size, n in ((8, 400), (5, 60), (1, 3)):
        x = rng.normal(size=(n, size))
        x[n // 2 :] = x[: n - n // 2] + 0.2 * rng.normal(size=(n - n // 2, size))
        rows += [(len(rows) + k, [float(v) for v in r]) for k, r in enumerate(x)]
    rows += [(5000 + k, rows[0][1]) for k in range(40)] + [rows[1], (None, rows[2][1]), (9001, [1e300] * 8), (9002, [1e-300] * 8), (9003, [1.0, None] * 4), (9004, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "'x' as id")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embeddings.near_duplicates(df, least=0.9, target=1.0).collect())
    ok = lambda v: all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if ok(v) else None for _, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    link = lambda a, b: a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.9
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if link(unit[i], unit[j]):
                n[i] += 1
                n[j] += 1
                up[find(i)] = find(j)
    least = {}
    for k, (v, _) in enumerate(rows):
        if v is not None:
            least[find(k)] = min(v, least.get(find(k), v))
    want = sorted((str(v), n[k], least.get(find(k))) for k, (v, _) in enumerate(rows))
    assert sum(x[1] for x in got) >= 0.99 * sum(n)
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0

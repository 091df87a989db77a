"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of a hashed vector of the word and one of its first letters. Filters of widths 1, 2 and 3 run
over the words, each keeps its greatest response in the text, and a logistic layer weighs them. Since the filters are
linear, scoring needs no vectors: each bucket's responses are tabulated once, and a text's are sums of table rows.

Thresholds are calibrated by language, on rows that training has not seen; the language is told from the words, never
from a column. Every labelled row outside the held-out fold is read, at any length, and nothing of that passes through one task:
rows are dealt into parts, each round trains every part from the same start, and what the parts changed is averaged as a Spark job.
A score is the logistic of the distance from its language's threshold, so 0.5 is where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import dropped, id_and_text, mapped, saved, unreferenced

WORDS, STEMS, STEM = 1 << 15, 1 << 13, 4
DIM, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
COLUMNS = FILTERS * sum(WIDTHS)
#: Rows that one part should hold, and the rates of the rounds of training: each goes through all parts once.
PART_ROWS, RATES = 4000, (0.01, 0.008, 0.006, 0.005, 0.004)
#: Rows of a table in one slice of a sum; words whose responses are held at once; steps of a logit that thresholds tell apart.
SLICE, CHUNK, STEPS = 1024, 1 << 16, 256
#: Labels that are sent to the texts (more: a join by shuffle); languages beyond which all share one threshold.
MOST_MARKS, MOST_LANGUAGES = 1_000_000, 200
MOST_WORDS = 500_000
_STRIP = ".,;:!?\"'()[]{}<>«»¡¿-–—*_"


class Buckets(dict):
    """word -> (word bucket << 16 | stem bucket); 0 in either place means none."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        core = word.strip(_STRIP)
        got = (1 + xxhash.xxh32_intdigest(core, 1) % (WORDS - 1)) << 16 | 1 + xxhash.xxh32_intdigest(core[:STEM], 2) % (STEMS - 1) if core else 0
        if len(word) < 64:
            self[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        """Buckets of a whole text, with two empty places after it so that every filter has a place."""
        ids = [x for x in map(self.__getitem__, text.lower().split()) if x]
        return np.array([*ids, 0, 0, 0][: len(ids) + 2 + (not ids)], np.int64)


def windows(x: np.ndarray) -> list[np.ndarray]:
    """Responses by width: from an (n, COLUMNS) sum of table rows, what each filter yields at each place."""
    out, at = [], 0
    for width in WIDTHS:
        n = len(x) - width + 1
        out.append(sum(x[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(width)))
        at += width * FILTERS
    return out


def chunks(ids: np.ndarray) -> list[np.ndarray]:
    """A long text in runs that overlap, so that every filter has each of its places in one."""
    return [ids[s : s + CHUNK + 2] for s in range(0, len(ids) - 2, CHUNK)]


@dataclass
class ToxicityModel:
    word: np.ndarray  # WORDS x COLUMNS responses
    stem: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    languages: list[str] = field(default_factory=list)
    evidence: np.ndarray | None = None  # WORDS x languages
    thresholds: np.ndarray | None = None  # logits by language

    def logit(self, ids: np.ndarray) -> float:
        most = [[w.max(0) for w in windows(self.word[x >> 16] + self.stem[x & 0xFFFF])] for x in chunks(ids)]
        h = np.concatenate([np.max(x, 0) for x in zip(*most, strict=True)]) + self.bias
        return float(np.maximum(h, 0) @ self.out + self.shift)

    def language(self, ids: np.ndarray) -> int:
        return int(self.evidence[ids >> 16].sum(0).argmax()) if self.languages else 0

    def score(self, ids: np.ndarray) -> float:
        z = self.logit(ids) - (self.thresholds[self.language(ids)] if self.thresholds is not None else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {
        "word": rng.normal(0, 0.1, (WORDS, DIM)).astype(np.float32), "stem": rng.normal(0, 0.1, (STEMS, DIM)).astype(np.float32),
        "w": rng.normal(0, 0.3, (DIM, COLUMNS)).astype(np.float32), "bias": np.zeros(FILTERS * len(WIDTHS), np.float32),
        "out": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "shift": np.full(1, -1, np.float32),
    }
    p["word"][0] = p["stem"][0] = 0
    return p


def greatest(p: dict[str, np.ndarray], ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """By width, the places of the greatest responses; and these responses."""
    tops, most = [], []
    for k, part in enumerate(chunks(ids)):
        resp = windows((p["word"][part >> 16] + p["stem"][part & 0xFFFF]) @ p["w"])
        at = [r.argmax(0) for r in resp]
        top = [r[x, np.arange(FILTERS)] for r, x in zip(resp, at, strict=True)]
        if not k:
            tops, most = at, top
            continue
        for i in range(len(WIDTHS)):
            more = top[i] > most[i]
            tops[i], most[i] = np.where(more, at[i] + k * CHUNK, tops[i]), np.where(more, top[i], most[i])
    return tops, np.concatenate(most)


def train(p: dict[str, np.ndarray], docs: list[np.ndarray], labels: np.ndarray, epochs: int = 1, batch: int = 16, rate: float = 0.01, seed: int = 5) -> None:
    """Adam on minibatches, in place; through a maximum the gradient reaches only the place that made it."""
    rng = np.random.default_rng(seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    t = 0
    for _ in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), batch):
            g = {k: np.zeros_like(p[k]) for k in ("w", "bias", "out", "shift")}
            rows: dict[str, list] = {"word": [], "stem": []}
            some = order[s : s + batch]
            for d in some:
                ids = docs[d]
                tops, h = greatest(p, ids)
                h = h + p["bias"]
                a = np.maximum(h, 0)
                dz = 1 / (1 + np.exp(-np.clip(a @ p["out"] + p["shift"][0], -30, 30))) - labels[d]
                g["out"] += dz * a
                g["shift"] += dz
                dh = dz * p["out"] * (h > 0)
                g["bias"] += dh
                at = 0
                for k, width in enumerate(WIDTHS):
                    part = dh[k * FILTERS : (k + 1) * FILTERS]
                    for o in range(width):
                        cols = slice(at + o * FILTERS, at + (o + 1) * FILTERS)
                        where = tops[k] + o
                        g["w"][:, cols] += (p["word"][ids[where] >> 16] + p["stem"][ids[where] & 0xFFFF]).T * part
                        de = p["w"][:, cols].T * part[:, None]
                        rows["word"].append((ids[where] >> 16, de))
                        rows["stem"].append((ids[where] & 0xFFFF, de))
                    at += width * FILTERS
            t += 1
            fix = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, v in g.items():
                v = v / len(some)
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.001 * (v * v - m2[k])
                p[k] -= fix * m1[k] / (np.sqrt(m2[k]) + 1e-8)
            for k, parts in rows.items():  # only the rows that were read
                at, inverse = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
                v = np.zeros((len(at), DIM), np.float32)
                np.add.at(v, inverse, np.concatenate([x for _, x in parts]) / len(some))
                m1[k][at] += 0.1 * (v - m1[k][at])
                m2[k][at] += 0.001 * (v * v - m2[k][at])
                p[k][at] -= fix * m1[k][at] / (np.sqrt(m2[k][at]) + 1e-8)
                p[k][0] = 0


def tabulated(p: dict[str, np.ndarray]) -> ToxicityModel:
    return ToxicityModel(p["word"] @ p["w"], p["stem"] @ p["w"], p["bias"], p["out"], float(p["shift"][0]))


def calibrate(model: ToxicityModel, z: np.ndarray, of: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
    """Each language's threshold: the logit of greatest F1, half-way to the next lower one; a language with fewer than ten toxic
    rows takes that of all rows together. ``weights``: rows of each logit, language and label."""

    def best(pick: np.ndarray) -> float:
        zs, ys, ws = z[pick], labels[pick], weights[pick]
        if not (ys == 1).any():
            return 0.0
        order = np.argsort(-zs, kind="stable")
        zs, ys, ws = zs[order], ys[order], ws[order]
        hit, said = np.cumsum(ys * ws), np.cumsum(ws)
        f1 = 2 * hit / (said + (ys * ws).sum())
        f1[:-1][zs[:-1] == zs[1:]] = -1
        k = int(f1.argmax())
        return float((zs[k] + zs[k + 1]) / 2 if k + 1 < len(zs) else zs[k] - 1)

    every = best(np.ones(len(z), bool)) if len(z) else 0.0
    model.thresholds = np.array([best(of == k) if weights[(of == k) & (labels == 1)].sum() >= 10 else every for k in range(max(1, len(model.languages)))])


def fold(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)), F.lit(1))


ROWS = "part int, turn long, use int, toxic int, lang string, ids binary"


def _encoded(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.toxicity import _bucketed

        for batch in batches:
            ids = [_bucketed(t or "").astype(np.uint32).tobytes() for t in batch.column(4).to_pylist()]
            turn = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = pa.array((turn % parts).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part, *batch.columns[:4], pa.array(ids, pa.binary())], [x.split()[0] for x in ROWS.split(", ")])

    return run


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint32).astype(np.int64)


def _slices(p: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    return [(k, s) for k in ("word", "stem") for s in range(0, len(p[k]), SLICE)] + [(k, 0) for k in ("w", "bias", "out", "shift")]


def _round(p: dict[str, np.ndarray], rate: float, seed: int):
    """What a task's parts changed, each trained alone from ``p``: sums by slice, with how many parts changed a row (for the layers, the parts' rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((len(p[k]), p[k].shape[-1] + 1) if k in ("word", "stem") else p[k].size + 1, np.float32) for k in p}
        docs, labels, own = [], [], None

        def learned():
            q = {k: v.copy() for k, v in p.items()}
            train(q, docs, np.array(labels, np.float32), min(10, max(1, PART_ROWS // len(docs))), rate=rate, seed=seed)
            for k, v in q.items():
                change = v - p[k]
                if k in ("word", "stem"):
                    total[k][:, :-1] += change
                    total[k][:, -1] += change.any(1)
                else:
                    total[k][:-1] += change.reshape(-1) * len(docs)
                    total[k][-1] += len(docs)

        for batch in batches:
            for part, toxic, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != own and docs:
                    learned()
                    docs, labels = [], []
                own = part
                docs.append(_ids(ids))
                labels.append(toxic)
        if docs:
            learned()
            data = [(total[k][s : s + SLICE] if k in ("word", "stem") else total[k]).tobytes() for k, s in _slices(p)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(data)), pa.int32()), pa.array(data, pa.binary())], ["slice", "data"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(data, np.float32)
            total[k] = total[k] + x if k in total else x.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "data"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's texts."""
    n: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lang not in n:
                n[lang] = np.zeros(WORDS, np.int64)
            n[lang] += np.bincount(_ids(ids) >> 16, minlength=WORDS)
    for lang, x in n.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at])], ["lang", "bucket", "n"])


def learn_languages(model: ToxicityModel, rows: DataFrame) -> None:
    """Word evidence for each language: log shares of the buckets in all rows, with one added to each."""
    named = rows.where("use = 0 and lang <> ''")
    langs = sorted(r.lang for r in named.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if not langs or len(langs) > MOST_LANGUAGES:
        return
    model.languages = langs
    got = mapped(named.select("lang", "ids"), _counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    n, place = np.ones((WORDS, len(langs))), {x: k for k, x in enumerate(langs)}
    n[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] += got["n"].to_numpy()
    model.evidence = np.log(n / n.sum(0)).astype(np.float32)
    model.evidence[0] = 0


def _logits(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [_ids(x) for x in batch.column(1).to_pylist()]
            step = np.clip(np.floor(np.array([model.logit(x) for x in docs]) * STEPS), -(1 << 20), 1 << 20).astype(np.int32)
            of = np.array([model.language(x) for x in docs], np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of), pa.array(step)], ["toxic", "of", "step"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train on all labelled rows of folds 2 to 4 and calibrate on all of fold 1; fold 0 is never read.

    Texts are read whole, whatever their length. Rows become lists of buckets once, dealt by a hash of doc_id into parts of
    about ``PART_ROWS``. Each round trains every part from the same start; a row of the embeddings moves by the mean over the parts that
    changed it, the layers by the mean over rows. So the driver gets one model a round, at any number of rows. Logits are told
    apart in steps of 1 / ``STEPS`` when thresholds are chosen, from counts of all rows. A doc_id labelled twice is toxic
    if any row says so; of a doc_id in several rows each counts.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0").selectExpr("doc_id", "toxic", "if(fold = 1, 1, 0) as use")
    marks = saved(marks, "marks")
    n = marks.count()
    parts = max(1, -(-marks.where("use = 0").count() // PART_ROWS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null")
    texts = texts.join(F.broadcast(marks) if n <= MOST_MARKS else marks, "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("turn"), "use", "toxic", "lang", "text")
    rows = mapped(texts, _encoded(parts), ROWS).repartitionById(parts, "part").sortWithinPartitions("part", "turn", F.xxhash64("ids"))
    rows = saved(rows, "encoded", "zstd")
    p = start()
    trained = rows.where("use = 0").select("part", "toxic", "ids")
    for k, rate in enumerate(RATES if n else ()):
        changes = mapped(trained, _round(p, rate, k), "slice int, data binary").repartitionById(len(_slices(p)), "slice")
        got = {r.slice: np.frombuffer(r.data, np.float64) for r in mapped(changes, _summed, "slice int, data binary").collect()}
        for at, (name, s) in enumerate(_slices(p)):
            if at in got and name in ("word", "stem"):
                x = got[at].reshape(-1, DIM + 1)
                p[name][s : s + SLICE] += (x[:, :-1] / np.maximum(x[:, -1:], 1)).astype(np.float32)
            elif at in got:
                p[name] += (got[at][:-1] / got[at][-1]).reshape(p[name].shape).astype(np.float32)
        unreferenced(docs.sparkSession)
    model = tabulated(p)
    learn_languages(model, rows)
    got = mapped(rows.where("use = 1").select("toxic", "ids"), _logits(model), "toxic int, of int, step int").groupBy("toxic", "of", "step").count().collect()
    z, of, y, many = (np.array([r[k] for r in got], t) for k, t in (("step", float), ("of", np.int64), ("toxic", float), ("count", float)))
    calibrate(model, z / STEPS, of, y, many)
    dropped(rows, marks)
    return model


_buckets = Buckets()


def _bucketed(text: str) -> np.ndarray:
    """Kept from task to task in each Python worker."""
    return _buckets.of(text)


def _scores(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from docloom.llm.toxicity import _bucketed

        for batch in batches:
            s = np.array([model.score(_bucketed(t.decode("utf-8", "replace") if t else "")) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from its whole text alone.

    Null and empty texts get the score of a text without words. Repeated rows and null doc_ids (not held out) come out as
    they went in; an empty table gives an empty result. Without labels the model is untrained and its scores mean nothing.
    """
    got = mapped(id_and_text(docs), _scores(model), "doc_id long, score double, predicted int")
    return got.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")

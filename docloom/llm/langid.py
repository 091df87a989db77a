"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword; one linear classifier for each of its bits is trained on hashed byte n-grams of the
lower-cased text. A text gets the language whose codeword costs least, the bits' losses weighted by how well each bit
did in training; the gap to the second codeword flags ambiguous texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import id_and_text, mapped

UNDETERMINED = "und"
BUCKETS = 1 << 16
#: The bound on training: labelled rows of each language, and characters of a row that may be in the sample.
ROWS_PER_LANGUAGE, SAMPLE_CHARS = 400, 20_000
#: More languages than this are refused: their models would not fit.
MOST_LANGUAGES = 1_000
#: Below this gap between the two best probabilities a text is flagged as ambiguous.
AMBIGUOUS = 0.2
_LETTER = regex.compile(r"\p{L}")
_RUNS = regex.compile(r"[^\p{L}]+")


def codewords(k: int) -> np.ndarray:
    """Rows of +1 and -1, one for each of k classes: all 2^(k-1) - 1 different splits up to seven classes, else 4 log2 k + 10
    random splits of greatest least distance among 50 draws."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        splits = [[1 if c == 0 or (s >> (c - 1)) & 1 else -1 for c in range(k)] for s in range(2 ** (k - 1) - 1)]
        return np.array(splits, np.int8).T
    rng, best = np.random.default_rng(7), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, 4 * int(np.ceil(np.log2(k))) + 10))
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def grams(text: str) -> np.ndarray:
    """Buckets of the byte bigrams and trigrams of the lower-cased letters, runs of other characters being one space."""
    b = np.frombuffer((" " + _RUNS.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = (two[:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return np.concatenate([two * np.uint32(40503) & np.uint32(BUCKETS - 1), three >> np.uint32(16)]).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def margins(self, text: str) -> np.ndarray:
        return self.weights[grams(text)].mean(0, dtype=np.float64) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        """Loss-weighted decoding: logistic losses of the bits against each codeword; (language, probability, ambiguous)."""
        loss = np.logaddexp(0, -self.code * margins) @ self.trust
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        gap = p[order[0]] - (p[order[1]] if len(order) > 1 else 0)
        return self.languages[order[0]], float(p[order[0]]), bool(gap < AMBIGUOUS)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, False
        return self.decode(self.margins(text))


def train(texts: list[str], labels: list[str], epochs: int = 30, rate: float = 2.0, decay: float = 1e-4) -> LanguageModel:
    """Fit all bits at once by full-batch AdaGrad on the mean gram vectors of the texts."""
    languages = sorted(set(labels))
    code = codewords(len(languages)).astype(np.float64)
    rows = [np.unique(grams(t), return_counts=True) for t in texts]
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]) if rows else np.zeros(0, np.int64)
    which = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
    share = np.concatenate([c / c.sum() for _, c in rows]) if rows else np.zeros(0)
    used, column = np.unique(which, return_inverse=True)
    n, bits = len(texts), code.shape[1]
    y = code[[languages.index(x) for x in labels]] if n else np.zeros((0, bits))
    seen = np.bincount([languages.index(x) for x in labels], minlength=len(languages)) if n else np.ones(1)
    each = (n / (len(languages) * seen))[[languages.index(x) for x in labels]][:, None] if n else np.zeros((0, 1))
    w, b = np.zeros((len(used), bits)), np.zeros(bits)
    gw, gb = np.full(w.shape, 1e-8), np.full(bits, 1e-8)
    ends = np.searchsorted(at, np.arange(n))
    by_column = np.argsort(column, kind="stable")
    firsts = np.searchsorted(column[by_column], np.arange(len(used)))
    for _ in range(epochs if n else 0):
        f = np.add.reduceat(w[column] * share[:, None], ends, axis=0) + b
        g = -y / (1 + np.exp(np.clip(y * f, -30, 30))) * each / n
        dw = np.add.reduceat((g[at] * share[:, None])[by_column], firsts, axis=0) + decay * w
        db = g.sum(0)
        gw += dw * dw
        gb += db * db
        w -= rate * dw / np.sqrt(gw)
        b -= 0.1 * rate * db / np.sqrt(gb)
    f = np.add.reduceat(w[column] * share[:, None], ends, axis=0) + b if n else np.zeros((0, bits))
    wrong = np.clip(((f * y) <= 0).mean(0), 1e-3, 0.5 - 1e-3) if n else np.full(bits, 0.25)
    trust = np.log((1 - wrong) / wrong)
    full = np.zeros((BUCKETS, bits), np.float32)
    full[used] = w
    return LanguageModel(languages, code, full, b, trust / trust.mean())


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, learn=None, sample_chars: int | None = SAMPLE_CHARS) -> LanguageModel:
    """Learn from text and non-null lang of the rows that ``learn`` admits (a Column; by default crc32 of doc_id mod 4 is not 2).

    The sample is bounded: of each language the ``rows_per_language`` rows first by a hash of doc_id, among texts of at
    most ``sample_chars`` characters, the bound of the sample's bytes (None: any length). Texts of any length are predicted whole. Languages come from the data; more than ``MOST_LANGUAGES`` raise ValueError.
    """
    learn = learn if learn is not None else ~held_out(F.col("doc_id"))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows if sample_chars is None else rows.where(F.length("text") <= sample_chars)
    # The least hashes of each language are kept as (hash, id) pairs while aggregating; texts are fetched for those alone.
    cut = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(cut) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values of lang")
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 30))
    if not cut:
        return train([], [])
    limits = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 1.5 * rows_per_language / r.n) * (1 << 30))) for r in cut], "lang string, most long")
    some = rows.join(F.broadcast(limits), "lang").withColumn("h", h).where("h <= most")  # at most MOST_LANGUAGES rows
    some = some.selectExpr("*", "row_number() over (partition by lang order by h, doc_id, text) as turn").where(F.col("turn") <= rows_per_language)
    got = sorted((r.lang, r.turn, r.text) for r in some.select("lang", "turn", "text").collect())
    return train([t for _, _, t in got], [x for x, _, _ in got])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _predicted(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.decode("utf-8", "replace") if t else None) for t in batch.column(1).to_pylist()]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row, from the whole text alone; ``und`` and 0 for texts without a letter."""
    return mapped(id_and_text(docs), _predicted(model), "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the learning rows and predict all: (doc_id, held_out, lang_pred, score, ambiguous).

    Null texts and texts without a letter are ``und`` with score 0; so is everything where no row has a label. A null
    doc_id is not held out. Repeated rows come out once each; an empty table gives an empty result.
    """
    got = predict(docs, fit(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all their columns as they were, whose language is determined and not ambiguous.

    Null and empty texts and those without a letter go; repeated rows are treated alike, and an empty table stays empty.
    """
    keep = F.pandas_udf(lambda s: s.map(lambda t: (p := model.predict(t))[0] != UNDETERMINED and not p[2]).astype(bool), "boolean")
    return docs.where(keep(F.col("text").cast("string")))

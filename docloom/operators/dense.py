"""Dense search by exact cosine distance, the latent-semantic embedder, and its vocabulary."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.operators.lexical import LEXICON

VOCABULARY, DIMENSIONS = 4096, 128


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, 1 - dot(a, b) / norm).otherwise(1.0)


def nearest(vectors: DataFrame, probes: list[list[float]], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """The k nearest of each probe, and over probes the least distance. Always exact. ``vectors`` are those of documents (doc_id,
    embedding) or of chunks (doc_id, chunk_index, embedding); the result has the same key, and distance."""
    key = [c for c in ("doc_id", "chunk_index") if c in vectors.columns]
    if allowed is not None:
        vectors = vectors.join(allowed.select("doc_id"), "doc_id", "left_semi")
    out = None
    for p in probes:
        got = vectors.select(*key, distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in p])).alias("distance")).orderBy("distance", *key).limit(k)
        out = got if out is None else out.unionByName(got)
    return out.groupBy(*key).agg(F.min("distance").alias("distance"))


def tokens(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, ts): Latin words, Han bigrams and trigrams (a single character by itself), and a token for each concept of
    ``lexicon`` that is named. A text is normalised once, and looked at for Han only if it has any."""
    lexicon = LEXICON if lexicon is None else lexicon
    none = F.array().cast("array<string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.regexp_replace(F.lower(tx.collapsed(tx.narrow(F.col("text")))), r"\s+", " ")).alias("low"))
    rows = rows.select("*", F.when(F.col("low").rlike(tx.HAN), F.regexp_extract_all("low", F.lit(f"({tx.HAN}+)"), 1)).alias("blocks"))
    han = F.concat(F.filter("blocks", lambda b: F.length(b) == 1), tx.ngrams(F.col("blocks"), 2), tx.ngrams(F.col("blocks"), 3))
    concepts = [F.when(_any([F.col("low").contains(t.lower()) for t in terms]), F.lit(f"concept::{name}")) for name, terms in lexicon.items()]
    parts = [F.regexp_extract_all("low", F.lit("([a-z0-9]+)"), 1), F.when(F.col("blocks").isNotNull(), han).otherwise(none)]
    return rows.select("doc_id", F.concat(*parts, *([F.array_compact(F.array(*concepts))] if concepts else [])).alias("ts"))


def _any(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def token_rows(docs: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, token, c): counts of each document's tokens, and of one auxiliary document (negative id) per cluster: its
    concept and the tokens of each of its terms by itself.

    Documents are dealt out by id once; what follows, counts and totals, is grouped within those partitions.
    """
    got = tokens(docs.select("doc_id", "text"), lexicon)
    if lexicon:
        spark = docs.sparkSession
        terms = spark.createDataFrame([(-1 - k, t) for k, ts in enumerate(lexicon.values()) for t in ts], "doc_id long, text string")
        own = spark.createDataFrame([(-1 - k, [f"concept::{name}"]) for k, name in enumerate(lexicon)], "doc_id long, ts array<string>")
        got = got.unionByName(tokens(terms, lexicon)).unionByName(own)
    return got.repartition("doc_id").select("doc_id", F.explode("ts").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("c"))


def vocabulary(counts: DataFrame, n_docs: int, size: int = VOCABULARY) -> DataFrame:
    """The tokens of greatest document frequency, then total frequency, then first in order: (token, df, tf, idf)."""
    top = counts.groupBy("token").agg(F.count("*").alias("df"), F.sum("c").alias("tf")).orderBy(F.desc("df"), F.desc("tf"), "token").limit(size)
    return top.withColumn("idf", F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, token, w): (1 + ln c) over the document's tokens in the vocabulary, times idf. The vocabulary is at most
    4096 rows, so it is broadcast; the totals are sums within a document's partition."""
    known = counts.join(F.broadcast(vocab.select("token", "idf")), "token")
    total = F.sum("c").over(W.partitionBy("doc_id"))
    return known.select("doc_id", "token", ((1 + F.log("c")) / total * F.col("idf")).alias("w"))


def _partial_gram(size: int):
    """Sums of outer products of the rows of one partition, a block of documents at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for f in frames:
            for s in range(0, len(f), 256):
                x = np.zeros((len(f.iloc[s : s + 256]), size))
                for k, (ids, ws) in enumerate(zip(f["ids"].iloc[s : s + 256], f["ws"].iloc[s : s + 256], strict=True)):
                    x[k, ids] = ws
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            for s in range(0, size, 256):
                yield pd.DataFrame({"i": range(s, min(size, s + 256)), "row": [r.tobytes() for r in total[s : s + 256]]})

    return run


def _summed(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": f["i"].iloc[:1], "row": [np.sum([np.frombuffer(r) for r in f["row"]], axis=0).tobytes()]})


@dataclass
class Embedder:
    """Latent semantic projection: the first right singular vectors, from the Gram matrix (vocabulary squared)."""

    tokens: list[str]
    idf: np.ndarray
    projection: np.ndarray
    lexicon: dict[str, list[str]]

    @classmethod
    def fit(cls, docs: DataFrame, lexicon: dict[str, list[str]] | None = None, size: int = VOCABULARY, dim: int = DIMENSIONS, parts: int = 64) -> Embedder:
        """The driver gets the vocabulary and the Gram matrix, bounded by ``size``; each of at most ``parts`` tasks sums its
        documents' outer products, so what is shuffled grows with neither documents nor pairs of tokens."""
        lexicon = LEXICON if lexicon is None else lexicon
        counts = token_rows(docs, lexicon)
        vocab = vocabulary(counts, docs.count() + len(lexicon), size)
        rows = sorted((r.token, r.idf) for r in vocab.collect())  # at most ``size`` rows
        n, spark = len(rows), docs.sparkSession
        p = np.zeros((n, dim))
        if n:
            numbered = spark.createDataFrame([(t, i, k) for k, (t, i) in enumerate(rows)], "token string, idf double, id int")
            w = tfidf(counts, numbered).join(F.broadcast(numbered.select("token", "id")), "token")
            vectors = w.groupBy("doc_id").agg(F.collect_list(F.struct("id", "w")).alias("v")).select(F.col("v.id").alias("ids"), F.col("v.w").alias("ws"))
            got = vectors.coalesce(parts).mapInPandas(_partial_gram(n), "i int, row binary").groupBy("i").applyInPandas(_summed, "i int, row binary")
            gram = np.zeros((n, n))
            for r in got.toLocalIterator():
                gram[r.i] = np.frombuffer(r.row)
            _, v = np.linalg.eigh(gram)
            p[:, : min(dim, n)] = v[:, ::-1][:, :dim]
        return cls([t for t, _ in rows], np.array([i for _, i in rows]), p, lexicon)

    def embed(self, docs: DataFrame) -> DataFrame:
        """(doc_id, embedding): normalised; zero where a text has no known token."""
        at, idf, p = {t: k for k, t in enumerate(self.tokens)}, self.idf, self.projection

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for ts in f["ts"]:
                    which, c = np.unique([at[t] for t in ts if t in at], return_counts=True) if len(ts) else (np.zeros(0, int), np.zeros(0))
                    v = ((1 + np.log(c)) / c.sum() * idf[which.astype(int)]) @ p[which.astype(int)] if len(which) else np.zeros(p.shape[1])
                    n = np.linalg.norm(v)
                    out.append((v / n if n else v).tolist())
                yield pd.DataFrame({"doc_id": f["doc_id"], "embedding": out})

        return tokens(docs, self.lexicon).where("ts is not null").mapInPandas(run, "doc_id long, embedding array<double>")

    def embed_query(self, spark: SparkSession, text: str) -> list[float]:
        return self.embed(spark.createDataFrame([(0, text)], "doc_id long, text string")).first().embedding

    def fingerprint(self) -> str:
        """MD5 of the model, rounded to six places."""
        said = {"vocabulary": self.tokens, "idf": self.idf.round(6).tolist(), "projection": (self.projection.round(6) + 0.0).tolist(), "lexicon": self.lexicon}
        return hashlib.md5(json.dumps(said, ensure_ascii=False, sort_keys=True).encode()).hexdigest()

    def save(self, spark: SparkSession, path: str) -> None:
        """A Parquet table of one row for each token, in order, and one that describes the model."""
        rows = [(k, t, float(i), [float(x) for x in p]) for k, (t, i, p) in enumerate(zip(self.tokens, self.idf, self.projection, strict=True))]
        spark.createDataFrame(rows, "k int, token string, idf double, projection array<double>").write.parquet(f"{path}/tokens")
        spark.createDataFrame([(self.projection.shape[1], len(rows), json.dumps(self.lexicon, ensure_ascii=False), self.fingerprint())], "dim int, size int, lexicon string, fingerprint string").write.parquet(f"{path}/model")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedder:
        """ValueError if what is read is not the model that was saved."""
        about = spark.read.parquet(f"{path}/model").first()
        rows = spark.read.parquet(f"{path}/tokens").orderBy("k").collect()
        p = np.array([r.projection for r in rows]).reshape(len(rows), about["dim"])
        out = cls([r.token for r in rows], np.array([r.idf for r in rows]), p, json.loads(about["lexicon"]))
        if len(rows) != about["size"] or out.fingerprint() != about["fingerprint"]:
            raise ValueError(f"the model at {path} is incomplete or was changed")
        return out


def added(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors with new ones, which replace those of the same id."""
    return vectors.join(new.select("doc_id"), "doc_id", "left_anti").unionByName(new)


def deleted(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    return vectors.join(gone.select("doc_id"), "doc_id", "left_anti")


def committed(spark: SparkSession, generations: DataFrame) -> DataFrame:
    """The vectors of the committed generation; an empty channel where there is none, which is degraded but no error."""
    row = generations.where("state = 'committed'").orderBy(F.desc("generation")).first()
    return spark.createDataFrame([], "doc_id long, embedding array<double>") if row is None else spark.read.parquet(f"{row.bundle_path}/vectors")


def rebuilt(spark: SparkSession, chunks: DataFrame, folder: str, generation: int) -> tuple[str, str]:
    """Fit, embed and write one generation's bundle: (bundle_path, fingerprint). What it holds is checked before it may be
    committed: a vector for each text, and a model that can be loaded."""
    model, path = Embedder.fit(chunks), f"{folder}/gen={generation}"
    model.embed(chunks).write.parquet(f"{path}/vectors")
    model.save(spark, f"{path}/model")
    if spark.read.parquet(f"{path}/vectors").count() != chunks.where("text is not null").count():
        raise ValueError(f"the bundle at {path} lacks vectors")
    return path, Embedder.load(spark, f"{path}/model").fingerprint()


def lsa_neighbors(docs: DataFrame, model: Embedder, text: str, k: int) -> DataFrame:
    """(doc_id, distance): the documents nearest to a text in the latent space."""
    return nearest(model.embed(docs), [model.embed_query(docs.sparkSession, text)], k)

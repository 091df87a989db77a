"""A stored approximate index of vectors: inverted lists with product-quantised codes, and exact distances at the end.

Vectors are brought to length one and dealt to the list of their nearest centroid; what is left of each (its residual) is coded in a
byte for each of some runs of its components. A search reads only the lists whose centroids are nearest to the query, ranks their
codes by looked-up sums, and computes exact distances for the best. Codes and vectors are partitioned by list, and a list
that holds much is several files. Of a group of near copies that share one code, as many are looked at exactly as are refined: those
found are as near as any, but which they are is by chance. ``search_whole`` goes without the codes: it compares all live vectors.
Changes are segments with deletions, committed as generations of a ``versions.Store``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docloom.operators import dense
from docloom.sources.versions import Manifest, Store

#: Most rows that the model is fitted on, rounds of fitting, lists at most, and values of a code.
SAMPLE, ROUNDS, MOST_LISTS, VALUES = 50_000, 12, 4096, 256
#: Runs of components that are coded in a byte each.
PARTS = 16
#: How many vectors are asked for their ``NEIGHBOURS`` to choose how much a search reads, and the share of them to be found.
ASKED, NEIGHBOURS, TARGET = 200, 10, 0.97
MOST_REFINED = 640
#: Queries of one pass over the lists, and deletions that are broadcast; more are joined by shuffle.
BLOCK, BROADCAST_ROWS = 1024, 500_000
#: Most keys of codes to be refined that are broadcast.
BROADCAST_KEYS = 200_000
#: The list of what has no direction: null, zero or not finite vectors, and those of another length. It is never read.
NOWHERE = -1
#: Rows whose distances from all centres, or from a block of queries, are in memory at once.
ROWS = 4096
#: Queries of one pass over all vectors, and how far a product by matrices may be from a sum in order; nearer ones are summed in order.
PASS, SLACK = 8192, 1e-11


def _near(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each row, half its squared distance less half the row's own), a block of rows at a time."""
    near, gap, own = np.zeros(len(x), np.int64), np.zeros(len(x)), (at**2).sum(1) / 2
    for s in range(0, len(x), ROWS):
        d = own - x[s : s + ROWS] @ at.T
        near[s : s + ROWS] = d.argmin(1)
        gap[s : s + ROWS] = d.min(1)
    return near, gap


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from rows drawn at random; a centre that loses all its rows takes one of the farthest."""
    at = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        near, gap = _near(x, at)
        far = np.argsort(-gap)
        for c, n in enumerate(np.bincount(near, minlength=len(at))):
            at[c] = x[near == c].mean(0) if n else x[far[c % len(far)]]
    return at.astype(np.float32)


@dataclass(frozen=True)
class Model:
    centres: np.ndarray
    books: list[np.ndarray]

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def runs(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.dim), len(self.books))

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, parts: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        centres = _means(x, lists, rng)
        rest = x - centres[_near(x, centres)[0]]
        return cls(centres, [_means(rest[:, r], VALUES, rng) for r in np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of unit vectors."""
        near = _near(x, self.centres)[0]
        rest = x - self.centres[near]
        codes = [_near(rest[:, r], b)[0] for r, b in zip(self.runs(), self.books, strict=True)]
        return near, np.stack(codes, 1).astype(np.uint8)

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, centres=self.centres, **{f"book{k}": b for k, b in enumerate(self.books)})
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Model:
        got = np.load(io.BytesIO(data))
        return cls(got["centres"], [got[f"book{k}"] for k in range(len(got.files) - 1)])


def unit(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which of them have a direction)."""
    x = np.zeros((len(vectors), dim), np.float64)
    for k, v in enumerate(vectors):
        if v is not None and len(v) == dim and None not in v:
            x[k] = v
    n = np.sqrt((x**2).sum(1))
    some = np.isfinite(n) & (n > 0)
    x[~some] = 0
    return (x / np.where(some, n, 1)[:, None]).astype(np.float32), some


@dataclass(frozen=True)
class VectorIndex:
    store: Store
    manifest: Manifest
    model: Model
    key: tuple[str, ...]

    @property
    def probes(self) -> int:
        """Lists that a query reads unless it says otherwise."""
        return self.manifest.facts["probes"]

    @property
    def refined(self) -> int:
        """Codes that are looked at exactly for each result that is asked for."""
        return self.manifest.facts["refined"]

    def gone_after(self, k: int) -> tuple[DataFrame | None, int]:
        out, n = None, 0
        for s in self.manifest.facts["segments"][k + 1 :]:
            if s["n_gone"]:
                got = self.store.spark.read.parquet(s["gone"])
                out, n = got if out is None else out.unionByName(got), n + s["n_gone"]
        return out, n

    def live(self, name: str, lists: list[int] | None = None) -> DataFrame | None:
        """Rows of all segments, of some lists or all, without those that have gone or were replaced since."""
        out = None
        for k, s in enumerate(self.manifest.facts["segments"]):
            if not s["n"]:
                continue
            rows = self.store.spark.read.schema(StructType.fromJson(s["schema"][name])).parquet(s[name])
            rows = rows if lists is None else rows.where(F.col("list").isin(lists))
            gone, n = self.gone_after(k)
            if n:
                rows = rows.join(F.broadcast(gone) if n <= BROADCAST_ROWS else gone, list(self.key), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def files(self, lists: list[int] | None = None) -> int:
        """How many files of codes hold some lists (all without), by their folders' names."""
        names = [f for s in self.manifest.facts["segments"] if s["n"] for f in self.store.spark.read.parquet(s["codes"]).inputFiles()]
        return len(names) if lists is None else sum(any(f"/list={x}/" in f for x in lists) for f in names)

    def nearest_lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        gap = (self.model.centres**2).sum(1) - 2 * x @ self.model.centres.T
        return np.argsort(gap, 1, kind="stable")[:, :probes]


def _segment(store: Store, vectors: DataFrame, gone: DataFrame, model: Model, key: list[str]) -> dict:
    """Code the vectors where they are and write them by list."""
    rows = vectors.select(*key, "embedding")
    schema = StructType(list(rows.schema.fields)).add("list", "integer").add("code", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = unit(batch.column(batch.num_columns - 1).to_pylist(), model.dim)
            near, codes = model.coded(x) if len(x) else (np.zeros(0, int), np.zeros((0, len(model.books)), np.uint8))
            near = np.where(some, near, NOWHERE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], [*batch.schema.names, "list", "code"])

    coded, paths, schemas = rows.mapInArrow(run, schema), {}, {}
    for name, columns in (("codes", [*key, "code", "list"]), ("vectors", [*key, "embedding", "list"])):
        paths[name] = store.folder(name)
        part = coded.select(*columns)
        # Ranges of (list, key): a list that holds a great share of all vectors becomes several files.
        part.repartitionByRange("list", *key).sortWithinPartitions("list", *key).write.partitionBy("list").parquet(paths[name])
        schemas[name] = part.schema.jsonValue()
    paths["gone"] = store.written(gone.select(*key).distinct(), "gone")
    n = rows.count()
    return {**paths, "schema": schemas, "n": n, "n_gone": store.spark.read.schema(gone.select(*key).schema).parquet(paths["gone"]).count()}


def _tables(model: str, segments: list[dict]) -> dict[str, str]:
    return {"model": model} | {f"{name}-{k}": s[name] for k, s in enumerate(segments) for name in ("codes", "vectors", "gone")}


def build(vectors: DataFrame, path: str, lists: int | None = None, parts: int = PARTS, sample: int = SAMPLE, target: float = TARGET, seed: int = 7) -> VectorIndex:
    """Fit on at most ``sample`` vectors, code all, and commit the next generation at ``path``. ``vectors``: doc_id, chunk_index or not,
    embedding; keys unique and not null. Without ``lists`` there are as many as the root of the number of vectors, 4096 at most.
    Vectors without a direction are kept but never found; so is one of another length than the longest in the sample. How much a
    search reads is measured here (``target``): little where vectors stand in groups, most lists where they have no structure."""
    spark, key = vectors.sparkSession, [c for c in ("doc_id", "chunk_index") if c in vectors.columns]
    store, total = Store(spark, path), vectors.count()
    some = vectors.where("embedding is not null").select("embedding")
    drawn = (some.sample(fraction=min(1.0, 1.2 * sample / total), seed=seed) if total > sample else some).limit(sample).toArrow()
    # Columns of numbers: as Python's objects the sample would take eight times as much of the driver's memory.
    dim = max(pc.max(pc.list_value_length(drawn.column(0))).as_py() or 0, 1) if len(drawn) else 1
    parts_ = [unit(b.column(0).to_pylist(), dim) for b in drawn.to_batches(max_chunksize=ROWS)]
    x = np.concatenate([u for u, _ in parts_]) if parts_ else np.zeros((0, dim), np.float32)
    good = np.concatenate([g for _, g in parts_]) if parts_ else np.zeros(0, bool)
    del drawn, parts_
    x = x[good] if good.any() else np.eye(1, dim, dtype=np.float32)
    model = Model.fit(x, min(lists or max(1, int(total**0.5)), MOST_LISTS, len(x)), parts, seed)
    folder = store.written(spark.createDataFrame([(model.dumped(),)], "model binary"), "model")
    one = _segment(store, vectors, vectors.select(*key).where("false"), model, key)
    facts = {"segments": [one], "key": key, "probes": len(model.centres), "refined": 10}
    draft = VectorIndex(store, Manifest(0, _tables(folder, [one]), facts), model, tuple(key))
    facts |= measured(draft, vectors, total, target, seed)
    return opened(spark, path, store.commit(store.latest(), _tables(folder, [one]), facts))


def measured(index: VectorIndex, vectors: DataFrame, total: int, target: float, seed: int) -> dict:
    """How many lists, and how many codes for each result, give ``target`` of the true neighbours of some vectors, drawn apart from
    those of the fit: the rank of the neighbours' lists tells the first, trials the second."""
    name = vectors.select(F.monotonically_increasing_id().alias("query"), "embedding").where("embedding is not null")
    asked = (name.sample(fraction=min(1.0, 2 * ASKED / total), seed=seed + 1) if total > 2 * ASKED else name).limit(ASKED)
    rows = [r for r in asked.collect() if unit([r.embedding], index.model.dim)[1][0]]
    if not rows:
        return {}
    spark = index.store.spark
    asked = spark.createDataFrame([(k, [float(x) for x in r.embedding]) for k, r in enumerate(rows)], "query long, embedding array<double>")
    alike = vectors.where(F.size("embedding") == index.model.dim)
    want = exact(alike, asked, NEIGHBOURS).collect()
    true = spark.createDataFrame([tuple(r) for r in want], "query long, " + ", ".join(f"{c} long" for c in index.key) + ", distance double")
    held = {(r["query"], *(r[c] for c in index.key)): r["list"] for r in index.live("codes").select("list", *index.key).join(F.broadcast(true), list(index.key)).collect()}
    order = index.nearest_lists(unit([r.embedding for r in rows], index.model.dim)[0], len(index.model.centres))
    ranks = sorted(int(np.flatnonzero(order[q] == c)[0]) + 1 if c != NOWHERE else len(order[q]) for (q, *_), c in held.items())
    probes = ranks[min(len(ranks) - 1, int((1 + target) / 2 * len(ranks)))]
    refined = 5
    while refined < MOST_REFINED and recall(search(index, asked, NEIGHBOURS, probes, refined), true).first().recall < target:
        refined *= 2
    return {"probes": probes, "refined": refined}


def opened(spark: SparkSession, path: str, manifest: Manifest | None = None) -> VectorIndex:
    store = Store(spark, path)
    manifest = manifest or store.latest()
    if not manifest.facts:
        raise ValueError(f"there is no index at {path}")
    return VectorIndex(store, manifest, Model.loaded(bytes(store.table("model", manifest).first().model)), tuple(manifest.facts["key"]))


def updated(index: VectorIndex, put: DataFrame | None = None, gone: DataFrame | None = None) -> VectorIndex:
    """The next generation: ``put`` are new vectors or replace those of the same key, ``gone`` (the key) go. The model stays as it
    was fitted; ``build`` anew once the vectors are no longer like those of then. Conflict if another writer was faster."""
    spark, key = index.store.spark, list(index.key)
    blank = index.live("vectors")
    put = blank.drop("list").where("false") if put is None else put
    dropped = put.select(*key) if gone is None else put.select(*key).unionByName(gone.select(*key))
    segments = [*index.manifest.facts["segments"], _segment(index.store, put, dropped, index.model, key)]
    made = index.store.commit(index.manifest, _tables(index.manifest.tables["model"], segments), index.manifest.facts | {"segments": segments})
    return opened(spark, index.store.root, made)


def _ranked(model: Model, queries: np.ndarray, probed: list[set[int]], key: list[str], keep: int):
    """In each task: the ``keep`` best codes of each query among the rows that it sees, by looked-up inner products."""
    of_list: dict[int, np.ndarray] = {}
    for q, lists in enumerate(probed):
        for c in lists:
            of_list.setdefault(c, []).append(q)
    of_list = {c: np.array(qs) for c, qs in of_list.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [queries[:, r] @ b.T for r, b in zip(model.runs(), model.books, strict=True)]  # made here: they are much more than what they are made of
        near = queries @ model.centres.T
        best = [(np.zeros(0, np.float32), np.zeros((0, len(key) + 1), np.int64)) for _ in queries]
        for batch in batches:
            held = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column(len(key)).to_pylist()), np.uint8).reshape(-1, len(model.books))
            names = np.stack([*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(key))), held.astype(np.int64)], 1)
            for c in np.unique(held):
                qs, at = of_list.get(int(c)), np.flatnonzero(held == c)
                if qs is None:
                    continue
                s = near[qs, c][:, None] + sum(t[qs][:, codes[at, m]] for m, t in enumerate(tables))
                for q, row in zip(qs, s, strict=True):
                    top = np.argpartition(-row, min(keep, len(row)) - 1)[:keep]
                    scores, ids = np.concatenate([best[q][0], row[top]]), np.concatenate([best[q][1], names[at[top]]])
                    order = np.argsort(-scores, kind="stable")[:keep]
                    best[q] = scores[order], ids[order]
        for q, (scores, ids) in enumerate(best):
            cols = [pa.array(np.full(len(scores), q, np.int32)), pa.array(scores.astype(np.float32)), pa.array(ids[:, -1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(ids[:, k]) for k in range(len(key)))], ["q", "approx", "list", *key])

    return run


def _block(index: VectorIndex, queries: list[tuple], k: int, probes: int, refined: int, allowed: DataFrame | None) -> DataFrame:
    """(query, key, distance) of at most ``BLOCK`` queries."""
    spark, key = index.store.spark, list(index.key)
    x, some = unit([v for _, v in queries], index.model.dim)
    probed = [set(map(int, lists)) if ok else set() for lists, ok in zip(index.nearest_lists(x, probes), some, strict=True)]
    lists = sorted(set().union(*probed))
    codes, vectors = index.live("codes", lists), index.live("vectors", lists)
    asked = spark.createDataFrame([(q, int(name), [float(c) for c in v]) for q, ((name, _), v) in enumerate(zip(queries, x, strict=True))], "q int, query long, probe array<double>")
    if codes is None:
        return asked.where("false").select("query", *[F.lit(None).cast("long").alias(c) for c in key], F.lit(0.0).alias("distance"))
    if allowed is not None:
        codes = codes.join(allowed.select("doc_id"), "doc_id", "left_semi")
    found = codes.select(*key, "code", "list").mapInArrow(_ranked(index.model, x, probed, key, k * refined), "q int, approx float, list int, " + ", ".join(f"{c} long" for c in key))
    w = W.partitionBy("q").orderBy(F.desc("approx"), *key)
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k * refined).drop("rank", "approx")
    # At most BLOCK x k x refined keys. Few are broadcast, without their queries' vectors; else the lists' vectors are dealt out with them.
    few = len(queries) * k * refined <= BROADCAST_KEYS
    rows = vectors.join(F.broadcast(best) if few else best.hint("shuffle_hash"), ["list", *key]).join(F.broadcast(asked), "q")
    rows = rows.withColumn("distance", dense.distance(F.col("embedding"), F.col("probe")))
    w = W.partitionBy("query").orderBy("distance", *key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", *key, "distance")


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products of rows, component after component as in ``dense.dot``: the same for equal rows, wherever they stand."""
    out = np.zeros(len(x))
    for c in range(x.shape[1]):
        out += x[:, c] * y[:, c]
    return out


def _compared(probes: np.ndarray, names: np.ndarray, key: list[str], k: int):
    """In each task: the k nearest of each query among the rows that it sees, equals by key. Products by matrices tell which
    vectors may be among them, and exact distances of those decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.sqrt(_in_order(probes, probes))
        bound = np.full(len(probes), np.inf)
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(key)), np.int64)
        for batch in batches:
            held = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(key))], 1)
            vectors = batch.column(len(key)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), probes.shape[1])
            for s in range(0, len(held), ROWS):
                x, ids = vectors[s : s + ROWS], held[s : s + ROWS]
                length = np.sqrt(_in_order(x, x))
                found = []
                for t in range(0, len(probes), BLOCK):
                    gap = 1 - (probes[t : t + BLOCK] @ x.T) / norm[t : t + BLOCK, None] / length
                    limit = bound[t : t + BLOCK].copy()
                    many = np.flatnonzero((gap <= limit[:, None] + SLACK).sum(1) > k)
                    if len(many):
                        limit[many] = np.minimum(limit[many], np.partition(gap[many], k - 1, 1)[:, k - 1])
                    q, row = np.nonzero(gap <= limit[:, None] + SLACK)
                    for u in range(0, len(q), BLOCK * ROWS // 4):  # many at once only where many are equally near
                        a, b = q[u : u + BLOCK * ROWS // 4] + t, row[u : u + BLOCK * ROWS // 4]
                        found.append(_least(a, 1 - _in_order(x[b], probes[a]) / (length[b] * norm[a]), ids[b], k))
                best = _least(*(np.concatenate(c) for c in zip(best, *found, strict=True)), k)
                last = np.flatnonzero(np.bincount(best[0], minlength=len(probes)) == k)
                np.put(bound, last, best[1][np.searchsorted(best[0], last, "right") - 1])
        q, d, ids = best
        yield pa.RecordBatch.from_arrays([pa.array(names[q]), *(pa.array(ids[:, c]) for c in range(len(key))), pa.array(d)], ["query", *key, "distance"])

    return run


def _least(q: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each query by (distance, key), in order."""
    order = np.lexsort((*ids.T[::-1], d, q))
    q, d, ids = q[order], d[order], ids[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], d[kept], ids[kept]


def search_whole(index: VectorIndex, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query, key, distance): the k nearest of each of ``queries`` (query, embedding) among all live vectors, equals by key. Each vector
    is compared with each query where it is; a task keeps k of each. ``allowed`` and queries without a direction as in ``search``."""
    key, out = list(index.key), None
    kinds = "query long, " + ", ".join(f"{c} long" for c in key) + ", distance double"
    rows = index.live("vectors")
    if rows is None:
        return index.store.spark.createDataFrame([], kinds)
    rows = rows.where(F.col("list") != NOWHERE).select(*key, "embedding")
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    for block in _blocks(queries, PASS):
        some = unit([v for _, v in block], index.model.dim)[1]
        asked = [x for x, ok in zip(block, some, strict=True) if ok]
        if asked:
            got = rows.mapInArrow(_compared(np.array([v for _, v in asked], np.float64), np.array([q for q, _ in asked], np.int64), key, k), kinds)
            out = got if out is None else out.unionByName(got)
    if out is None:
        return index.store.spark.createDataFrame([], kinds)
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", *key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, refined: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(query, key, distance): about the k nearest of each of ``queries`` (query, embedding), exact distances. Queries pass by the driver
    in blocks, each a plan of its own. As many probes as lists, and as many refined as there are vectors, make the search exact;
    ``search_whole`` is so at any size. ``allowed`` (doc_id) restricts what is found. A query without a direction finds nothing."""
    probes, refined, out = probes or index.probes, refined or index.refined, None
    for block in _blocks(queries):
        got = _block(index, block, k, probes, refined, allowed)
        out = got if out is None else out.unionByName(got)
    return _block(index, [], k, probes, refined, allowed) if out is None else out


def nearest(index: VectorIndex, probes: list[list[float]], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """What ``dense.nearest`` gives, about: the least distance over the probes, of each one's k nearest."""
    asked = index.store.spark.createDataFrame([(q, [float(x) for x in p]) for q, p in enumerate(probes)], "query long, embedding array<double>")
    return search(index, asked, k, allowed=allowed).groupBy(*index.key).agg(F.min("distance").alias("distance"))


def _blocks(queries: DataFrame, size: int = BLOCK) -> Iterator[list[tuple]]:
    block = []
    for r in queries.select("query", "embedding").toLocalIterator():
        block.append((r["query"], r["embedding"]))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The true neighbours, for measuring: blocks of queries against all vectors, of which each task keeps k for each query."""
    key = [c for c in ("doc_id", "chunk_index") if c in vectors.columns]
    out, kinds = None, ", ".join(f"{c} long" for c in key)
    for block in _blocks(queries):
        probes = np.array([v for _, v in block], np.float64)
        names = [int(n) for n, _ in block]

        def run(batches: Iterator[pa.RecordBatch], probes=probes, names=names) -> Iterator[pa.RecordBatch]:
            norm = np.sqrt((probes**2).sum(1))
            best = [[] for _ in names]
            for batch in batches:
                keys = list(zip(*(batch.column(c).to_pylist() for c in range(len(key))), strict=True))
                x = np.array([v if v is not None else [0.0] * probes.shape[1] for v in batch.column(len(key)).to_pylist()], np.float64).reshape(-1, probes.shape[1])
                length = np.sqrt((x**2).sum(1))[None, :] * norm[:, None]
                gap = np.where(length > 0, 1 - probes @ x.T / np.where(length > 0, length, 1), 1.0)
                for q, row in enumerate(gap):
                    best[q] = sorted([*best[q], *((float(row[i]), keys[i]) for i in np.argsort(row, kind="stable")[:k])])[:k]
            rows = [(names[q], *name, d) for q, found in enumerate(best) for d, name in found]
            cols = [pa.array([r[c] for r in rows], pa.int64()) for c in range(1 + len(key))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[-1] for r in rows], pa.float64())], ["query", *key, "distance"])

        got = vectors.select(*key, "embedding").mapInArrow(run, f"query long, {kinds}, distance double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.select(F.lit(0).cast("long").alias("query"), *key, F.lit(0.0).alias("distance")).where("false")
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", *key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def recall(found: DataFrame, want: DataFrame) -> DataFrame:
    """One row: (queries, recall), the share of the true neighbours that were found."""
    key = [c for c in want.columns if c != "distance"]
    hit = want.select(*key).join(found.select(*key).withColumn("hit", F.lit(1)), key, "left")
    return hit.agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))

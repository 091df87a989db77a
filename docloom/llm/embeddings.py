"""Near-duplicate embeddings by an inverted multi-index.

Each half of a vector has a codebook of its own, fitted on a bounded sample; a vector's cell is its pair of nearest
centroids. A query walks the grid of cells from the nearest on (multi-sequence traversal) as far as a sample of true
pairs shows to be needed for the target recall, and what it meets is verified by cosine in double precision.

Pairs are never stored. A pair is counted in one cell only, and a task that compares two blocks of vectors emits, for each
vector that has links there, how many it found and the least vector that they connect it to.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import held, joined, mapped, saved
from docloom.llm._components import connected, smallest

#: The bounds on fitting: rows to fit codebooks on, rows whose true pairs set the traversal, partners of each, centroids of a half.
FIT_ROWS, RECALL_ROWS, PARTNERS, MOST_CENTROIDS = 16_384, 1_024, 8, 1_024
#: With more cells to visit than this, coarser codebooks are taken; those of one centroid compare everything.
MOST_CELLS = 256
#: Vectors of a block: a fuller cell is dealt out as pairs of blocks of index rows and of queries.
BLOCK = 2_048


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means; a centroid that loses all its rows is moved to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1) - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(1)))
        for slot, row in zip(np.flatnonzero(n == 0), far, strict=False):
            c[slot] = x[row]
    return c


def traverse(a: np.ndarray, b: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cells in the order of a[i] + b[j], by a heap: (i, j) is entered once its neighbours before it are out."""
    i_order, j_order = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out = [(a[i_order[0]] + b[j_order[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < most:
        _, i, j = heapq.heappop(heap)
        out.append((int(i_order[i]), int(j_order[j])))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (a[i_order[p]] + b[j_order[q]], p, q))
    return out


def rank(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many cells are at most as far as (i, j): so many visits are sure to reach it."""
    return int(np.searchsorted(np.sort(b), a[i] + b[j] - a + 1e-12, side="right").sum())


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one length, scaled to length 1; first by their greatest component, so that no square overflows."""
    if not len(column):
        return np.zeros((0, 0))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class MultiIndex:
    first: np.ndarray
    second: np.ndarray
    cells: int
    recall: float = 1.0  # of the sampled pairs, at this number of cells

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return tuple(((v * v).sum(1)[:, None] - 2 * v @ c.T + (c * c).sum(1)) for v, c in ((x[:, :h], self.first), (x[:, h:], self.second)))

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each vector (id, n, v) its index row, with the cells it visits, and a probe row for each of those, with its own cell."""
        for batch in batches:
            x = unit(batch.column(2))
            a, b = self.distances(x)
            walks = [np.array([i * len(self.second) + j for i, j in traverse(a[k], b[k], self.cells)], np.int32) for k in range(len(x))]
            own = np.array([w[0] for w in walks], np.int32)
            at = np.repeat(np.arange(len(x)), [len(w) for w in walks])
            none = np.zeros(0, np.int32)
            for probe, take, cell, home, visits in ((False, np.arange(len(x)), own, own, walks), (True, at, np.concatenate(walks), own[at], [none] * len(at))):
                id_, n, v = (batch.column(k).take(pa.array(take)) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(take), probe)), id_, n, v, pa.array(home), pa.array(visits, pa.list_(pa.int32()))], [c.split()[0] for c in CELLS.split(", ")])


CELLS = "cell int, probe boolean, id long, n long, v array<double>, home int, visits array<int>"
FOUND = "id long, links long, root long"


def _linked(a: dict, b: dict, least: float) -> Iterator[np.ndarray]:
    """Compare index rows ``a`` with probe rows ``b`` of one cell: (id, members of linked classes, least id connected).

    A pair whose two rows meet each other in both their cells is counted where the query has the smaller id.
    """
    near = b["x"] @ a["x"].T >= least
    p, i = np.nonzero(near)
    both = b["home"][p] == a["home"][i]
    rest = np.flatnonzero(~both)
    both[rest] = [h in a["visits"][k] for h, k in zip(b["home"][p[rest]].tolist(), i[rest].tolist(), strict=True)]
    keep = (b["id"][p] != a["id"][i]) & (~both | (b["id"][p] < a["id"][i]))
    p, i = p[keep], i[keep]
    if not len(p):
        return
    ids = np.concatenate([b["id"], a["id"]])
    i = i + len(b["id"])
    links = np.bincount(p, a["n"][i - len(b["id"])], len(ids)) + np.bincount(i, b["n"][p], len(ids))
    root = ids.copy()
    while True:  # the least id spreads along links
        low = root.copy()
        np.minimum.at(low, p, root[i])
        np.minimum.at(low, i, low[p])
        if (low == root).all():
            break
        root = low
    some = np.flatnonzero(links)
    yield np.stack([ids[some], links[some].astype(np.int64), root[some]])


def _compare(least: float):
    """Verify within each bucket of a stream sorted by (bucket, probe): its index rows come first and are held as vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, whole = None, [], None
        for batch in batches:
            buckets, probe, ids, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            x, home = unit(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((buckets[1:] != buckets[:-1]) | (probe[1:] != probe[:-1])) + 1
            found = []
            for s, e in zip([0, *cuts], [*cuts, len(buckets)], strict=True):
                if buckets[s] != bucket:
                    bucket, parts, whole = buckets[s], [], None
                part = {"id": ids[s:e], "n": n[s:e], "x": x[s:e], "home": home[s:e]}
                if not probe[s]:
                    parts.append(part | {"visits": [set(w) for w in batch.column(6).slice(s, e - s).to_pylist()]})
                elif parts:
                    if whole is None:
                        whole = {k: sum((y[k] for y in parts), []) if k == "visits" else np.concatenate([y[k] for y in parts]) for k in parts[0]}
                    found += _linked(whole, part, least)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(found, 1)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def _near_sample(sample_ids: np.ndarray, sample: np.ndarray, least: float):
    """Partners of the sampled rows among all: of each up to ``PARTNERS`` of a batch, the first by a hash of their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, order = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            s, k = np.nonzero(sample @ unit(batch.column(2)).T >= least)
            keep = sample_ids[s] != ids[k]
            s, k = s[keep], k[keep]
            by = np.lexsort((ids[k], order[k], s))
            s, k = s[by], k[by]
            turn = np.arange(len(s)) - np.searchsorted(s, s)
            s, k = s[turn < PARTNERS], k[turn < PARTNERS]
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(3).take(pa.array(k)), batch.column(0).take(pa.array(k)), batch.column(2).take(pa.array(k))], ["s", "h", "id", "v"])

    return run


def fit(vectors: DataFrame, least: float, target: float, n: int) -> MultiIndex:
    """Codebooks from at most ``FIT_ROWS`` rows, the first by a hash of their id, and the number of cells to visit.

    That number is the least at which the share ``target`` is met of true pairs, from one side or the other. The pairs are
    those between at most ``RECALL_ROWS`` rows, drawn by another hash, and partners found by comparing them with all rows;
    where there is none, random directions at just the cosine ``least`` from these rows stand for them. Codebooks get
    coarser until ``MOST_CELLS`` are enough; with one centroid a half, everything is compared with everything.
    """

    def sample(seed: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        h = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30))
        some = vectors.where(h <= int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 30))).orderBy(h, "id").limit(most).select("id", "v").toArrow().combine_chunks()
        return some.column(0).to_numpy(), unit(some.column(1).combine_chunks())

    x, (ids, some) = sample(23, FIT_ROWS)[1], sample(31, RECALL_ROWS)
    hashed = vectors.select("id", "n", "v", F.xxhash64("id", F.lit(37)).alias("h"))
    # At most PARTNERS rows of each sampled row come back.
    near = mapped(hashed, _near_sample(ids, some, least), "s long, h long, id long, v array<double>", 2_000)
    near = near.selectExpr("*", "row_number() over (partition by s order by h, id) as turn").where(F.col("turn") <= PARTNERS).orderBy("s", "turn").toArrow().combine_chunks()
    if near.num_rows:
        q, o = some[near.column("s").to_numpy()], unit(near.column("v").combine_chunks())
    else:
        side = np.random.default_rng(5).normal(size=some.shape)
        side -= (side * some).sum(1, keepdims=True) * some
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)
        q, o = some, least * some + np.sqrt(max(0.0, 1 - least * least)) * side
    half = max(1, x.shape[1] // 2)
    k = 2 ** int(np.clip(np.ceil(np.log2(max(np.sqrt(n / 16), 1))), 0, np.log2(MOST_CENTROIDS)))
    while True:
        index = MultiIndex(centroids(x[:, :half], k), centroids(x[:, half:], k), 1)
        ranks = []
        for one, other in ((q, o), (o, q)):
            (a, b), (c, d) = index.distances(one), index.distances(other)
            ranks.append([rank(a[r], b[r], c[r].argmin(), d[r].argmin()) for r in range(len(one))])
        need = np.sort(np.minimum(*map(np.array, ranks)))
        index.cells = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])
        index.recall = float((need <= index.cells).mean())
        if index.cells <= MOST_CELLS or k == 1:
            return index
        k //= 2


def _found(vectors: DataFrame, index: MultiIndex, least: float) -> DataFrame:
    """(id, links, root): what comparing the blocks of each cell found of each vector there."""
    cells = saved(mapped(vectors.select("id", "n", "v"), index.rows, CELLS, 1_000), "cells")
    size = cells.groupBy("cell").agg(F.count_if(~F.col("probe")).alias("a"), F.count_if("probe").alias("b"))
    # One row for each cell, at most MOST_CENTROIDS squared: a proven bound, so it may be broadcast.
    size = size.where("a > 0").select("cell", F.ceil(F.col("a") / BLOCK).cast("int").alias("a"), F.ceil(F.col("b") / BLOCK).cast("int").alias("b"))
    dealt = cells.join(F.broadcast(size), "cell")
    h = F.xxhash64("id", F.lit(29))
    mine = F.when(F.col("probe"), F.pmod(h, F.col("b"))).otherwise(F.pmod(h, F.col("a")))
    dealt = dealt.withColumn("mine", mine.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("probe"), F.col("a")).otherwise(F.col("b")) - 1)))
    block = F.when(F.col("probe"), F.struct("cell", F.col("other").alias("i"), F.col("mine").alias("q"))).otherwise(F.struct("cell", F.col("mine").alias("i"), F.col("other").alias("q")))
    bucket = (block["cell"].cast("decimal(38,0)") * (1 << 31) + block["i"]) * (1 << 31) + block["q"]
    dealt = dealt.select(bucket.cast("string").alias("bucket"), "probe", "id", "n", "v", "home", "visits")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "probe", "id")
    return saved(mapped(dealt, _compare(least), FOUND, BLOCK), "found")


def near_duplicates(table: DataFrame, least: float = 0.9, target: float = 0.999) -> DataFrame:
    """One row per row of ``table`` (vec_id, embedding): (vec_id, n_links, component_id, kept).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. Vectors are compared with
    those of their own length, each length by an index of its own. Equal vectors are one class: found links between classes
    are counted with their members, never expanded. component_id is the smallest vec_id reachable, the vector's own
    included; kept marks the row that has it. Rows that repeat a vec_id and vector count each other as links. A null vec_id
    takes its component's smallest vec_id. An empty table gives an empty result. The result depends on the rows alone.
    """
    v = F.col("embedding").cast("array<double>")
    raw = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    raw = raw.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("fine", fine)  # -0 is 0
    seed = 0
    while True:  # until no two different vectors share a hash
        keyed = raw.withColumn("id", F.when(F.col("fine"), F.xxhash64(F.col("v"), F.lit(seed))))
        classes = saved(keyed.where("fine").groupBy("id", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.count("*").alias("held")), "classes")
        if held(classes, "id").where("held > 1").isEmpty():
            break
        seed += 1
    rows = saved(keyed.select("vec_id", "id"), "rows")
    found = None
    for size in sorted((r.d, r.n) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()):
        same = classes.where(F.size("v") == size[0])
        got = _found(same, fit(same, least, target, size[1]), least)
        found = got if found is None else found.unionByName(got)
    if found is None:
        found = table.sparkSession.createDataFrame([], FOUND)
    roots = saved(connected(found.where("id <> root").select("id", "root").distinct()), "roots")
    moved = smallest(roots, classes.select(F.col("id").alias("node"), "least"))
    links = found.groupBy("id").agg(F.sum("links").alias("beyond"))
    info = classes.join(moved.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left")
    info = info.select("id", F.coalesce("component", "least").alias("c"), (F.col("n") - 1 + F.coalesce("beyond", F.lit(0))).alias("l"), "held")
    out = joined(rows, saved(info, "info"), "id", rows.count(), "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

"""SimHash near-duplicates, found by a generalised pigeonhole search over bit partitions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import fresh, held, id_and_text, joined, mapped, saved
from docloom.llm._components import connected

SEED = 42
BITS = 64
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words (ASCII lower case, ASCII white space), repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
    starts = [0] + [e + 1 for e in ends[:-1]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. Bits are counted in byte lanes, at most 255 hashes at a time."""
    n = len(hashes)
    if not n:
        return 0
    starts = np.arange(0, n, 255)
    out = 0
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        for byte, c in enumerate(lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)):
            if 2 * int(c) > n:
                out |= 1 << (8 * byte + k)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and wordless texts have fingerprint zero."""
    return mapped(id_and_text(docs), _fingerprints, "doc_id long, fp long")


# --- generalised pigeonhole -------------------------------------------------------------------------------------
#
# Split the bits into m parts and give part i the threshold t_i >= -1 with sum(t_i) = radius - m + 1. Two fingerprints
# within the radius then agree to within t_i bits in some part i (else they would differ in sum(t_i + 1) = radius + 1
# bits at least). A part with t_i = -1 is not probed. The vector may be chosen anew for each query.


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of nearly equal width; each takes the free bits most correlated with those it has already."""
    strength = np.abs(np.nan_to_num(corr)) - 2 * np.eye(len(corr))
    free, parts = set(range(len(corr))), []
    for k in range(m):
        width = (len(corr) * (k + 1)) // m - (len(corr) * k) // m
        pool = sorted(free)
        part = [max(pool, key=lambda b: (strength[b, pool].max(), -b))]
        while len(part) < width:
            pool = sorted(free - set(part))
            part.append(max(pool, key=lambda b: (strength[b, part].mean(), -b)))
        free -= set(part)
        parts.append(part)
    return parts


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def _pieces(part: list[int]) -> list[list[int]]:
    """A part's bits in runs of at most eight, each small enough for a full histogram."""
    return [part[k : k + 8] for k in range(0, len(part), 8)]


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        x = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
        total += (x.T @ x).astype(np.int64)
    i, j = np.divmod(np.arange(BITS * BITS), BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "n"])


class Pigeonhole:
    """Parts, their histograms, and the choice of thresholds for each query."""

    #: What one probe costs, against one candidate that is verified.
    PROBE_COST = 4.0

    def __init__(self, parts: list[list[int]], tables: list[list[np.ndarray]], n: int, radius: int):
        self.parts, self.tables, self.n, self.radius = parts, tables, n, radius

    def estimated(self, bits: np.ndarray, k: int) -> np.ndarray:
        """For part k: estimated fingerprints within 0, 1, ... radius bits of each query, taking a part's pieces as independent."""
        dist = np.zeros((len(bits), self.radius + 1))
        dist[:, 0] = 1
        for piece, table in zip(_pieces(self.parts[k]), self.tables[k], strict=True):
            near = table[_values(bits, piece)]
            new = np.zeros_like(dist)
            for d in range(self.radius + 1):
                new[:, d:] += near[:, d : d + 1] * dist[:, : self.radius + 1 - d]
            dist = new
        return self.n * dist.cumsum(1)

    def allocate(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds of each query for each part, and their estimated cost, by dynamic programming over the parts."""
        m, r = len(self.parts), self.radius
        total = r - m + 1 + m  # each part spends t_i + 1
        best = np.full((len(bits), total + 1), np.inf)
        best[:, 0] = 0
        picks = []
        for k, part in enumerate(self.parts):
            near = self.estimated(bits, k)
            probes = np.cumsum([len(list(combinations(range(len(part)), d))) for d in range(r + 1)])
            new = best.copy()
            pick = np.zeros(best.shape, np.int8)
            for spend in range(1, total + 1):
                cost = best[:, : total + 1 - spend] + (self.PROBE_COST * probes[spend - 1] + near[:, spend - 1])[:, None]
                better = cost < new[:, spend:]
                new[:, spend:] = np.where(better, cost, new[:, spend:])
                pick[:, spend:] = np.where(better, spend, pick[:, spend:])
            picks.append(pick)
            best = new
        left, out = np.full(len(bits), total), np.zeros((len(bits), m), np.int8)
        for k in range(m - 1, -1, -1):
            spend = picks[k][np.arange(len(bits)), left]
            out[:, k], left = spend - 1, left - spend
        return out, best[:, total]

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index rows (probe false) and probe rows of each fingerprint, keyed by part and value."""
        masks = [[[sum(1 << b for b in c) for d in range(t + 1) for c in combinations(range(len(p)), d)] for t in range(self.radius + 1)] for p in self.parts]
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            bits = _bits(fps.view(np.uint64))
            thresholds, _ = self.allocate(bits)
            keys, ids, probe = [], [], []
            for k, part in enumerate(self.parts):
                value = _values(bits, part)
                keys.append((k << 40) + value)
                ids.append(fps)
                probe.append(np.zeros(len(fps), bool))
                for t in range(self.radius + 1):
                    at = np.flatnonzero(thresholds[:, k] == t)
                    if len(at):
                        flips = np.array(masks[k][t], np.int64)
                        keys.append(((k << 40) + (value[at, None] ^ flips[None, :])).ravel())
                        ids.append(np.repeat(fps[at], len(flips)))
                        probe.append(np.ones(len(at) * len(flips), bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(probe))], ["key", "fp", "probe"])


def _histograms(pieces: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(pieces), 256), np.int64)
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for k, piece in enumerate(pieces):
                counts[k] += np.bincount(_values(bits, piece), minlength=256)
        k, v = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.array(counts[k, v])], ["k", "v", "n"])

    return run


def plan(fps: DataFrame, radius: int, tries: tuple[int, ...] = (2, 3, 4)) -> Pigeonhole:
    """Choose parts and gather their histograms over all distinct fingerprints.

    What reaches the driver does not grow with the input: 64 x 64 moments, and 256 counts for each run of eight bits.
    The number of parts is the one of least estimated cost over up to 2,000 fingerprints; it changes the speed, never
    the result.
    """
    got = fps.mapInArrow(_moments, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for i, j, c in got:
        both[i, j] = c
    sample = np.array([r[0] for r in fps.limit(2000).collect()], np.int64).view(np.uint64)
    n = fps.count()
    p = both.diagonal() / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = (both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    splits = {m: group_bits(corr, m) for m in tries if m <= radius + 1}
    pieces = [x for parts in splits.values() for part in parts for x in _pieces(part)]
    counts = np.zeros((len(pieces), 256))
    for k, v, c in fps.mapInArrow(_histograms(pieces), "k long, v long, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        counts[k, v] = c
    away = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    tables = [np.stack([(away == d) @ c / max(n, 1) for d in range(radius + 1)], 1) for c in counts]
    best = None
    for parts in splits.values():
        of = [[tables.pop(0) for _ in _pieces(part)] for part in parts]
        hole = Pigeonhole(parts, of, n, radius)
        cost = hole.allocate(_bits(sample))[1].mean() if len(sample) else 0
        if best is None or cost < best[0]:
            best = (cost, hole)
    return best[1]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a < b) of the distinct fingerprints in ``fps`` (one long column) that differ in at most ``radius`` bits."""
    hole = plan(fps, radius)
    rows = saved(mapped(fps, hole.rows, "key long, fp long, probe boolean", 4_000), "pigeonhole")
    index = rows.where("not probe").select("key", F.col("fp").alias("b"))
    probes = rows.where("probe").select("key", F.col("fp").alias("a"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.alias("p").join(index.alias("i"), (F.col("p.key") == F.col("i.key")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: (doc_id, fp, component_id).

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable, the
    document's own included. Copies share a fingerprint and so one node: they are never expanded into pairs. Null
    and empty texts have fingerprint zero and link like any other. Repeated rows come out once each. A null doc_id
    takes its component's smallest doc_id (null if there is none). An empty table gives an empty result.
    """
    fps = saved(fingerprints(docs), "fingerprints")
    classes = _components(fps.select(F.col("doc_id").alias("of"), "fp"), radius)
    least = saved(classes.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("held")), "component")
    classes = joined(classes.withColumnRenamed("held", "rows"), least, "root", classes.count()).select("fp", "component_id", F.col("rows").alias("held"))
    return joined(fps, saved(classes, "classes"), "fp", fps.count()).select("doc_id", "fp", "component_id")


def _components(fps: DataFrame, radius: int) -> DataFrame:
    """A written table (fp, first, held, root): of each fingerprint in ``fps`` (of, fp) the least ``of``, how many rows have
    it, and the fingerprint that stands for its component."""
    classes = saved(fps.groupBy("fp").agg(F.min("of").alias("first"), F.count("*").alias("held")), "classes")
    roots = connected(links(classes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return saved(classes.join(roots, "fp", "left").select("fp", "first", "held", F.coalesce("root", "fp").alias("root")), "components")


def as_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Most rows to leave out that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in batch.column(2).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["d", "k", "fp"])


def one_of_each(docs: DataFrame, radius: int = 3) -> DataFrame:
    """The rows of ``docs``, all their columns as they were: of each component one stays.

    It is the first by doc_id (null last), then by a hash of id and text. Rows that equal it in doc_id and text are copies
    of it, and one of them stays; rows that share a doc_id only are different documents. Null and empty texts are one
    component. An empty table gives an empty result.
    """
    name = fresh(docs, "row_key")
    id_, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    key = F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.when(text.isNull(), "-").otherwise("+"), F.coalesce(text, F.lit("")))))
    rows = docs.select(id_.alias("d"), key.alias("k"), text.cast("binary").alias("t"))
    fps = saved(mapped(rows, _keyed_fingerprints, "d long, k binary, fp long"), "fingerprints")
    of = F.struct(F.col("d").isNull().alias("n"), F.col("d"), F.col("k"))
    classes = _components(fps.select(of.alias("of"), "fp"), radius)
    first = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k").alias("k"))
    gone = saved(fps.select("k").distinct().join(first, "k", "left_anti"), "gone")
    twice = saved(held(fps.select("k"), "k").where("held > 1").join(first, "k", "left_semi").select("k"), "twice")
    few = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    keyed = docs.withColumn(name, key)
    out = keyed.join(few(gone.withColumnRenamed("k", name)), name, "left_anti")
    if not twice.isEmpty():
        again = few(twice.withColumnRenamed("k", name))
        out = out.join(again, name, "left_anti").unionByName(out.join(again, name, "left_semi").dropDuplicates([name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

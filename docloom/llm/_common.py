"""Shared plumbing: table access, scratch tables in the shared folder, joins on skewed keys, fresh column names."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python function gets at once. Spark's own batches end at a number of bytes; texts as Python objects take more.
ARROW_ROWS = 512
#: Keys that ``joined`` may broadcast, and the fewest rows that make a key one of them.
MOST_HOT, LEAST_HOT = 100_000, 200

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, f: Callable[[Batches], Batches], schema: str, rows: int = ARROW_ROWS) -> DataFrame:
    """``df.mapInArrow``, in slices of at most ``rows`` rows; no setting of the session is touched."""

    def run(batches: Batches) -> Batches:
        yield from f(b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows))
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give back what a task has freed: workers are kept from task to task, and would keep the greatest share that any of them took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_own_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the session. A folder of our own, removed at the end, only where none is set and the
    master is local: a cluster's executors would not see each other's files there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_root:
            _own_root.append(tempfile.mkdtemp(prefix="docloom-"))
            atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
        root = "file://" + _own_root[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    where, fs = _fs(spark, path)
    fs.deleteOnExit(where)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here. ``codec``: where not the session's."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more, and let the driver see that the shuffles behind them can go: executors
    delete shuffle files only when the driver has collected what refers to them, which it seldom does by itself."""
    for df in frames:
        if path := getattr(df, "_docloom_path", None):
            where, fs = _fs(df.sparkSession, path)
            fs.delete(where, True)
    if frames:
        unreferenced(frames[0].sparkSession)


def unreferenced(spark: SparkSession) -> None:
    """Let the driver see which shuffles nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def joined(rows: DataFrame, facts: DataFrame, on: str | list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for each key and in ``held`` how many of ``rows`` have it.

    Keys of more than total / 100,000 rows, of which there can be no more than 100,000, are looked up in a broadcast table,
    so their rows stay where they are; in the shuffle of the others no key has more rows than that. ``how`` is inner or
    left; rows with a null key match nothing and are not shuffled either. Both tables should be written ones: they are read twice.
    """
    on = [on] if isinstance(on, str) else on
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot, cold = facts.where(F.col("held") > limit).drop("held"), facts.where(F.col("held") <= limit).drop("held")
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    some, lone = rows.where(~null), rows.where(null)
    out = some.join(F.broadcast(hot), on)
    out = out.unionByName(some.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how))
    return out.unionByName(lone, allowMissingColumns=True) if how == "left" else out


def held(rows: DataFrame, on: str | list[str]) -> DataFrame:
    """How many of ``rows`` have each key, pre-aggregated before the shuffle."""
    on = [on] if isinstance(on, str) else on
    return rows.groupBy(*on).agg(F.count("*").alias("held"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and the text's UTF-8 bytes; other columns, whatever their names, do not come along."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

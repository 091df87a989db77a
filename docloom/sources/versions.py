"""Tables in generations: immutable folders of data, and a manifest that names those of one generation.

A generation becomes current when its manifest appears under its number, in one step that fails if the number is taken. Of two
writers that start from the same generation one wins; the other gets ``Conflict`` and has changed nothing that readers
see. Readers take the manifest of the highest number, and everything it names is complete and never changes.

The step is a hard link where the folder is a mounted one, and a rename that refuses to replace elsewhere, which HDFS does in one
step. Stores without such a rename (plain S3) need a committer of their own.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Attempts of a change that loses against others.
TRIES = 5


class Conflict(RuntimeError):
    """Another writer has committed this generation."""


@dataclass(frozen=True)
class Manifest:
    """``tables`` maps names to the folders that hold them; ``facts`` is whatever else belongs to the generation."""

    generation: int
    tables: dict[str, str] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    committed_at: float = 0.0


class Store:
    """A folder of generations."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where, fs = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def _read(self, path: str) -> str:
        where, fs = self._path(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def generations(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def at(self, generation: int) -> Manifest:
        return Manifest(**json.loads(self._read(f"{self.root}/manifests/{generation:012d}.json")))

    def latest(self) -> Manifest:
        """Generation 0, which has no tables, is there from the start."""
        known = self.generations()
        return self.at(known[-1]) if known else Manifest(0)

    def folder(self, name: str) -> str:
        """A new folder for a table, never used again."""
        return f"{self.root}/data/{name}-{uuid.uuid4().hex}"

    def written(self, df: DataFrame, name: str) -> str:
        """Written to a new folder. Executors delete what was shuffled for it once the driver has collected what refers to it."""
        path = self.folder(name)
        df.write.parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return path

    def removed(self, folders: list[str]) -> None:
        """Delete folders that no manifest names and nothing reads any more."""
        for path in folders:
            where, fs = self._path(path)
            fs.delete(where, True)

    def commit(self, base: Manifest, tables: dict[str, str], facts: dict | None = None) -> Manifest:
        """The generation after ``base``. Conflict if there is one already."""
        new = Manifest(base.generation + 1, tables, facts or {}, time.time())
        target = f"{self.root}/manifests/{new.generation:012d}.json"
        draft, fs = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        fs.mkdirs(self._path(f"{self.root}/manifests")[0])
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new.__dict__, sort_keys=True).encode()))
        out.close()
        try:
            self._appear(draft, target)
        finally:
            fs.delete(draft, False)
        return new

    def _appear(self, draft, target: str) -> None:
        where, fs = self._path(target)
        uri = fs.makeQualified(where).toUri()
        if uri.getScheme() == "file":
            try:
                os.link(fs.makeQualified(draft).toUri().getPath(), uri.getPath())
            except FileExistsError as e:
                raise Conflict(target) from e
            return
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, where, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(target) from e
            raise

    def changed(self, change: Callable[[Manifest], tuple[dict[str, str], dict]], tries: int = TRIES) -> Manifest:
        """Commit what ``change`` makes of the latest generation; made anew from the next one where another writer was faster."""
        for k in range(tries):
            base = self.latest()
            try:
                return self.commit(base, *change(base))
            except Conflict:
                if k == tries - 1:
                    raise
        raise AssertionError

    def table(self, name: str, manifest: Manifest | None = None) -> DataFrame:
        return self.spark.read.parquet((manifest or self.latest()).tables[name])

    def pruned(self, keep: int = 2, grace: float = 3600.0) -> list[str]:
        """Delete all but the last ``keep`` generations and the folders that none of these names, if older than ``grace`` seconds:
        a folder that no manifest names yet may be a writer's. Returns what was deleted."""
        known = self.generations()
        old, kept = known[: max(0, len(known) - keep)], known[-keep:]
        needed = {p.rpartition("/")[2] for g in kept for p in _folders(self.at(g))}
        gone, now = [], time.time()
        for g in old:
            where, fs = self._path(f"{self.root}/manifests/{g:012d}.json")
            fs.delete(where, False)
            gone.append(where.getName())
        for name in self._names("data"):
            where, fs = self._path(f"{self.root}/data/{name}")
            if name not in needed and fs.getFileStatus(where).getModificationTime() / 1000 <= now - grace:
                fs.delete(where, True)
                gone.append(name)
        return gone


def _folders(manifest: Manifest) -> list[str]:
    return list(manifest.tables.values())

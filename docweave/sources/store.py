"""Versioned tables: an immutable root and deltas of changed rows, named by an atomically published manifest.

A change of k rows writes k rows: a delta holds the newest row of each key that a commit changed, or a
tombstone, and is only ever added. Readers merge on read (root anti-join the deltas' keys, union the newest
living rows); deltas are folded into one once there are many, and into a new root once they have grown past
a share of it. Roots are sorted by key within files, with Parquet's bloom filters on the key and the foreign
keys, so that reads of a few keys skip the rest. A commit is one small JSON file made exclusively, so two
writers of the same version conflict instead of overwriting, and readers never see half a commit. Files
go through Spark and Hadoop's file systems only, so any store that Spark can write holds them.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import EngineError, LockConflict

GONE = "_gone"
#: Changed keys that a read may broadcast against its root; more are left to the optimiser.
BROADCAST_KEYS = 100_000
#: Deltas that are read one by one before they are folded.
MOST_DELTAS = 6


def workspace(spark: SparkSession) -> str:
    """A fresh folder in the shared folder of the session; a local session without one gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


class Files:
    """Small files by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        if "://" in name:
            return self.jvm.org.apache.hadoop.fs.Path(name)
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def size(self, name: str) -> int:
        """Bytes under a path."""
        path = self._path(name)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def read(self, name: str) -> dict | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, value) -> bool:
        """Writes beside and renames; False if the name is taken."""
        target, beside = self._path(name), self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        if self.fs.exists(target):
            return False
        stream = self.fs.create(beside, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        done = self.fs.rename(beside, target)
        if not done:
            self.fs.delete(beside, False)
        return bool(done)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


@dataclass(frozen=True)
class Delta:
    """Rows that one or more commits changed. ``frame``: those of an open transaction that are not written yet."""

    rows: int
    path: str | None = None
    frame: DataFrame | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Versioned:
    """A table of unique ``pk``: where its root and deltas are, oldest first. ``schema``: JSON of the root's.
    ``filled``: when all rows of the root were made, if at one time."""

    name: str
    pk: str
    root: str
    schema: str | None = None
    deltas: tuple[Delta, ...] = ()
    root_rows: int | None = None
    filters: tuple[str, ...] = ()
    filled: str | None = None

    @staticmethod
    def of(spark: SparkSession, name: str, pk: str, root: str, filters: tuple[str, ...] = ()) -> Versioned:
        return Versioned(name, pk, root, spark.read.parquet(root).schema.json(), filters=filters)

    @staticmethod
    def from_dict(d: dict) -> Versioned:
        return Versioned(**{**d, "deltas": tuple(Delta(x["rows"], x["path"]) for x in d["deltas"]), "filters": tuple(d["filters"])})

    def as_dict(self) -> dict:
        return {"name": self.name, "pk": self.pk, "root": self.root, "schema": self.schema, "deltas": [{"rows": d.rows, "path": d.path} for d in self.deltas], "root_rows": self.root_rows, "filters": list(self.filters), "filled": self.filled}

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))

    def changed(self) -> int:
        """Rows of all deltas; keys may repeat."""
        return sum(d.rows for d in self.deltas)

    def overlay(self, spark: SparkSession) -> DataFrame | None:
        """The newest row or tombstone of every changed key."""
        struct = self.struct
        whole = T.StructType([*struct.fields, T.StructField(GONE, T.BooleanType())])
        out = None
        for i, d in enumerate(self.deltas):
            # aliases: a table that a plan reads twice has other attributes each time
            part = (d.frame if d.frame is not None else spark.read.schema(whole).parquet(d.path)).select(*[F.col(c).alias(c) for c in whole.names], F.lit(i).alias("_seq"))
            out = part if out is None else out.unionByName(part)
        if out is None or len(self.deltas) == 1:
            return None if out is None else out.drop("_seq")
        newest = out.groupBy(self.pk).agg(F.max_by(F.struct(*[c for c in whole.names if c != self.pk]), "_seq").alias("_row"))
        return newest.select(*[F.col(c) if c == self.pk else F.col("_row")[c].alias(c) for c in whole.names])

    def current(self, spark: SparkSession) -> DataFrame:
        root = spark.read.schema(self.struct).parquet(self.root)
        over = self.overlay(spark)
        if over is None:
            return root
        keys = over.select(self.pk)
        kept = root.join(F.broadcast(keys) if self.changed() <= BROADCAST_KEYS else keys, self.pk, "left_anti").select(*root.columns)
        # named anew: a correlated subquery over a bare union is more than the optimiser takes
        return kept.unionByName(over.where(~F.col(GONE)).select(*root.columns)).select(*[F.col(c).alias(c) for c in root.columns])

    def delta(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        """``rows`` to put and the keys of ``gone`` to remove as the rows of a delta."""
        columns = self.struct
        new = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]).withColumn(GONE, F.lit(False))
        none = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name == self.pk else F.lit(None).cast(f.dataType).alias(f.name) for f in columns]
        return new.unionByName(gone.select(self.pk).distinct().select(*none).withColumn(GONE, F.lit(True)))

    def with_delta(self, frame: DataFrame, rows: int) -> Versioned:
        return replace(self, deltas=(*self.deltas, Delta(rows, None, frame)))

    def written(self, spark: SparkSession, folder: str) -> Versioned:
        """With the deltas of a transaction written, one file each: a commit's delta is small or was staged."""
        out = []
        for d in self.deltas:
            if d.path is None:
                path = f"{folder}/{self.name}-{uuid.uuid4().hex}"
                (d.frame.coalesce(1) if d.rows <= BROADCAST_KEYS else d.frame).write.parquet(path)
                d = Delta(d.rows, path)
            out.append(d)
        return replace(self, deltas=tuple(out))

    def merged(self, spark: SparkSession, rows: DataFrame, gone: DataFrame, folder: str) -> Versioned:
        """With ``rows`` put and the keys of ``gone`` removed; writes only these."""
        path = f"{folder}/{self.name}-{uuid.uuid4().hex}"
        self.delta(rows, gone).write.parquet(path)
        return replace(self, deltas=(*self.deltas, Delta(spark.read.parquet(path).count(), path)))

    def compacted(self, spark: SparkSession, folder: str, share: float = 0.1, least: int = 0) -> Versioned:
        """Deltas folded into a new root once they have passed the share of it (and ``least`` rows), else into
        one delta once there are many."""
        if not self.deltas:
            return self
        rows = self.root_rows if self.root_rows is not None else spark.read.schema(self.struct).parquet(self.root).count()
        if self.changed() > max(least, share * rows):
            path = f"{folder}/{self.name}-{uuid.uuid4().hex}"
            write_root(self.current(spark), path, self.pk, self.filters)
            return Versioned(self.name, self.pk, path, self.schema, filters=self.filters)
        if len(self.deltas) > MOST_DELTAS:
            path = f"{folder}/{self.name}-{uuid.uuid4().hex}"
            self.overlay(spark).write.parquet(path)
            return replace(self, root_rows=rows, deltas=(Delta(spark.read.parquet(path).count(), path),))
        return replace(self, root_rows=rows)


def write_root(df: DataFrame, path: str, pk: str, filters: tuple[str, ...] = ()) -> None:
    """Sorted by key within files, with bloom filters that grow with what they hold; by zstd, as ids are hashes in hex."""
    writer = df.sortWithinPartitions(pk).write.option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
    for c in dict.fromkeys((pk, *filters)):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


class Manifest:
    """The published state: one file a version, the highest number is current."""

    def __init__(self, files: Files):
        self.files = files

    def version(self) -> int:
        return max((int(n[:-5]) for n in self.files.names("manifest") if n.endswith(".json")), default=0)

    def load(self) -> tuple[int, dict]:
        v = self.version()
        return v, (self.files.read(f"manifest/{v:012d}.json") or {}) if v else {}

    def publish(self, seen: int, state: dict) -> int:
        """Compare and swap: the next version after ``seen``, or a conflict."""
        if self.version() != seen or not self.files.create(f"manifest/{seen + 1:012d}.json", state):
            raise LockConflict(f"version {seen + 1} is already published")
        return seen + 1

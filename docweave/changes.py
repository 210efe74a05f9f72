"""Sets of changed rows and of keys: a few are held on the driver as Arrow rows, more are tables in the shared folder.

The bound is the number of rows (FEW): up to it, plans see the rows as a local relation and keys as literals,
which prune files; beyond it, nothing is collected.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.sources.store import BROADCAST_KEYS, GONE, Versioned

#: Rows that may be held on the driver, and keys that become literals of a filter.
FEW, LITERALS = 5_000, 100


def arrow_ready(schema: T.StructType) -> bool:
    """Whether rows of the schema can go through Arrow."""

    def ready(t: T.DataType) -> bool:
        if isinstance(t, T.StructType):
            return all(ready(f.dataType) for f in t)
        if isinstance(t, T.ArrayType):
            return ready(t.elementType)
        return not isinstance(t, (T.MapType, T.VariantType, T.NullType, T.UserDefinedType, T.CalendarIntervalType))

    return all(ready(f.dataType) for f in schema)


def nullable(t: T.DataType) -> T.DataType:
    """The type with every part nullable: a missing image is null as a whole."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(nullable(t.elementType))
    return t


def local_frame(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> DataFrame:
    """Rows of the driver as a local relation."""
    return spark.createDataFrame(rows, schema) if rows.num_rows else spark.createDataFrame([], schema)


def few(df: DataFrame) -> tuple[pa.Table, T.StructType] | None:
    """The rows of a plan with their schema, if there are few of them."""
    if not arrow_ready(df.schema):
        return None
    df = df.select(*[F.col(f.name).cast(nullable(f.dataType)).alias(f.name) for f in df.schema])
    # one job: a bare limit would try some partitions first, then more
    rows = df.limit(FEW + 1).coalesce(1).toArrow()
    return (rows, nullable(df.schema)) if rows.num_rows <= FEW else None


def alike(a, b) -> bool:
    """Equality of values from Arrow as the engine has it: NaN equals NaN."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(alike(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(alike(x, y) for x, y in zip(a, b, strict=True))
    return a == b or (a != a and b != b)


def compared(old: pa.Table, fresh: pa.Table, schema: T.StructType) -> pa.Table:
    """(pk, before, after, created_at) of the keys whose rows differ. ``old``: pk, before, created_at; ``fresh``: pk, after."""
    was = {r["pk"]: r for r in old.to_pylist()}
    out, seen = [], set()
    for r in fresh.to_pylist():
        before = was.get(r["pk"])
        if r["pk"] in seen:  # shown as it is: the caller refuses keys that come twice
            out.append({"pk": r["pk"], "before": None, "after": r["after"], "created_at": None})
        elif before is None or not alike(before["before"], r["after"]):
            out.append({"pk": r["pk"], "before": before and before["before"], "after": r["after"], "created_at": before and before["created_at"]})
            seen.add(r["pk"])
        else:
            seen.add(r["pk"])
    out += [{**r, "after": None} for k, r in was.items() if k not in seen]
    return pa.Table.from_pylist(out, to_arrow_schema(schema))


@dataclass
class Changes:
    """Changed rows of one table: (pk, before, after), and with them ``n``, how many."""

    frame: DataFrame
    n: int
    rows: pa.Table | None = None
    path: str | None = None

    @staticmethod
    def of(df: DataFrame, folder: str, tag: str, many: bool = False) -> Changes:
        """The rows of a plan, evaluated once: collected if they are few, else written."""
        spark = df.sparkSession
        found = None if many else few(df)
        if found is not None:
            return Changes.local(spark, *found)
        path = f"{folder}/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return Changes.read(spark, path, df.schema)

    @staticmethod
    def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Changes:
        frame = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
        return Changes(frame, frame.count(), None, path)

    @staticmethod
    def local(spark: SparkSession, rows: pa.Table, schema: T.StructType) -> Changes:
        return Changes(local_frame(spark, rows, schema), rows.num_rows, rows)

    def kept(self, folder: str, tag: str) -> str:
        """Where the rows are written; writes them if they aren't."""
        if self.path is None:
            self.path = f"{folder}/{tag}-{uuid.uuid4().hex}"
            self.frame.coalesce(1).write.parquet(self.path)
        return self.path

    def values(self, path: str) -> list | None:
        """The values at ``pk``, ``before.x`` or ``after.x``, where the rows are on the driver."""
        if self.rows is None:
            return None
        column = self.rows.column(path.split(".")[0]).combine_chunks()
        for step in path.split(".")[1:]:
            inside = column.field(step)
            column = pa.array([v if ok else None for v, ok in zip(inside.to_pylist(), column.is_valid().to_pylist(), strict=True)], inside.type)
        return column.to_pylist()


def keys_frame(spark: SparkSession, values, key_type: T.DataType) -> DataFrame:
    """Keys as column ``k`` of a local relation."""
    schema = T.StructType([T.StructField("k", key_type)])
    return local_frame(spark, pa.Table.from_arrays([pa.array(list(values), to_arrow_schema(schema).field(0).type)], names=["k"]), schema)


@dataclass
class Keys:
    """Distinct keys of one model as column ``k``."""

    frame: DataFrame
    n: int
    values: list | None = None

    @staticmethod
    def of(spark: SparkSession, found: set, key_type: T.DataType) -> Keys:
        values = sorted(found)
        return Keys(keys_frame(spark, values, key_type), len(values), values)

    @staticmethod
    def among(df: DataFrame, folder: str) -> Keys:
        """The distinct keys of a plan."""
        found = few(df)
        if found is not None:
            return Keys.of(df.sparkSession, set(found[0].column(0).to_pylist()), df.schema[0].dataType)
        path = f"{folder}/keys-{uuid.uuid4().hex}"
        df.write.parquet(path)
        frame = df.sparkSession.read.schema(df.schema).parquet(path)
        return Keys(frame, frame.count())

    def within(self, df: DataFrame, column: str) -> DataFrame:
        """Rows of ``df`` whose ``column`` is one of the keys."""
        if self.values is not None and self.n <= LITERALS:
            return df.where(F.col(column).isin(self.values))
        keys = self.frame.withColumnRenamed("k", "_k")
        return df.join(F.broadcast(keys) if self.n <= BROADCAST_KEYS else keys, F.col(column) == F.col("_k"), "left_semi")


def delta_of(changes: Changes, table: Versioned, at: datetime | None = None) -> DataFrame:
    """The rows of a delta of ``table``: new images, and tombstones for rows without one. ``at``: the time of a
    model's commit, which its rows carry; created_at is kept where there was a row."""
    struct = table.struct
    if changes.rows is None:
        when = F.lit(at).cast("timestamp")
        rows = changes.frame.where("after IS NOT NULL")
        rows = rows.select("after.*") if at is None else rows.select("after.*", F.coalesce("created_at", when).alias("created_at"), when.alias("updated_at"))
        return table.delta(rows, changes.frame.where("after IS NULL").select(F.col("pk").alias(table.pk)))
    whole = T.StructType([*[T.StructField(f.name, nullable(f.dataType)) for f in struct], T.StructField(GONE, T.BooleanType())])
    made = []
    for r in changes.rows.to_pylist():
        row = {**(r["after"] or {}), table.pk: r["pk"], GONE: r["after"] is None}
        if at is not None:
            row |= {"created_at": r["created_at"] or at, "updated_at": at}
        made.append(row)
    return local_frame(changes.frame.sparkSession, pa.Table.from_pylist(made, to_arrow_schema(whole)), whole)

"""Introspection: health, sizes, consistency, latency and retention reports."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.plans import graph

if TYPE_CHECKING:
    from docweave.engine import Engine

VERSION = "0.1.0"


def queue_stats(engine: Engine) -> dict:
    return engine.metrics.as_dict()


def queue_frame(transaction) -> DataFrame:
    """Changed keys of an open transaction, each once: entity and key as text."""
    e, out = transaction.e, None
    for table, rows in transaction.changes:
        part = rows.frame.select(F.lit(e.bases[table].entity).alias("entity"), F.col("pk").cast("string").alias("pk"))
        out = part if out is None else out.union(part)
    return e.spark.createDataFrame([], "entity string, pk string") if out is None else out.distinct()


def queue_info(transaction, most: int = 1_000) -> list[dict]:
    """The first changed keys of an open transaction by entity and key, each once; ``queue_frame`` has them all."""
    e, found = transaction.e, set()
    for table, rows in transaction.changes:
        some = rows.frame.select("pk").distinct().orderBy("pk").limit(most).collect()
        found |= {(e.bases[table].entity, r[0]) for r in some}
    return [{"entity": a, "pk": b} for a, b in sorted(found, key=lambda x: (x[0], str(type(x[1])), x[1]))[:most]]


def health(engine: Engine) -> list[tuple[str, str, str, str]]:
    """(status, component, message, severity) of catalog and storage."""
    rows = [("OK", "engine", f"version {VERSION}", "info"), ("OK", "document operators", "built in", "info")]
    lost = [m for m in engine.models if m not in engine.tables]
    rows.append(("ERROR", "metadata", f"models without a table: {', '.join(lost)}", "error") if lost else ("OK", "metadata", "no orphans", "info"))
    orphans = [s for m in engine.models.values() for s in m.sources if s not in engine.bases]
    rows.append(("WARNING", "subscriptions", f"unknown tables: {', '.join(orphans)}", "warning") if orphans else ("OK", "subscriptions", "no orphans", "info"))
    rows.append(("OK", "models", f"{len(engine.models)} models", "info"))
    return rows


def performance(engine: Engine) -> list[dict]:
    """Rows, bytes and deltas of each model, most rows first."""
    out = [{"name": m, "rows": engine.table(m).count(), "bytes": engine.files.size(engine.tables[m].root), "deltas": len(engine.tables[m].deltas), "changed": engine.tables[m].changed()} for m in engine.models]
    return sorted(out, key=lambda r: (-r["rows"], r["name"]))


def consistency(stored: DataFrame, truth: DataFrame, pk: str) -> DataFrame:
    """Keys that differ: missing (only in the truth), extra (only stored) or changed."""
    columns = [c for c in truth.columns if c != pk]
    a = stored.select(F.col(pk), F.struct(*columns).alias("a"))
    b = truth.select(F.col(pk), F.struct(*[F.col(c).cast(stored.schema[c].dataType).alias(c) for c in columns]).alias("b"))
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise("changed")
    return a.join(b, pk, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(pk, kind.alias("problem"))


def check(engine: Engine, name: str) -> tuple[str, int]:
    """OK, WARNING (under 1 % of rows differ) or ERROR, with the number of differing keys."""
    truth = engine.view(name)
    stored = engine.table(name).select(*truth.columns)
    n, rows = consistency(stored, truth, engine.models[name].pk).count(), truth.count()
    return ("OK" if not n else "WARNING" if 100 * n < rows else "ERROR"), n


def cascade_path(engine: Engine, entity: str) -> DataFrame:
    rows = graph.cascade_path(engine.refers(), entity)
    return engine.spark.createDataFrame([(d, e, f) for d, e, f in rows], "depth int, entity_name string, depends_on string")


def latency(df: DataFrame, value: str, by: list[str | Column]) -> DataFrame:
    """Average, 95th and 99th percentile."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("avg"), F.percentile(x, 0.95).alias("p95"), F.percentile(x, 0.99).alias("p99"))


def hourly(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.count_if(F.col(value) > 100).alias("slow"))


def daily(df: DataFrame, ts: str, value: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"))


def retained(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    """Rows not older than the retention."""
    return df.where(F.col(ts) >= now - F.make_interval(days=F.lit(days)))


def write_audit(engine: Engine) -> DataFrame:
    """The audit log as rows."""
    return engine.spark.createDataFrame([(a["operation"], a["name"], a["at"], a["details"]) for a in engine.audit], "operation string, name string, at string, details string")


def analyze_select(engine: Engine, select: str) -> str:
    """The inferred schema of a SELECT as JSON, or an error as JSON; never raises."""
    from docweave.functions.naming import classify
    from docweave.plans.lineage import bound

    try:
        return json.dumps(classify(bound(engine.spark, select, engine.frames()).schema).as_dict())
    except Exception as e:
        return json.dumps({"error": str(e).split("\n")[0]})


def infer_types(engine: Engine, table: str, columns: list[str]) -> dict[str, str]:
    from docweave.errors import RequiredColumnMissing

    schema = engine.table(table).schema
    missing = [c for c in columns if c not in schema.names]
    if missing:
        raise RequiredColumnMissing(", ".join(missing))
    return {c: schema[c].dataType.simpleString() for c in columns}

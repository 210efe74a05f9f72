"""Change feeds: a stream of row changes applied micro-batch by micro-batch, each exactly once.

The feed has the base table's columns, ``op`` (I, U or D) and an order column; within a micro-batch the
last change of a key counts. The batch id goes into the manifest with the state it made, so a batch that
is replayed after a failure is a no-op.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.engine import Engine, Transaction


def newest(changes: DataFrame, pk: str, order: str) -> DataFrame:
    """The last change of each key."""
    columns = changes.columns
    return changes.groupBy(pk).agg(F.max_by(F.struct(*columns), F.col(order)).alias("row")).select("row.*")


def apply_changes(engine: Engine, table: str, changes: DataFrame, order: str, batch_id: str) -> dict:
    """One micro-batch as one transaction."""
    base = engine.bases[table]
    columns = engine.table(table).columns

    def batch(t: Transaction) -> None:
        last = newest(changes, base.pk, order)
        t.insert(table, last.where("op <> 'D'").select(*columns))
        t.delete_keys(table, last.where("op = 'D'").select(base.pk))

    return engine.apply(batch, f"{table}:{batch_id}")


def follow(engine: Engine, table: str, stream: DataFrame, order: str, checkpoint: str) -> StreamingQuery:
    """Starts the feed; ``availableNow`` drains what is there."""
    return stream.writeStream.foreachBatch(lambda df, n: apply_changes(engine, table, df, order, str(n))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

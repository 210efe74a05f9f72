"""Hand-written refreshes of product documents: what a change of one kind patches, without the engine.

``refresh_product`` sends a change to the patch of its kind; documents that the change doesn't reach stay as
they are. Sources are joined by their key; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.errors import EngineError
from docweave.functions.documents import merge_at


def _patched(docs: DataFrame, source: DataFrame, key: str, field: str, fields: list[str], nullable: bool = False) -> DataFrame:
    """``data.field`` with the fields of the source's row of the same ``key``; documents without one stay, or, where
    the source is nullable, lose the object."""
    rows = source.select(F.col(key).alias("_k"), F.struct(*fields).alias("_new"))
    out = docs.join(rows, F.col(key) == F.col("_k"), "left")
    new = F.col("data")
    if nullable:
        new = new.withField(field, F.when(F.col("_k").isNotNull(), F.struct(*[F.col("_new")[f].alias(f) for f in fields])))
    else:
        for f in fields:
            new = new.withField(f"{field}.{f}", F.when(F.col("_k").isNotNull(), F.col("_new")[f]).otherwise(F.col("data")[field][f]))
    return out.withColumn("data", new).drop("_k", "_new")


def price(docs: DataFrame, changes: DataFrame, key: str, hint: str) -> DataFrame:
    """By the hint of what changed: price_current, price_base (with discount_pct) or status."""
    rows = changes.select(F.col(key).alias("_k"), F.col("value").alias("_v"))
    out = docs.join(rows, F.col(key) == F.col("_k"), "left")
    hit, d = F.col("_k").isNotNull(), F.col("data")
    if hint == "status":
        new = d.withField("status", F.when(hit, F.col("_v").cast("string")).otherwise(d["status"]))
    else:
        of = "current" if hint == "price_current" else "base"
        value = F.when(hit, F.col("_v").cast("double")).otherwise(d["price"][of])
        base, now = (value, d["price"]["current"]) if of == "base" else (d["price"]["base"], value)
        pct = F.coalesce(F.round((base - now) / F.nullif(base, F.lit(0.0)) * 100, 0), F.lit(0.0))
        new = merge_at(d, "price", {of: value, "discount_pct": F.when(hit, pct).otherwise(d["price"]["discount_pct"])})
    return out.withColumn("data", new).drop("_k", "_v")


def category(docs: DataFrame, source: DataFrame, key: str = "fk_category") -> DataFrame:
    return _patched(docs, source, key, "category", ["name"])


def supplier(docs: DataFrame, source: DataFrame, key: str = "fk_supplier") -> DataFrame:
    """The whole supplier object; null for a product whose supplier is gone or never was."""
    return _patched(docs, source, key, "supplier", ["id", "name"], nullable=True)


def inventory(docs: DataFrame, source: DataFrame, key: str = "pk_product") -> DataFrame:
    """Quantities, and what is left of them."""
    source = source.withColumn("available", F.col("quantity") - F.col("reserved"))
    return _patched(docs, source, key, "inventory", ["quantity", "reserved", "available"])


def refresh_product(docs: DataFrame, entity: str, change: str, source: DataFrame) -> DataFrame:
    """The dispatcher: entity product (change: price_current, price_base, status), category, supplier or inventory."""
    if entity == "product" and change in ("price_current", "price_base", "status"):
        return price(docs, source, "pk_product", change)
    kinds = {"category": category, "supplier": supplier, "inventory": inventory}
    if entity not in kinds:
        raise EngineError(f"no refresh for changes of {entity} ({change})")
    return kinds[entity](docs, source)


def counts(docs: DataFrame, *more: Column) -> DataFrame:
    """How many products there are, with a supplier, in stock and discounted, and further aggregates."""
    d = F.col("data")
    return docs.agg(F.count("*").alias("n"), F.count_if(d["supplier"].isNotNull()).alias("with_supplier"), F.count_if(d["inventory"]["available"] > 0).alias("in_stock"), F.count_if(d["price"]["discount_pct"] > 0).alias("discounted"), *more)

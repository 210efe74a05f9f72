"""Read models over the TPC-H-like tables, and the change batches that the queries apply to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docweave.engine import Engine

BASES = {
    "region": ("r_regionkey", "region", {}),
    "nation": ("n_nationkey", "nation", {"n_regionkey": "region"}),
    "customer": ("c_custkey", "customer", {"c_nationkey": "nation"}),
    "supplier": ("s_suppkey", "supplier", {"s_nationkey": "nation"}),
    "part": ("p_partkey", "part", {}),
    "orders": ("o_orderkey", "order", {"o_custkey": "customer"}),
}

REGION = "SELECT r_regionkey AS pk_region, md5(concat('region:', r_regionkey)) AS id, named_struct('name', r_name) AS data FROM region"
NATION = """SELECT n_nationkey AS pk_nation, n_regionkey AS fk_region, md5(concat('nation:', n_nationkey)) AS id,
  named_struct('name', n_name, 'region', v_region.data) AS data FROM nation LEFT JOIN v_region ON v_region.pk_region = n_regionkey"""
CUSTOMER = """SELECT c_custkey AS pk_customer, c_nationkey AS fk_nation, md5(concat('customer:', c_custkey)) AS id,
  named_struct('name', c_name, 'balance', CAST(c_acctbal AS DECIMAL(14,2)), 'nation', v_nation.data,
    'orders', named_struct('n', coalesce(s.n, 0), 'open', coalesce(s.n_open, 0), 'total', coalesce(s.total, CAST(0 AS DECIMAL(18,2))))) AS data
FROM customer LEFT JOIN v_nation ON v_nation.pk_nation = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
    CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY o_custkey) s ON s.o_custkey = c_custkey"""
PERSON = """SELECT c_custkey AS pk_person, c_nationkey AS fk_nation, md5(concat('person:', c_custkey)) AS id,
  named_struct('name', c_name, 'nation', v_nation.data) AS data FROM customer LEFT JOIN v_nation ON v_nation.pk_nation = c_nationkey"""
ORDER = """SELECT o_orderkey AS pk_order, o_custkey AS fk_person, md5(concat('order:', o_orderkey)) AS id,
  named_struct('status', o_orderstatus, 'total', CAST(o_totalprice AS DECIMAL(14,2)), 'customer', v_person.data) AS data
FROM orders LEFT JOIN v_person ON v_person.pk_person = o_custkey"""
ITEM = """SELECT item_id AS pk_item, l_orderkey AS fk_order, md5(concat('item:', item_id)) AS id,
  named_struct('quantity', CAST(l_quantity AS DECIMAL(12,2)), 'order', v_order.data) AS data
FROM items JOIN v_order ON v_order.pk_order = l_orderkey"""
BASKET = """SELECT o_orderkey AS pk_basket, o_custkey AS fk_person, named_struct('status', o_orderstatus, 'items', coalesce(i.items, array())) AS data
FROM orders LEFT JOIN (SELECT l_orderkey, transform(array_sort(collect_list(struct(item_id, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS quantity))), x -> x) AS items
  FROM items GROUP BY l_orderkey) i ON i.l_orderkey = o_orderkey"""
ACTIVE = """SELECT o_orderkey AS pk_active, o_custkey AS fk_person, named_struct('status', o_orderstatus, 'total', CAST(o_totalprice AS DECIMAL(14,2))) AS data
FROM orders WHERE o_orderstatus = 'O'"""


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    e = Engine(spark)
    for name, (pk, entity, fks) in BASES.items():
        e.register(name, f"{sf_dir}/{name}.parquet", pk, entity, fks)
    return e


def derived(e: Engine, name: str, rows: DataFrame, pk: str, entity: str, fks: dict[str, str] | None = None) -> Engine:
    """A base table made of others, written to the engine's folder."""
    path = f"{e.path}/{name}"
    rows.write.parquet(path)
    e.register(name, path, pk, entity, fks)
    return e


def with_items(e: Engine, sf_dir: str) -> Engine:
    """``items``: lineitem with a key, its rank in the total order of all columns within the order."""
    rows = e.spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*[c for c in rows.columns if c != "l_orderkey"]))
    path = f"{e.path}/items"
    rows.withColumn("item_id", F.col("l_orderkey") * 1000 + rank).write.option("compression", "zstd").parquet(path)
    e.register("items", path, "item_id", "item", {"l_orderkey": "order"})
    return e


def geo(e: Engine) -> Engine:
    e.create("tv_region", REGION, "region")
    e.create("tv_nation", NATION, "nation")
    return e


def customers(spark: SparkSession, sf_dir: str) -> Engine:
    e = geo(engine(spark, sf_dir))
    e.create("tv_customer", CUSTOMER, "customer", children={"orders": "o_custkey"})
    return e


def chain(spark: SparkSession, sf_dir: str, items: bool = True) -> Engine:
    """Five levels: region, nation, person, order, item."""
    e = geo(engine(spark, sf_dir))
    e.create("tv_person", PERSON, "customer")
    e.create("tv_order", ORDER, "orders")
    if items:
        with_items(e, sf_dir).create("tv_item", ITEM, "items")
    return e


def flat_customers(df: DataFrame) -> DataFrame:
    d = F.col("data")
    return df.select("pk_customer", "fk_nation", d["name"].alias("name"), d["balance"].cast("double").alias("balance"), d["nation"]["name"].alias("nation"), d["nation"]["region"]["name"].alias("region"), d["orders"]["n"].alias("n"), d["orders"]["open"].alias("n_open"), d["orders"]["total"].cast("double").alias("total"))


def flat_orders(df: DataFrame) -> DataFrame:
    d = F.col("data")
    return df.select("pk_order", "fk_person", d["status"].alias("status"), d["total"].cast("double").alias("total"), d["customer"]["name"].alias("customer"), d["customer"]["nation"]["name"].alias("nation"), d["customer"]["nation"]["region"]["name"].alias("region"))


def flat_items(df: DataFrame) -> DataFrame:
    o = F.col("data")["order"]
    return df.select("pk_item", "fk_order", F.col("data")["quantity"].cast("double").alias("quantity"), o["status"].alias("status"), o["customer"]["name"].alias("customer"), o["customer"]["nation"]["name"].alias("nation"), o["customer"]["nation"]["region"]["name"].alias("region"))

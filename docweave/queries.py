"""Queries over the driver's tables, one for each group of operators, with SQL for an independent engine.

Engine queries define read models, apply deterministic change batches and return the maintained model;
their SQL evaluates the definition over the changed tables, so it is an oracle of the incremental path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import documents as docs
from docweave.functions.naming import type_of_name
from docweave.errors import LockConflict
from docweave.operators import manual, monitor
from docweave.operators import workload as w
from docweave.plans import graph, lineage
from docweave.streaming import feed

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# oracles -----------------------------------------------------------------------------------------


def customers_sql(customer="customer", orders="orders", nation="nation", region="region", ctes="") -> str:
    return f"""{f"WITH {ctes}" if ctes else ""}
SELECT CAST(c_custkey AS BIGINT) AS pk_customer, c_nationkey AS fk_nation, c_name AS name, CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS DOUBLE) AS balance, n_name AS nation, r_name AS region,
  coalesce(s.n, 0) AS n, coalesce(s.n_open, 0) AS n_open, CAST(coalesce(s.total, 0) AS DOUBLE) AS total
FROM {customer} c LEFT JOIN {nation} ON n_nationkey = c_nationkey LEFT JOIN {region} ON r_regionkey = n_regionkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS total FROM {orders} GROUP BY o_custkey) s ON s.o_custkey = c_custkey"""


def orders_sql(orders="orders", customer="customer", nation="nation", region="region", ctes="") -> str:
    return f"""{f"WITH {ctes}" if ctes else ""}
SELECT o_orderkey AS pk_order, o_custkey AS fk_person, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS total, c_name AS customer, n_name AS nation, r_name AS region
FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey LEFT JOIN {nation} ON n_nationkey = c_nationkey LEFT JOIN {region} ON r_regionkey = n_regionkey"""


ITEMS = """items AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS item_id FROM lineitem)"""
NATION_7 = "nation_m AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey = 7 THEN n_name || '_x' ELSE n_name END AS n_name FROM nation)"
REGION_2 = "region_m AS (SELECT r_regionkey, CASE WHEN r_regionkey = 2 THEN r_name || '_x' ELSE r_name END AS r_name FROM region)"
CUSTOMER_97 = "customer_m AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 97 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer)"
REPARENT = "orders_m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN (o_custkey + 1) % (SELECT count(*) FROM customer) ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice FROM orders)"

# definition and relational surface ---------------------------------------------------------------


@query(customers_sql())
def create_customer_read_model(spark, sf_dir):
    return w.flat_customers(w.customers(spark, sf_dir).table("tv_customer"))


@query("SELECT p_partkey AS pk_part, md5('part:' || p_partkey) AS id, p_name AS name, p_size AS size FROM part WHERE p_size > 10")
def create_raw_select(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    e.sql("CREATE TABLE tv_part AS SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 10", base="part")
    return e.table("tv_part").select("pk_part", "id", F.col("data.p_name").alias("name"), F.col("data.p_size").alias("size"))


def items_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["l_partkey"], i["quantity"])), ",")


@query(f"WITH {ITEMS} SELECT o_orderkey AS pk_basket, count(item_id) AS n_items, coalesce(string_agg(l_partkey || ':' || CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), ',' ORDER BY item_id), '') AS items FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def order_items_array(spark, sf_dir):
    e = w.with_items(w.engine(spark, sf_dir), sf_dir)
    e.create("tv_basket", w.BASKET, "orders", children={"items": "l_orderkey"})
    return e.table("tv_basket").select("pk_basket", F.size("data.items").cast("long").alias("n_items"), items_text(F.col("data.items")).alias("items"))


@query("""SELECT c_custkey AS pk_customer, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate DESC, o_orderkey DESC), '') AS recent FROM customer
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o ON o_custkey = c_custkey AND rn <= 5 GROUP BY c_custkey""")
def customer_recent_orders(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    e.create("tv_recent", """SELECT c_custkey AS pk_recent, named_struct('recent', coalesce(r.recent, array())) AS data FROM customer
      LEFT JOIN (SELECT o_custkey, transform(array_sort(collect_list(struct(rn, o_orderkey))), x -> x.o_orderkey) AS recent FROM
        (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn <= 5 GROUP BY o_custkey) r ON r.o_custkey = c_custkey""",
      "customer", children={"orders": "o_custkey"})
    return e.table("tv_recent").select(F.col("pk_recent").alias("pk_customer"), F.array_join("data.recent", ",").alias("recent"))


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_orderpriority) AS priorities, CAST(max(o_totalprice) AS DOUBLE) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def order_stats_filter(spark, sf_dir):
    return w.engine(spark, sf_dir).sql("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f, count(DISTINCT o_orderpriority) AS priorities, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 10")


@query("SELECT n_nationkey AS pk_nation, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def nation_array_column(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    e.create("tv_members", "SELECT n_nationkey AS pk_members, coalesce(k.ids, array()) AS customer_ids, named_struct('name', n_name) AS data FROM nation LEFT JOIN (SELECT c_nationkey, array_sort(collect_list(c_custkey)) AS ids FROM customer GROUP BY c_nationkey) k ON k.c_nationkey = n_nationkey", "nation", children={"customer": "c_nationkey"})
    return e.table("tv_members").select(F.col("pk_members").alias("pk_nation"), F.array_join("customer_ids", ",").alias("customers"))


@query("""WITH orders_m AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'O' WHEN o_orderkey % 7 = 1 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders)
SELECT o_orderkey AS pk_active, o_custkey AS fk_person, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS total FROM orders_m WHERE o_orderstatus = 'O'""")
def active_model_filter(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    e.create("tv_active", w.ACTIVE, "orders", fks={})
    e.apply(lambda t: t.update("orders", "o_orderkey % 7 IN (0, 1)", {"o_orderstatus": "CASE WHEN o_orderkey % 7 = 0 THEN 'O' ELSE 'F' END"}))
    return e.table("tv_active").select("pk_active", "fk_person", F.col("data.status").alias("status"), F.col("data.total").cast("double").alias("total"))


@query("""SELECT * FROM (SELECT 'lookup' AS pattern, o_orderkey AS pk_order FROM orders WHERE md5('order:' || o_orderkey) = md5('order:' || 33)
UNION ALL (SELECT 'page', o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20)
UNION ALL (SELECT 'back', o_orderkey FROM orders WHERE o_orderkey < 100 ORDER BY o_orderkey DESC LIMIT 20)
UNION ALL SELECT 'contains', o_orderkey FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'fk', o_orderkey FROM orders WHERE o_custkey = 7)""")
def read_patterns(spark, sf_dir):
    e = w.chain(spark, sf_dir, items=False)
    t = e.table("tv_order")
    parts = [
        ("lookup", t.where(F.col("id") == F.md5(F.lit("order:33")))),
        ("page", t.where("pk_order > 100").orderBy("pk_order").limit(20)),
        ("back", t.where("pk_order < 100").orderBy(F.desc("pk_order")).limit(20)),
        ("contains", t.where(docs.contains(F.col("data"), {"status": F.lit("P")}))),
        ("fk", t.where("fk_person = 7")),
    ]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("pattern"), "pk_order")
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer")
def has_children(spark, sf_dir):
    return w.engine(spark, sf_dir).sql("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer")


@query("""SELECT 'right' AS kind, n_name, count(c_custkey) AS n FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name
UNION ALL SELECT 'full', coalesce(n_name, 'none'), count(s_suppkey) FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
UNION ALL SELECT 'anti', n_name, 0 FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)
UNION ALL SELECT 'like', c_name, 1 FROM customer WHERE c_name ILIKE '%00_7%' AND c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def join_kinds(spark, sf_dir):
    return w.engine(spark, sf_dir).sql("""SELECT 'right' AS kind, n_name, count(c_custkey) AS n FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY n_name
UNION ALL SELECT 'full', coalesce(n_name, 'none'), count(s_suppkey) FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN nation ON s_nationkey = n_nationkey GROUP BY coalesce(n_name, 'none')
UNION ALL SELECT 'anti', n_name, 0 FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)
UNION ALL SELECT 'like', c_name, 1 FROM customer WHERE c_name ILIKE '%00_7%' AND c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""")


# document operators ------------------------------------------------------------------------------


def order_docs(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("note")).alias("customer")).alias("data"))


def basket_docs(spark, sf_dir) -> DataFrame:
    """Each order's distinct parts with their summed quantity, by part."""
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("id", "qty"))).alias("items"))


BASKET = "b AS (SELECT l_orderkey, l_partkey AS id, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL), f AS (SELECT l_orderkey, min(id) AS lo, max(id) AS hi FROM b GROUP BY ALL)"


def basket_sql(row: str, where: str = "true") -> str:
    return f"WITH {BASKET} SELECT l_orderkey, coalesce(string_agg(id || ':' || {row}, ',' ORDER BY id) FILTER (WHERE {where}), '') AS items FROM b JOIN f USING (l_orderkey) GROUP BY l_orderkey"


def pairs(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["id"], i["qty"])), ",")


@query("SELECT o_orderkey, o_orderstatus AS status, o_custkey AS customer_id, CASE WHEN o_orderkey % 3 = 0 THEN 'seen' END AS note FROM orders")
def patch_nested(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    d = d.withColumn("data", docs.merge_at(F.col("data"), "customer", {"note": F.when(F.col("o_orderkey") % 3 == 0, "seen")}))
    return d.select("o_orderkey", "data.status", F.col("data.customer.id").alias("customer_id"), "data.customer.note")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_custkey AS customer_id FROM orders")
def patch_scalar(spark, sf_dir):
    d = order_docs(spark, sf_dir)
    d = d.withColumn("data", docs.merge_at(F.col("data"), "", {"status": F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("data.status"))}))
    return d.select("o_orderkey", "data.status", F.col("data.customer.id").alias("customer_id"))


@query(basket_sql("CASE WHEN id = hi THEN 0 ELSE qty END"))
def patch_array(spark, sf_dir):
    b = basket_docs(spark, sf_dir)
    return b.select("l_orderkey", pairs(docs.patch_element(F.col("items"), "id", F.array_max("items.id"), {"qty": F.lit(0).cast("long")})).alias("items"))


@query(f"WITH {BASKET}, x AS (SELECT l_orderkey, id, qty FROM b UNION ALL SELECT l_orderkey, lo + 1, -1 FROM f) SELECT l_orderkey, string_agg(id || ':' || qty, ',' ORDER BY id, qty DESC) AS items FROM x GROUP BY l_orderkey")
def array_insert(spark, sf_dir):
    b = basket_docs(spark, sf_dir)
    new = F.struct((F.array_min("items.id") + 1).alias("id"), F.lit(-1).cast("long").alias("qty"))
    return b.select("l_orderkey", pairs(docs.insert_element(F.col("items"), new, "id")).alias("items"))


@query(basket_sql("qty", "id <> lo"))
def array_delete(spark, sf_dir):
    b = basket_docs(spark, sf_dir)
    return b.select("l_orderkey", pairs(docs.delete_elements(F.col("items"), "id", F.array_min("items.id"))).alias("items"))


@query(f"WITH {BASKET} SELECT l_orderkey, bool_or(id = l_orderkey % 100) AS found, count(*) AS length FROM b GROUP BY l_orderkey")
def array_contains(spark, sf_dir):
    b = basket_docs(spark, sf_dir)
    return b.select("l_orderkey", docs.contains_element(F.col("items"), "id", F.col("l_orderkey") % 100).alias("found"), F.size("items").cast("long").alias("length"))


@query(basket_sql("CASE WHEN id = lo THEN qty + 1 ELSE qty END"))
def array_update_path(spark, sf_dir):
    b = basket_docs(spark, sf_dir)
    first = F.array_min("items.id")
    return b.select("l_orderkey", pairs(docs.update_element_path(F.col("items"), "id", first, "qty", F.try_element_at("items", F.lit(1))["qty"] + 1)).alias("items"))


@query(basket_sql("CASE WHEN id IN (lo, hi) THEN 9 ELSE qty END"))
def array_update_batch(spark, sf_dir):
    b = basket_docs(spark, sf_dir)
    keys = F.array_distinct(F.array(F.array_min("items.id"), F.array_max("items.id")))
    updates = F.map_from_arrays(keys, F.transform(keys, lambda _: F.lit(9).cast("long")))
    return b.select("l_orderkey", pairs(docs.update_elements(F.col("items"), "id", updates, "qty")).alias("items"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def set_path(spark, sf_dir):
    """Dynamic documents: the event type is put at a new nested path of the props, then read back."""
    e = read(spark, sf_dir, "events").withColumn("doc", docs.set_path_json(F.col("props"), "meta.kind", F.col("event_type")))
    return e.select("event_id", F.get_json_object("doc", "$.k").cast("long").alias("k"), F.get_json_object("doc", "$.meta.kind").alias("kind"))


@query("SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS id FROM events")
def extract_id(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("id"))


# refresh and propagation -------------------------------------------------------------------------


@query(customers_sql(nation="nation_m", ctes=NATION_7))
def cascade_1(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    e.apply(lambda t: t.update("nation", "n_nationkey = 7", {"n_name": "n_name || '_x'"}))
    return w.flat_customers(e.table("tv_customer"))


@query(customers_sql(customer="customer_m", ctes=CUSTOMER_97))
def refresh_bulk(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    e.apply(lambda t: t.update("customer", "c_custkey % 97 = 0", {"c_acctbal": "c_acctbal + 1"}))
    return w.flat_customers(e.table("tv_customer"))


@query(customers_sql())
def refresh_insert(spark, sf_dir):
    """Starts without a fiftieth of the orders, then inserts them."""
    e = w.customers(spark, sf_dir)
    held = e.table("orders").where("o_orderkey % 50 = 0")
    e.apply(lambda t: t.delete("orders", "o_orderkey % 50 = 0"))
    e.apply(lambda t: t.insert("orders", held))
    return w.flat_customers(e.table("tv_customer"))


@query(customers_sql(orders="orders_m", ctes="orders_m AS (SELECT * FROM orders WHERE o_orderkey % 101 <> 0 AND o_custkey % 200 <> 0)"))
def refresh_delete(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    e.apply(lambda t: t.delete("orders", "o_orderkey % 101 = 0").delete("orders", "o_custkey % 200 = 0"))
    return w.flat_customers(e.table("tv_customer"))


@query(customers_sql(orders="orders_m", ctes=REPARENT))
def refresh_reparent(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    n = e.table("customer").count()
    e.apply(lambda t: t.update("orders", "o_orderkey % 89 = 0", {"o_custkey": f"(o_custkey + 1) % {n}"}))
    return w.flat_customers(e.table("tv_customer"))


@query(f"""WITH {ITEMS}, {REGION_2} SELECT item_id AS pk_item, l_orderkey AS fk_order, CAST(CAST(l_quantity AS DECIMAL(12,2)) AS DOUBLE) AS quantity, o_orderstatus AS status, c_name AS customer, n_name AS nation, r_name AS region
FROM items JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region_m ON r_regionkey = n_regionkey""")
def cascade_deep(spark, sf_dir):
    e = w.chain(spark, sf_dir)
    e.apply(lambda t: t.update("region", "r_regionkey = 2", {"r_name": "r_name || '_x'"}))
    return w.flat_items(e.table("tv_item"))


WIDE = 6


@query("SELECT g AS model, p_partkey AS pk, p_name || '_' || g AS label, CASE WHEN p_partkey % 20 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part, range(6) r(g)")
def cascade_wide(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    for g in range(WIDE):
        e.create(f"tv_wide{g}", f"SELECT p_partkey AS pk_wide{g}, named_struct('label', concat(p_name, '_{g}'), 'size', p_size) AS data FROM part", "part")
    e.apply(lambda t: t.update("part", "p_partkey % 20 = 0", {"p_size": "p_size + 1"}))
    out = None
    for g in range(WIDE):
        df = e.table(f"tv_wide{g}").select(F.lit(g).cast("long").alias("model"), F.col(f"pk_wide{g}").alias("pk"), F.col("data.label").alias("label"), F.col("data.size").alias("size"))
        out = df if out is None else out.unionByName(df)
    return out


@query("SELECT DISTINCT CAST(k AS BIGINT) AS pk_customer FROM (SELECT o_custkey AS k FROM orders WHERE o_orderkey % 89 = 0 UNION ALL SELECT (o_custkey + 1) % (SELECT count(*) FROM customer) FROM orders WHERE o_orderkey % 89 = 0 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 97 = 0)")
def affected_keys(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    n = e.table("customer").count()
    t = e.begin().update("orders", "o_orderkey % 89 = 0", {"o_custkey": f"(o_custkey + 1) % {n}"}).update("customer", "c_custkey % 97 = 0", {"c_acctbal": "c_acctbal + 1"})
    return t.affected_keys("tv_customer").select(F.col("k").cast("long").alias("pk_customer"))


@query("SELECT CAST(0 AS BIGINT) AS rewritten, CAST(count(*) AS BIGINT) AS n FROM customer")
def noop_change_stops(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    r = e.apply(lambda t: t.update("nation", "true", {"n_name": "n_name"}))
    rewritten = sum(x["rewritten"] + x["removed"] for x in r.values())
    return e.table("tv_customer").agg(F.lit(rewritten).cast("long").alias("rewritten"), F.count("*").alias("n"))


@query(customers_sql())
def full_refresh(spark, sf_dir):
    """A spoiled copy of the model, rebuilt whole."""
    e = w.customers(spark, sf_dir)
    rows = e.table("tv_customer")
    spoiled = rows.where("pk_customer % 3 = 0").withColumn("fk_nation", F.lit(-1))
    e.tables["tv_customer"] = e.tables["tv_customer"].merged(spark, spoiled, rows.where("pk_customer % 7 = 1"), e.path)
    e.refresh_all("tv_cust%")
    return w.flat_customers(e.table("tv_customer"))


# transactions ------------------------------------------------------------------------------------


@query(customers_sql(customer="customer_m", ctes=CUSTOMER_97))
def savepoint_rollback(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    t = e.begin().update("customer", "c_custkey % 97 = 0", {"c_acctbal": "c_acctbal + 1"}).savepoint("a")
    t.delete("orders", "o_orderkey % 101 = 0").rollback_to("a").release("a").commit()
    return w.flat_customers(e.table("tv_customer"))


@query(customers_sql(nation="nation_m", ctes=NATION_7))
def prepared_commit(spark, sf_dir):
    from docweave.engine import Engine

    e = w.customers(spark, sf_dir)
    e.begin().update("nation", "n_nationkey = 7", {"n_name": "n_name || '_x'"}).prepare("g1")
    other = Engine(spark, e.path)  # another process on the same folder
    other.commit_prepared("g1")
    return w.flat_customers(Engine(spark, e.path).table("tv_customer"))


@query(customers_sql())
def prepared_rollback(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    e.begin().update("nation", "n_nationkey = 7", {"n_name": "n_name || '_x'"}).prepare("g2")
    e.rollback_prepared("g2")
    e.commit_prepared("g2")
    return w.flat_customers(e.table("tv_customer"))


@query(customers_sql(orders="orders_m", ctes="orders_m AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 31 = 0 THEN 'O' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 37 <> 5)"))
def change_feed(spark, sf_dir):
    """A feed with superseded changes, applied twice under one batch id."""
    e = w.customers(spark, sf_dir)
    o = e.table("orders")
    put = o.where("o_orderkey % 31 = 0").withColumn("op", F.lit("U"))
    feed_ = put.withColumn("o_orderstatus", F.lit("P")).withColumn("seq", F.lit(1)).unionByName(put.withColumn("o_orderstatus", F.lit("O")).withColumn("seq", F.lit(2)))
    feed_ = feed_.unionByName(o.where("o_orderkey % 37 = 5").withColumn("op", F.lit("D")).withColumn("seq", F.lit(3)))
    for _ in range(2):
        feed.apply_changes(e, "orders", feed_, "seq", "7")
    return w.flat_customers(e.table("tv_customer"))


# introspection -----------------------------------------------------------------------------------

EDGES = "e(a, b) AS (VALUES ('nation', 'region'), ('person', 'nation'), ('order', 'person'))"


@query(f"WITH RECURSIVE {EDGES}, r(depth, entity_name, depends_on) AS (SELECT 0, 'region', CAST(NULL AS VARCHAR) UNION ALL SELECT depth + 1, a, b FROM r JOIN e ON b = entity_name WHERE depth < 10) SELECT CAST(depth AS INTEGER) AS depth, entity_name, depends_on FROM r")
def cascade_path(spark, sf_dir):
    return monitor.cascade_path(w.chain(spark, sf_dir, items=False), "region")


@query(f"WITH RECURSIVE {EDGES}, r(depth, x) AS (SELECT 0, 'region' UNION ALL SELECT depth + 1, a FROM r JOIN e ON b = x WHERE depth < 10) SELECT CAST(depth AS INTEGER) AS depth, CAST(count(*) AS INTEGER) AS n, string_agg(x, ',' ORDER BY x) AS entities FROM r GROUP BY depth")
def cascade_impact(spark, sf_dir):
    refers = w.chain(spark, sf_dir, items=False).refers()
    return spark.createDataFrame([(d, n, ",".join(es)) for d, n, es in graph.impact(refers, "region")], "depth int, n int, entities string")


@query("SELECT CAST(c_custkey AS BIGINT) AS pk_customer, CASE WHEN c_custkey % 50 = 1 THEN 'missing' ELSE 'changed' END AS problem FROM customer WHERE c_custkey % 50 IN (1, 2)")
def consistency_check(spark, sf_dir):
    e = w.customers(spark, sf_dir)
    truth = w.flat_customers(e.view("tv_customer"))
    stored = w.flat_customers(e.table("tv_customer")).where("pk_customer % 50 <> 1").withColumn("name", F.when(F.col("pk_customer") % 50 == 2, "?").otherwise(F.col("name")))
    return monitor.consistency(stored, truth, "pk_customer")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    out = monitor.latency(read(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("avg", "p95", "p99")])


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max, count(*) FILTER (WHERE value > 100) AS slow FROM events GROUP BY 1")
def hourly_summary(spark, sf_dir):
    return monitor.hourly(read(spark, sf_dir, "events"), "ts", "value").withColumn("avg", F.round("avg", 6))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min FROM events GROUP BY 1")
def daily_summary(spark, sf_dir):
    return monitor.daily(read(spark, sf_dir, "events"), "ts", "value").withColumn("avg", F.round("avg", 6))


NAMES = ("id", "user_id", "uuid_of", "title", "this_x", "fk_user", "backupk_x", "order_count", "created_at", "is_done", "has_x", "xis_done", "was_deleted", "other")


@query(f"""SELECT name, CASE WHEN name = 'id' OR ends_with(name, '_id') OR contains(name, 'uuid') THEN 'UUID' WHEN regexp_matches(name, 'name|title|text|description|email') THEN 'TEXT'
WHEN starts_with(name, 'pk_') OR starts_with(name, 'fk_') OR regexp_matches(name, 'count|number|size') THEN 'INTEGER' WHEN regexp_matches(name, 'date|time|created|updated') THEN 'TIMESTAMP'
WHEN starts_with(name, 'is_') OR starts_with(name, 'has_') OR regexp_matches(name, 'active|enabled|deleted') THEN 'BOOLEAN' ELSE 'UUID' END AS type FROM (SELECT unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS name UNION ALL SELECT column_name FROM (DESCRIBE orders) UNION ALL SELECT column_name FROM (DESCRIBE customer))""")
def schema_inference(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    names = [*NAMES, *e.table("orders").columns, *e.table("customer").columns]
    return spark.createDataFrame([(n, type_of_name(n)) for n in names], "name string, type string")


# models of other shapes --------------------------------------------------------------------------


@query("""WITH t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 0 THEN c_custkey // 2 END AS parent, CASE WHEN c_custkey % 97 = 0 THEN c_name || '_x' ELSE c_name END AS name FROM customer)
SELECT CAST(c.id AS BIGINT) AS pk_tree, CAST(c.parent AS BIGINT) AS fk_parent, c.name, p.name AS parent FROM t c LEFT JOIN t p ON p.id = c.parent""")
def tree_model(spark, sf_dir):
    """A table in two roles: rows and their parents."""
    e = w.engine(spark, sf_dir)
    w.derived(e, "tree", e.table("customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "CAST(CASE WHEN c_custkey > 0 THEN c_custkey DIV 2 END AS BIGINT) AS parent", "c_name AS name"), "id", "tree")
    e.create("tv_tree", "SELECT c.id AS pk_tree, c.parent AS fk_parent, named_struct('name', c.name, 'parent', p.name) AS data FROM tree c LEFT JOIN tree p ON p.id = c.parent", "tree", fks={"fk_parent": "tree"})
    e.apply(lambda t: t.update("tree", "id % 97 = 0", {"name": "concat(name, '_x')"}))
    return e.table("tv_tree").select("pk_tree", "fk_parent", "data.name", "data.parent")


@query("""SELECT 'o-' || o_orderkey AS pk_sale, 'c-' || o_custkey AS fk_buyer, o_orderstatus AS status, CASE WHEN o_custkey % 97 = 0 THEN c_name || '_x' ELSE c_name END AS buyer
FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 101 <> 0""")
def string_keys(spark, sf_dir):
    e = w.engine(spark, sf_dir)
    w.derived(e, "buyers", e.table("customer").selectExpr("concat('c-', c_custkey) AS id", "c_name AS name"), "id", "buyer")
    w.derived(e, "sales", e.table("orders").selectExpr("concat('o-', o_orderkey) AS id", "concat('c-', o_custkey) AS buyer", "o_orderstatus AS status"), "id", "sale", {"buyer": "buyer"})
    e.create("tv_buyer", "SELECT id AS pk_buyer, named_struct('name', name) AS data FROM buyers", "buyers")
    e.create("tv_sale", "SELECT id AS pk_sale, buyer AS fk_buyer, named_struct('status', status, 'buyer', v_buyer.data) AS data FROM sales LEFT JOIN v_buyer ON v_buyer.pk_buyer = buyer", "sales")
    e.apply(lambda t: t.update("buyers", "CAST(substring(id, 3) AS BIGINT) % 97 = 0", {"name": "concat(name, '_x')"}).delete("sales", "CAST(substring(id, 3) AS BIGINT) % 101 = 0"))
    return e.table("tv_sale").select("pk_sale", "fk_buyer", "data.status", F.col("data.buyer.name").alias("buyer"))


@query(f"WITH {NATION_7} SELECT CAST(c_custkey AS BIGINT) AS pk_plain, n_name AS nation FROM customer LEFT JOIN nation_m ON n_nationkey = c_nationkey")
def uncovered_source(spark, sf_dir):
    """A source that no key of the model names: its changes make the model be evaluated whole."""
    e = w.engine(spark, sf_dir)
    e.create("tv_plain", "SELECT CAST(c_custkey AS BIGINT) AS pk_plain, named_struct('nation', n.n_name) AS data FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey", "customer")
    e.apply(lambda t: t.update("nation", "n_nationkey = 7", {"n_name": "n_name || '_x'"}))
    return e.table("tv_plain").select("pk_plain", "data.nation")


@query(f"SELECT *, true AS conflict FROM ({customers_sql(customer='customer_m', ctes=CUSTOMER_97)})")
def prepared_conflict(spark, sf_dir):
    """A prepared change of rows that another commit has changed since is refused."""
    e = w.customers(spark, sf_dir)
    e.begin().update("customer", "c_custkey % 97 = 0", {"c_name": "'lost'"}).prepare("g3")
    e.apply(lambda t: t.update("customer", "c_custkey % 97 = 0", {"c_acctbal": "c_acctbal + 1"}))
    try:
        e.commit_prepared("g3")
        refused = False
    except LockConflict:
        refused = True
    return w.flat_customers(e.table("tv_customer")).withColumn("conflict", F.lit(refused))


@query(f"SELECT *, 'patch' AS strategy FROM ({customers_sql(nation='nation_m', ctes=NATION_7)})")
def smart_patch(spark, sf_dir):
    """A change of an embedded document patches its field in the stored rows."""
    e = w.customers(spark, sf_dir)
    t = e.begin().update("nation", "n_nationkey = 7", {"n_name": "n_name || '_x'"})
    t.commit()
    return w.flat_customers(e.table("tv_customer")).withColumn("strategy", F.lit(t.strategies["tv_customer"]))


@query("SELECT CAST(n_nationkey AS BIGINT) AS pk_old, md5('nation:' || n_nationkey) AS id, n_name AS name, 'region' AS bases FROM nation")
def convert_model(spark, sf_dir):
    """A stored table becomes a model; the tables it comes from are found in its documents."""
    e = w.engine(spark, sf_dir)
    path = f"{e.path}/old"
    e.table("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS pk_old", "md5(concat('nation:', n_nationkey)) AS id", "named_struct('name', n_name, 'fk_region', n_regionkey) AS data").write.parquet(path)
    e.convert("tv_old", path)
    found = [s for s in e.models["tv_old"].sources if s != "tv_old_rows"]
    return e.table("tv_old").select("pk_old", "id", "data.name", F.lit(",".join(found)).alias("bases"))


# more of the relational surface ------------------------------------------------------------------


def both(text: str):
    """A query whose text is the same for both engines, over the base tables."""

    def add(f):
        def run(spark, sf_dir):
            return w.engine(spark, sf_dir).sql(text)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(text)(run)

    return add


@query("SELECT CAST(n_nationkey AS BIGINT) AS pk_nation, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0")
def array_membership(spark, sf_dir):
    """pk = ANY(array): exploded and joined on the key."""
    e = w.engine(spark, sf_dir)
    e.create("tv_members", "SELECT CAST(n_nationkey AS BIGINT) AS pk_members, coalesce(k.ids, array()) AS ids, named_struct('name', n_name) AS data FROM nation LEFT JOIN (SELECT c_nationkey, array_sort(collect_list(c_custkey)) AS ids FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey) k ON k.c_nationkey = n_nationkey", "nation", children={"customer": "c_nationkey"})
    return e.sql("SELECT pk_members AS pk_nation, c_custkey FROM (SELECT pk_members, explode(ids) AS one FROM tv_members) m JOIN customer ON c_custkey = m.one")


@both("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey = c_custkey) t")
def lateral_join(): ...


@both("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open, coalesce((SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey), -1) AS last_order FROM customer")
def scalar_subquery(): ...


@both("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT c_custkey AS k, c_mktsegment AS segment FROM customer) SELECT k, segment, n, CASE WHEN n > 12 THEN 'many' WHEN n > 8 THEN 'some' ELSE 'few' END AS label, concat(CAST(100 * n // 20 AS VARCHAR(10)), '%') AS share FROM a JOIN b USING (k)".replace("100 * n // 20", "5 * n"))
def cte_using(): ...


@both("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 500")
def limit_offset(): ...


@query("WITH RECURSIVE r(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), depth + 1 FROM customer JOIN r ON c_custkey // 3 = r.id WHERE c_custkey > 0 AND depth < 12) SELECT depth, count(*) AS n, min(id) AS first FROM r GROUP BY depth")
def recursive_cte(spark, sf_dir):
    return w.engine(spark, sf_dir).sql("WITH RECURSIVE r(id, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), depth + 1 FROM customer JOIN r ON c_custkey DIV 3 = r.id WHERE c_custkey > 0 AND depth < 12) SELECT depth, count(*) AS n, min(id) AS first FROM r GROUP BY depth")


QUEUE = "SELECT CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS place, event_type AS status, count(*) AS n, count(*) FILTER (WHERE value > 50) AS long, round(max(value), 4) AS longest FROM events GROUP BY event_type ORDER BY 1, 2"


@query(QUEUE)
def queue_table_stats(spark, sf_dir):
    return lineage.bound(spark, QUEUE, {"events": read(spark, sf_dir, "events")})


@query("SELECT CAST(k AS BIGINT) AS k, md5('seed:' || k) AS id, CAST(DATE '2024-01-01' + CAST(k AS INTEGER) AS DATE) AS day FROM range(1, 1001) t(k)")
def generated_series(spark, sf_dir):
    """Generated rows with ids that don't change from read to read."""
    return spark.range(1, 1001).select(F.col("id").alias("k"), F.md5(F.concat(F.lit("seed:"), F.col("id"))).alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"))


@query("SELECT event_id, json_type(props) = 'OBJECT' AS is_object, list_contains(json_keys(props), 'k') AS has_k, CAST(len(json_keys(props)) AS INTEGER) AS n_keys FROM events")
def json_surface(spark, sf_dir):
    p = F.col("props")
    return read(spark, sf_dir, "events").select("event_id", (docs.type_of_json(p) == "object").alias("is_object"), docs.key_exists(p, "k").alias("has_k"), F.size(F.json_object_keys(p)).alias("n_keys"))


@query("SELECT o_orderkey, length(o_orderpriority) AS n, repeat(o_orderstatus, 3) AS thrice, replace(o_orderpriority, '-', '_') AS plain, lower(o_orderpriority) AS low, split_part(o_orderpriority, '-', 1) AS head, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS seconds, CAST(year(o_orderdate) AS INTEGER) AS y FROM orders")
def text_and_date_functions(spark, sf_dir):
    return w.engine(spark, sf_dir).sql("SELECT o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS n, repeat(o_orderstatus, 3) AS thrice, replace(o_orderpriority, '-', '_') AS plain, lower(o_orderpriority) AS low, split_part(o_orderpriority, '-', 1) AS head, unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS seconds, year(o_orderdate) AS y FROM orders")


@query("SELECT 'customer' AS source, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS items FROM customer UNION ALL SELECT 'orders', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders")
def union_listagg(spark, sf_dir):
    return w.engine(spark, sf_dir).sql("SELECT 'customer' AS source, listagg(DISTINCT c_mktsegment, ',') WITHIN GROUP (ORDER BY c_mktsegment) AS items FROM customer UNION ALL SELECT 'orders', listagg(DISTINCT o_orderpriority, ',') WITHIN GROUP (ORDER BY o_orderpriority) FROM orders")


@query(basket_sql("CASE WHEN id = lo THEN 7 WHEN id = hi THEN 9 ELSE qty END"))
def array_merge_batch(spark, sf_dir):
    """Updates as elements of their own, merged by key."""
    b = basket_docs(spark, sf_dir)
    one = lambda k, q: F.struct(k.alias("id"), F.lit(q).cast("long").alias("qty"))
    updates = F.array(one(F.array_min("items.id"), 7), one(F.array_max("items.id"), 9))
    return b.select("l_orderkey", pairs(docs.merge_elements(F.col("items"), "id", updates, ["qty"])).alias("items"))


# hand-written refreshes --------------------------------------------------------------------------


def part_docs(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    price = F.struct(F.col("p_retailprice").alias("base"), F.col("p_retailprice").alias("current"), F.lit(0.0).alias("discount_pct"))
    return p.select("p_partkey", F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), price.alias("price")).alias("data"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS base, round(CASE WHEN p_partkey % 10 = 0 THEN p_retailprice * 0.9 ELSE p_retailprice END, 2) AS current, CAST(CASE WHEN p_partkey % 10 = 0 THEN 10 ELSE 0 END AS DOUBLE) AS discount_pct FROM part")
def manual_field_patch(spark, sf_dir):
    p = part_docs(spark, sf_dir)
    cheap = F.col("p_partkey") % 10 == 0
    now = F.col("data.price.current")
    base = F.col("data.price.base")
    new = F.when(cheap, now * 0.9).otherwise(now)
    pct = F.coalesce(F.round((base - new) / F.nullif(base, F.lit(0.0)) * 100, 0), F.lit(0.0))
    p = p.withColumn("data", docs.merge_at(F.col("data"), "price", {"current": new, "discount_pct": pct}))
    return p.select("p_partkey", F.round("data.price.base", 2).alias("base"), F.round("data.price.current", 2).alias("current"), "data.price.discount_pct")


@query("SELECT p_partkey, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN p_brand || '_x' ELSE p_brand END AS brand FROM part")
def category_cascade(spark, sf_dir):
    """All documents that hold the first brand get its new name; the brand's row is a scalar subquery."""
    read(spark, sf_dir, "part").createOrReplaceTempView("docweave_part")
    first = spark.sql("SELECT min(p_brand) AS brand, concat(min(p_brand), '_x') AS name FROM docweave_part")
    p = part_docs(spark, sf_dir).withColumn("fk_category", F.col("data.brand.name")).withColumn("data", F.struct(F.col("data.brand").alias("category")))
    p = manual.refresh_product(p, "category", "name", first.withColumnRenamed("brand", "fk_category"))
    spark.catalog.dropTempView("docweave_part")
    return p.select("p_partkey", F.col("data.category.name").alias("brand"))


def product_docs(spark, sf_dir) -> DataFrame:
    """Products with price, a supplier that one in seven lacks, and stock."""
    p = read(spark, sf_dir, "part")
    price = F.struct(F.col("p_retailprice").alias("base"), F.col("p_retailprice").alias("current"), F.lit(0.0).alias("discount_pct"))
    stock = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("quantity", "reserved", "available")])
    none = F.lit(None).cast("struct<id:bigint,name:string>")
    return p.select(F.col("p_partkey").alias("pk_product"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_partkey") % 10).alias("fk_supplier"), F.struct(F.lit("new").alias("status"), price.alias("price"), none.alias("supplier"), stock.alias("inventory")).alias("data"))


@query("SELECT p_partkey AS pk_product, CAST(s_suppkey AS BIGINT) AS supplier_id, s_name AS supplier FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 10 AND p_partkey % 7 > 0")
def supplier_cascade(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fk_supplier"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    p = manual.refresh_product(product_docs(spark, sf_dir), "supplier", "name", s)
    return p.select("pk_product", F.col("data.supplier.id").alias("supplier_id"), F.col("data.supplier.name").alias("supplier"))


@query("SELECT p_partkey AS pk_product, coalesce(q, 0) AS quantity, coalesce(r, 0) AS reserved, coalesce(q - r, 0) AS available FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS r FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey")
def inventory_cascade(spark, sf_dir):
    s = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pk_product")).agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("reserved"))
    p = manual.refresh_product(product_docs(spark, sf_dir), "inventory", "quantity", s)
    return p.select("pk_product", "data.inventory.quantity", "data.inventory.reserved", "data.inventory.available")


@query("""SELECT count(*) AS n, count(s_suppkey) AS with_supplier, CAST(0 AS BIGINT) AS in_stock, count(*) FILTER (WHERE p_partkey % 10 = 0) AS discounted, count(*) FILTER (WHERE p_partkey % 4 = 0) AS gone
FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 10 AND p_partkey % 7 > 0""")
def manual_dispatch(spark, sf_dir):
    """Changes of several kinds in turn, then the counts of what they made."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fk_supplier"), F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("name"))
    part = read(spark, sf_dir, "part")
    p = product_docs(spark, sf_dir)
    p = manual.refresh_product(p, "product", "price_current", part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("pk_product"), (F.col("p_retailprice") * 0.8).alias("value")))
    p = manual.refresh_product(p, "product", "status", part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("pk_product"), F.lit("gone").alias("value")))
    p = manual.refresh_product(p, "supplier", "name", s)
    return manual.counts(p, F.count_if(F.col("data.status") == "gone").alias("gone"))


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / nullif(count(o_orderkey), 0), 0.0) AS avg FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 13 <> 0 GROUP BY c_custkey")
def review_recount(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("avg")).alias("reviews"))
    s = read(spark, sf_dir, "orders").where("o_orderkey % 13 <> 0").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double") / F.count("*")).alias("a"))
    c = c.join(s, c.c_custkey == s.o_custkey, "left")
    c = c.withColumn("reviews", docs.merge_at(F.col("reviews"), "", {"n": F.coalesce("n", F.lit(0).cast("long")), "avg": F.coalesce("a", F.lit(0.0))}))
    return c.select("c_custkey", "reviews.n", "reviews.avg")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Full refresh of the customer read model against incremental batches of growing size (single key, cascade,
bulk), as ratios to the full refresh, and a few relational and document queries.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    import docweave.queries as core
    from docweave.operators import workload as w

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.checkpoint.dir", f"file://{shared}")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("OFF")
        took: dict[str, float] = {}

        def timed(name, f):
            t = time.perf_counter()
            out = f()
            took[name] = round(time.perf_counter() - t, 3)
            return out

        e = timed("create_models", lambda: w.customers(spark, sf_dir))
        timed("full_refresh", lambda: e.refresh("tv_customer"))
        timed("single_key", lambda: e.apply(lambda t: t.update("customer", "c_custkey = 17", {"c_acctbal": "c_acctbal + 1"})))
        timed("cascade_nation", lambda: e.apply(lambda t: t.update("nation", "n_nationkey = 7", {"n_name": "concat(n_name, '_x')"})))
        for n in (100, 1000, 10000):
            timed(f"bulk_{n}", lambda n=n: e.apply(lambda t: t.update("orders", f"o_orderkey <= {n}", {"o_totalprice": "o_totalprice * 0.9"})))
        e2 = timed("create_chain", lambda: w.chain(spark, sf_dir, items=False))
        timed("deep_cascade", lambda: e2.apply(lambda t: t.update("region", "r_regionkey = 2", {"r_name": "concat(r_name, '_x')"})))
        for name in ("order_stats_filter", "customer_recent_orders", "array_update_batch", "latency_percentiles", "has_children", "hourly_summary"):
            timed(name, lambda name=name: core.Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
        full = took["full_refresh"]
        ratios = {k: round(took[k] / full, 3) for k in took if k.startswith(("single", "cascade", "bulk"))}
        rows = e.table("tv_customer").count()
        print(json.dumps({"metric": "read_model_suite", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ratio_to_full_refresh": ratios, "full_refresh_rows_per_sec": round(rows / full), "sf": os.path.basename(sf_dir.rstrip("/"))}))
        spark.stop()


if __name__ == "__main__":
    main()

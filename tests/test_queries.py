import duckdb
import pytest

import docweave.queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: The others take longer; the driver runs them all.
QUICK = "create_raw_select order_items_array customer_recent_orders order_stats_filter nation_array_column active_model_filter has_children join_kinds patch_nested patch_scalar patch_array array_insert array_delete array_contains array_update_path array_update_batch set_path extract_id refresh_reparent savepoint_rollback latency_percentiles hourly_summary daily_summary schema_inference cascade_path cascade_impact manual_field_patch category_cascade review_recount".split()


def plain(v):
    return round(v, 4) if isinstance(v, float) else str(v) if hasattr(v, "year") else v


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = core.Q[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(core.SQL[name])
    at = list(rel.columns)
    assert sorted(at) == columns
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_sql():
    assert core.Q.keys() == core.SQL.keys()

"""Queries against their check SQL, on inputs where they failed or differed."""

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry
from test_queries import FOLDER, rows
from tidepanel.sources.tables import NAMES


def compared(spark, name, folder):
    """Rows of a query and of its SQL, over the tables that a folder has."""
    import os
    d = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in NAMES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(d.columns)
    return rows(d.columns, [tuple(r) for r in d.collect()]), rows(cols, cur.fetchall())


def test_top_n_by_year(spark):
    got, want = compared(spark, "win_rank_topn", FOLDER)
    assert got == want and got


def test_largest_class_of_far_keys(spark, tmp_path):
    """Keys above 100,000 outweigh a cent in the order of the SQL."""
    pd.DataFrame({"c_custkey": [10, 200_000, 5, 7], "c_nationkey": [1, 1, 2, 2], "c_acctbal": [99.99, 100.0, 8.5, 8.5]}).to_parquet(f"{tmp_path}/customer.parquet")
    got, want = compared(spark, "agg_first_by_order", str(tmp_path))
    assert got == want


def test_har_of_a_key_with_few_rows(spark, tmp_path):
    """A supplier with fewer than 100 training rows gets no forecast in the SQL, and its rows stay."""
    days = pd.date_range("1996-01-01", "1997-06-30")
    g = np.random.default_rng(0)
    few = pd.DataFrame({"l_suppkey": 1, "l_shipdate": days[-150:]})
    most = pd.DataFrame({"l_suppkey": 2, "l_shipdate": days})
    d = pd.concat([few, most], ignore_index=True)
    d["l_extendedprice"], d["l_quantity"] = g.uniform(100, 1000, len(d)).round(2), 1.0
    d["l_shipdate"] = d["l_shipdate"].astype("datetime64[us]")
    d.to_parquet(f"{tmp_path}/lineitem.parquet")
    got, want = compared(spark, "fc_har_wide", str(tmp_path))
    assert got == want and len(got) > 300

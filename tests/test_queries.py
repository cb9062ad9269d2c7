"""The registry and a sample of queries against their check SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidepanel.sources.tables import NAMES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["src_bars", "snk_json_map", "flt_minlen_group", "prj_ffill", "jn_asof_ffill", "jn_next_event", "agg_quantiles", "agg_marginal_row", "win_mad_scale",
          "win_episodes", "win_rank_xs", "set_intersect_keys", "set_dedup_news", "sc_effective_date", "sc_text_clean", "pn_universe_pit", "ft_deseason", "ft_novelty",
          "rg_transition", "fc_hedge", "fc_ridge", "cf_dtaci", "cf_panel_fixed", "ev_classif", "in_cluster_se", "in_cc", "udf_membership"]


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


def test_registry_is_complete():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert len(qs) >= 290 and set(sql) <= set(qs) and len(sql) >= 270


def test_entry(spark):
    d = entry.entry(spark)
    assert d.columns == ["state_bin", "coverage", "upper_coverage", "lower_coverage", "n", "mean_width"] and d.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    d = entry.queries()[name](spark, FOLDER)
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(d.columns)
    assert rows(d.columns, [tuple(r) for r in d.collect()]) == rows(cols, cur.fetchall())

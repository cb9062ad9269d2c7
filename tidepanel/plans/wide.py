"""Headline operators on a wide panel: one row per supplier and day.

The panels of region and nation have as many rows at any scale factor as the
calendar has days. This one grows with the data (about 550,000 rows at scale factor
0.1), so it shows what the same operators cost per row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import Tables
from .registry import PANEL_A, PANEL_B, REGISTRY, query


class WideTables(Tables):
    """Both panels are supplier x day."""

    def _wide(self):
        rows = self.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("key"), F.to_date("l_shipdate").alias("date"))
        return rows.agg(F.log(F.sum("l_extendedprice")).alias("x"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))

    def panel_a(self):
        return self._wide()

    def panel_b(self):
        return self._wide()


def _sql(name: str) -> str:
    return f"""{name} AS (SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(l_shipdate AS DATE) AS date,
 ln(sum(l_extendedprice)) AS x, sum(l_quantity) AS qty, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2)"""


WIDE = ["fc_har", "fc_hedge", "cf_aci", "cf_panel_fixed", "cf_panel_adaptive", "cf_var_head", "fc_gbt_reg",
        "win_roll_median", "win_roll_quantile", "win_mad_scale", "win_trailing_pctl"]


def _register(name: str) -> None:
    plain = REGISTRY[name]
    sql = plain.sql and plain.sql.replace(PANEL_A, _sql("pa")).replace(PANEL_B, _sql("pb"))

    @query(f"{name}_wide", sql)
    def run(t):
        return plain.run(WideTables(t.spark, t.folder))


for _name in WIDE:
    _register(_name)

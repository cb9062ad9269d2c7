"""Extension points: forecasters, grouped functions, score columns, memberships,
stream functions and aggregates supplied by the caller."""

import pandas as pd
from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import extend as X
from ..operators import pooled as PO
from ..operators import steps as S
from .calibration import WARM, preds, recursion
from .forecasts import BASE, H3, SPLIT, design_a, split_day
from .linear_sql import gram_cte, predict_sql, solve_cte
from .pooled import DAYS, IVD, by_date, fixed_states, member, shown, std_rows
from .registry import PANEL_A, query


@query("udf_forecaster", f"{BASE}, " + gram_cte("g", "h", ["key"], H3, "y", f"ydate < DATE '{SPLIT}'", lam="1.0") + ", " + solve_cte("b", "g", ["key"], 3) + f" SELECT h.key AS key, date, r4(rv_w) AS naive, r4({predict_sql(H3)}) AS ridge FROM h JOIN b ON h.key = b.key WHERE date >= DATE '{SPLIT}'")
def udf_forecaster(t):
    """Two forecasters behind the same two methods."""
    d = design_a(t)
    cut = split_day()
    out = X.run_forecasters(d, {"ridge": X.RidgeByKey(H3, "y", 1.0), "naive": X.Carry("rv_w")}, F.col("ydate") < cut, F.col("date") >= cut)
    return out.select("key", "date", rnd("naive", 4).alias("naive"), rnd("ridge", 4).alias("ridge"))


@query("udf_group_map", f"WITH {PANEL_A}, r AS (SELECT key, date, x, min(x) OVER (PARTITION BY key ORDER BY date) AS lo, max(x) OVER (PARTITION BY key ORDER BY date) AS hi FROM pa) SELECT key, date, r6((x - lo) / nullif(hi - lo, 0)) AS position FROM r")
def udf_group_map(t):
    def position(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        lo, hi = pdf["x"].cummin(), pdf["x"].cummax()
        return pdf[["key", "date"]].assign(position=((pdf["x"] - lo) / (hi - lo).where(hi > lo)))
    d = X.per_entity(t.panel_a().select("key", "date", "x"), position, "key string, date date, position double")
    return d.select("key", "date", rnd(F.nanvl("position", F.lit(None).cast("double"))).alias("position"))


SC = ", sy AS (SELECT z.*, s * 2.0 AS own FROM z WHERE s_std IS NOT NULL)"


@query("udf_score_col", by_date(fixed_states((0.002,) * 3), "k0 * PI0 + k1 * PI1 + k2 * PI2", src="sy", score="own", more=SC) + "SELECT key, sy.date AS date, r4(q_lo) AS q_lo, r4(q_hi) AS q_hi, own <= q_hi AND -own <= q_lo AS covered, warmup FROM sy JOIN th ON sy.date = th.date")
def udf_score_col(t):
    """Any column expression as the score of the pooled calibrator."""
    d = X.with_score(std_rows(t), F.col("s") * 2.0)
    out, _ = PO.run_pooled(d, member(t), 3, {"own": PO.FixedWalk(0.1, 0.002)}, 0.1, DAYS)
    return shown(out).drop("width")


@query("udf_membership", by_date({"k0": ("Q0", "k0 + 0.004::DOUBLE * (CASE WHEN month(f.date) <= 6 THEN 1::DOUBLE ELSE 0::DOUBLE END) * (MISSES - 0.05::DOUBLE * N)"),
                                  "k1": ("Q0", "k1 + 0.01::DOUBLE * (CASE WHEN month(f.date) <= 6 THEN 0::DOUBLE ELSE 1::DOUBLE END) * (MISSES - 0.05::DOUBLE * N)")},
                                 "(CASE WHEN month(f.date) <= 6 THEN k0 ELSE k1 END)", pi=False) + IVD)
def udf_membership(t):
    """Any (date, pi) frame as the membership: here the halves of the year."""
    d = std_rows(t)
    m = X.membership(d, F.when(F.month("date") <= 6, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    out, _ = PO.run_pooled(d, m, 2, {"half": PO.FixedWalk(0.1, (0.004, 0.01))}, 0.1, DAYS)
    return shown(out)


@query("udf_stream_fn", recursion({"q": ("Q0", "least(greatest(q + 0.1::DOUBLE * (MISS - 0.05::DOUBLE), 0.1::DOUBLE), 1.5::DOUBLE)")}, "q") + "SELECT key, date, r6(q_lo) AS q_lo, r6(q_hi) AS q_hi, warmup FROM iv")
def udf_stream_fn(t):
    """A rule written by the caller: a tracker kept inside fixed bounds."""
    rule = S.Rule(lambda q0, n, k: X.vector(q0), lambda st, c: st[0],
                  lambda st, c, s, q: X.vector(min(max(st[0] + 0.1 * (float(s > q) - 0.05), 0.1), 1.5)))
    d = S.fold(preds(t), {"own": rule}, 0.1, WARM)
    return d.select("key", "date", rnd("q_lo").alias("q_lo"), rnd("q_hi").alias("q_hi"), "warmup")


@query("udf_agg", f"WITH {PANEL_A} SELECT key, r6(exp(avg(ln(x)))) AS geo_mean, r6(sqrt(avg(x * x))) AS root_mean_square FROM pa GROUP BY 1")
def udf_agg(t):
    """Own aggregates stay column expressions, so they combine map-side."""
    return t.panel_a().groupBy("key").agg(rnd(X.geometric_mean("x")).alias("geo_mean"), rnd(X.root_mean_square("x")).alias("root_mean_square"))

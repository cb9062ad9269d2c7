"""Projections, filters and cleaning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import clip, finite, ratio, rnd
from ..operators import frames as fr
from ..operators import intervals as IV
from ..operators.ranks import quantiles
from .registry import PANEL_A, query


@query("prj_rename", """SELECT 2024 AS year, c_custkey AS id, c_name AS name FROM customer""")
def prj_rename(t):
    return t.customer.select(F.lit(2024).alias("year"), F.col("c_custkey").alias("id"),
                             F.col("c_name").alias("name"))


@query("flt_range", """SELECT o_orderkey FROM orders
 WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def flt_range(t):
    # the bounds are kept on the raw column so that they reach the scan
    return t.spark.read.parquet(t.path("orders")).filter(
        (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))).select("o_orderkey")


@query("flt_in", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def flt_in(t):
    return t.nation.filter(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


VALID_SQL = """spans AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS a,
 max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)"""


def validity_spans(t):
    d = F.to_date("o_orderdate")
    return t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min(d).alias("a"), F.max(d).alias("b"))


@query("flt_validity", f"""WITH {VALID_SQL} SELECT id, a, b FROM spans
 WHERE a <= DATE '1998-06-30' AND b >= DATE '1998-06-30'""")
def flt_validity(t):
    day = F.lit("1998-06-30").cast("date")
    return validity_spans(t).filter((F.col("a") <= day) & (F.col("b") >= day))


@query("flt_validity_range", f"""WITH {VALID_SQL}, d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
 SELECT date, CAST(count(*) AS BIGINT) AS n_valid, min(id) AS first_id FROM d JOIN spans ON a <= date AND b >= date GROUP BY 1""")
def flt_validity_range(t):
    """The rows that are valid on each day of a calendar."""
    days = t.lineitem.select(F.to_date("l_shipdate").alias("date"))
    facts = {"n_valid": F.count(F.lit(1)), "first_id": F.min("id")}
    return IV.by_point(days, validity_spans(t), "date", "a", "b", facts, {"n_valid": F.sum, "first_id": F.min})


LAGGED_SQL = f"WITH {PANEL_A}, l AS (SELECT *, lag(x) OVER (PARTITION BY key ORDER BY date) AS lx FROM pa)"


def lagged(t):
    return t.panel_a().withColumn("lx", F.lag("x").over(fr.by_key()))


@query("flt_dropna", f"{LAGGED_SQL} SELECT key, date, r6(lx) AS lx FROM l WHERE lx IS NOT NULL")
def flt_dropna(t):
    return lagged(t).dropna(subset=["lx"]).select("key", "date", rnd("lx").alias("lx"))


@query("flt_inf_null", """SELECT event_id, r6(CASE WHEN value > 100 THEN NULL ELSE value END) AS v
 FROM events""")
def flt_inf_null(t):
    spiky = F.when(F.col("value") > 100, F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", rnd(finite(spiky)).alias("v"))


@query("flt_minlen_group", """SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders
 GROUP BY 1 HAVING count(*) > 12 AND count(DISTINCT o_orderdate) >= 10""")
def flt_minlen_group(t):
    return (t.orders.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("o_custkey").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"))
            .filter((F.col("n") > 12) & (F.col("d") >= 10)).select("o_custkey", "n"))


@query("flt_drop_first_n", f"""WITH {PANEL_A} SELECT key, date, r6(x) AS x FROM pa
 QUALIFY row_number() OVER (PARTITION BY key ORDER BY date) > 22""")
def flt_drop_first_n(t):
    return (t.panel_a().withColumn("rn", F.row_number().over(fr.by_key()))
            .filter("rn > 22").select("key", "date", rnd("x").alias("x")))


@query("flt_warmup", f"""{LAGGED_SQL}, w AS (SELECT key, date,
 CASE WHEN lx IS NULL THEN NULL ELSE date < DATE '1996-01-01' END AS warmup FROM l)
 SELECT key, date FROM w WHERE NOT coalesce(warmup, false)""")
def flt_warmup(t):
    flag = F.when(F.col("lx").isNotNull(), F.col("date") < F.lit("1996-01-01").cast("date"))
    return (lagged(t).withColumn("warmup", flag)
            .filter(~F.coalesce("warmup", F.lit(False))).select("key", "date"))


@query("prj_coerce", """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN event_type
 ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events""")
def prj_coerce(t):
    raw = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(
        F.get_json_object("props", "$.k"))
    return t.events.select("event_id", raw.try_cast("double").alias("k"))


@query("prj_fallback", f"{LAGGED_SQL} SELECT key, date, r6(coalesce(abs(lx), abs(x))) AS v FROM l")
def prj_fallback(t):
    return lagged(t).select("key", "date", rnd(F.coalesce(F.abs("lx"), F.abs("x"))).alias("v"))


@query("prj_fill_const", f"""{LAGGED_SQL} SELECT key, date, r6(coalesce(lx, 20)) AS a,
 r6(coalesce(lx, (SELECT avg(lx) FROM l))) AS b FROM l""")
def prj_fill_const(t):
    d = lagged(t)
    d = fr.with_scalars(d, d.agg(F.avg("lx").alias("m")))
    return d.select("key", "date", rnd(F.coalesce("lx", F.lit(20.0))).alias("a"),
                    rnd(F.coalesce("lx", "_g.m")).alias("b"))


GAPS_SQL = f"WITH {PANEL_A}, g AS (SELECT key, date, CASE WHEN qty > 60 THEN x END AS x FROM pa)"


def gaps(t):
    return t.panel_a().withColumn("x", F.when(F.col("qty") > 60, F.col("x")))


@query("prj_ffill", f"""{GAPS_SQL} SELECT key, date, r6(coalesce(last_value(x IGNORE NULLS) OVER
 (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING), 50)) AS v FROM g""")
def prj_ffill(t):
    f = F.last("x", ignorenulls=True).over(fr.by_key().rowsBetween(Window.unboundedPreceding, 0))
    return gaps(t).select("key", "date", rnd(F.coalesce(f, F.lit(50.0))).alias("v"))


@query("prj_bfill", f"""{GAPS_SQL} SELECT key, date, r6(coalesce(
 last_value(x IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS UNBOUNDED PRECEDING),
 first_value(x IGNORE NULLS) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))) AS v
 FROM g""")
def prj_bfill(t):
    w = fr.by_key()
    f = F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("x", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return gaps(t).select("key", "date", rnd(F.coalesce(f, b)).alias("v"))


@query("prj_clip", f"""{LAGGED_SQL} SELECT key, date,
 r6(CASE WHEN lx IS NOT NULL THEN least(greatest(lx, 10), 11) END) AS v FROM l""")
def prj_clip(t):
    return lagged(t).select("key", "date", rnd(clip("lx", 10.0, 11.0)).alias("v"))


@query("prj_interaction", f"""{LAGGED_SQL} SELECT key, date, r6(x * lx) AS a, r6(x * qty / 20.0) AS b FROM l""")
def prj_interaction(t):
    return lagged(t).select("key", "date", rnd(F.col("x") * F.col("lx")).alias("a"),
                            rnd(F.col("x") * F.col("qty") / 20.0).alias("b"))


@query("prj_asym", f"""{LAGGED_SQL} SELECT key, date,
 r6(CASE WHEN x - lx > 0 THEN qty ELSE 0 END) AS up,
 r6(CASE WHEN x - lx < 0 THEN qty ELSE 0 END) AS down,
 r6(CASE WHEN x - lx < 0 THEN (x - lx) * (x - lx) ELSE 0 END) AS neg_sq FROM l""")
def prj_asym(t):
    d = F.col("x") - F.col("lx")
    return lagged(t).select("key", "date", rnd(F.when(d > 0, F.col("qty")).otherwise(0.0)).alias("up"),
                            rnd(F.when(d < 0, F.col("qty")).otherwise(0.0)).alias("down"),
                            rnd(F.when(d < 0, d * d).otherwise(0.0)).alias("neg_sq"))


@query("prj_flags", f"""{LAGGED_SQL} SELECT key, date, coalesce(x > 11, false) AS hot,
 coalesce(x > 11 AND lx > 11, false) AS both_hot, coalesce(x > 11, false) OR n >= 5 AS any_hot FROM l""")
def prj_flags(t):
    hot, lag_hot = F.col("x") > 11, F.col("lx") > 11
    no = F.lit(False)
    return lagged(t).select("key", "date", F.coalesce(hot, no).alias("hot"),
                            F.coalesce(hot & lag_hot, no).alias("both_hot"),
                            (F.coalesce(hot, no) | (F.col("n") >= 5)).alias("any_hot"))


@query("prj_intensity", f"""WITH {PANEL_A} SELECT key, date, r6(qty / (n + 1)) AS per_item,
 r6(x - avg(x) OVER (PARTITION BY key)) AS own_dev FROM pa""")
def prj_intensity(t):
    return t.panel_a().select("key", "date", rnd(ratio("qty", F.col("n") + 1)).alias("per_item"),
                              rnd(F.col("x") - F.avg("x").over(Window.partitionBy("key"))).alias("own_dev"))


@query("flt_quantile", """WITH q AS (SELECT quantile_cont(value, 0.9) AS q, avg(value) AS m,
 stddev_samp(value) AS s FROM events)
 SELECT event_id, value > q AS above, abs(value - m) > 2 * s AS far FROM events, q
 WHERE value > q OR abs(value - m) > 2 * s""")
def flt_quantile(t):
    e = t.events
    cut = quantiles(e, [], "value", [0.9], ["q"])
    d = fr.with_scalars(e, cut, "_q")
    d = fr.with_scalars(d, e.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")))
    above, far = F.col("value") > F.col("_q.q"), F.abs(F.col("value") - F.col("_g.m")) > 2 * F.col("_g.s")
    return d.filter(above | far).select("event_id", above.alias("above"), far.alias("far"))


SHOCK_SQL = f"""WITH {PANEL_A}, v AS (SELECT key, date, qty,
 CASE WHEN count(qty) OVER w >= 5 THEN qty / avg(qty) OVER w END AS shock FROM pa
 WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


@query("prj_attention", f"""{SHOCK_SQL} SELECT key, date, CASE WHEN coalesce(shock, 1) > 1.5 THEN 'high'
 WHEN coalesce(shock, 1) < 0.7 THEN 'low' ELSE 'normal' END AS attention FROM v""")
def prj_attention(t):
    from ..operators.windows import volume_shock
    s = F.col("shock")
    return (t.panel_a().withColumn("shock", volume_shock("qty"))
            .select("key", "date", F.when(s > 1.5, "high").when(s < 0.7, "low")
                    .otherwise("normal").alias("attention")))


@query("prj_stress_defs", f"""WITH {PANEL_A}, m AS (SELECT date, avg(x) AS level, sum(n) AS vol FROM pa GROUP BY 1)
 SELECT date, level >= 11.5 AS lvl_hi, level >= 11 AS lvl_mid, vol >= 8 AS busy,
 (date BETWEEN DATE '1996-03-01' AND DATE '1996-05-31') OR (date BETWEEN DATE '1999-08-01' AND DATE '1999-10-15') AS named
 FROM m""")
def prj_stress_defs(t):
    from ..operators.joins import in_windows
    m = t.panel_a().groupBy("date").agg(F.avg("x").alias("level"), F.sum("n").alias("vol"))
    named = in_windows("date", [("1996-03-01", "1996-05-31"), ("1999-08-01", "1999-10-15")])
    return m.select("date", (F.col("level") >= 11.5).alias("lvl_hi"), (F.col("level") >= 11).alias("lvl_mid"),
                    (F.col("vol") >= 8).alias("busy"), named.alias("named"))

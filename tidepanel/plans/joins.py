"""Joins."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import frames as fr
from ..operators import intervals as IV
from ..operators import joins as J
from .registry import PANEL_A, query

HALF_SQL = f"WITH {PANEL_A}, a AS (SELECT key, date, x FROM pa WHERE x > 10.5), b AS (SELECT key, date, qty FROM pa WHERE qty > 50)"


def halves(t):
    p = t.table_a()
    return p.filter("x > 10.5").select("key", "date", "x"), p.filter("qty > 50").select("key", "date", "qty")


@query("jn_inner", f"{HALF_SQL} SELECT key, date, r6(x) AS x, qty FROM a JOIN b USING (key, date)")
def jn_inner(t):
    a, b = halves(t)
    return a.join(b, ["key", "date"]).select("key", "date", rnd("x").alias("x"), "qty")


@query("jn_left", f"{HALF_SQL} SELECT key, date, r6(x) AS x, qty FROM a LEFT JOIN b USING (key, date)")
def jn_left(t):
    a, b = halves(t)
    return a.join(b, ["key", "date"], "left").select("key", "date", rnd("x").alias("x"), "qty")


@query("jn_date_bcast", f"""WITH {PANEL_A}, m AS (SELECT date, avg(x) AS lvl FROM pa GROUP BY 1)
 SELECT key, pa.date AS date, r6(x - lvl) AS rel FROM pa LEFT JOIN m ON pa.date = m.date""")
def jn_date_bcast(t):
    p = t.table_a()
    m = p.groupBy("date").agg(F.avg("x").alias("lvl"))
    return J.with_market(p, m).select("key", "date", rnd(F.col("x") - F.col("lvl")).alias("rel"))


@query("jn_map", """SELECT s_suppkey, CASE WHEN n_regionkey IN (0, 1, 2) THEN n_name ELSE 'Other' END AS sector
 FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def jn_map(t):
    known = t.nation.filter("n_regionkey in (0,1,2)").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return (fr.attach(t.supplier.select("s_suppkey", "s_nationkey"), known, ["s_nationkey"])
            .select("s_suppkey", F.coalesce("n_name", F.lit("Other")).alias("sector")))


@query("jn_reindex", f"""WITH {PANEL_A}, m AS (SELECT date, avg(x) AS lvl, sum(n) AS v FROM pa GROUP BY 1),
 k AS (SELECT date, lvl > 11 AS hot FROM m WHERE v > 20)
 SELECT m.date AS date, r6(CASE WHEN hot IS NULL THEN 0.5 WHEN hot THEN 0.25 ELSE 0.8 END) AS p0,
 r6(CASE WHEN hot IS NULL THEN 0.5 WHEN hot THEN 0.75 ELSE 0.2 END) AS p1 FROM m LEFT JOIN k ON m.date = k.date""")
def jn_reindex(t):
    m = t.panel_a().groupBy("date").agg(F.avg("x").alias("lvl"), F.sum("n").alias("v"))
    pi = F.when(F.col("lvl") > 11, F.array(F.lit(0.5), F.lit(1.5))).otherwise(F.array(F.lit(1.6), F.lit(0.4)))
    known = m.filter("v > 20").select("date", pi.alias("pi"))
    out = J.uniform_filled(m, known, 2)
    return out.select("date", rnd(F.col("pi")[0]).alias("p0"), rnd(F.col("pi")[1]).alias("p1"))


@query("jn_semi_keys", f"{HALF_SQL} SELECT key, date FROM a SEMI JOIN b USING (key, date)")
def jn_semi_keys(t):
    a, b = halves(t)
    return a.join(b, ["key", "date"], "left_semi").select("key", "date")


@query("jn_semi_slice", f"""WITH {PANEL_A}, s AS (SELECT date FROM pa GROUP BY 1 HAVING avg(x) > 11)
 SELECT key, date FROM pa WHERE date IN (SELECT date FROM s)""")
def jn_semi_slice(t):
    p = t.table_a()
    s = p.groupBy("date").agg(F.avg("x").alias("a")).filter("a > 11").select("date")
    return p.join(s, "date", "left_semi").select("key", "date")


@query("jn_pair", f"""{HALF_SQL}, lng AS (SELECT 'a' AS method, key, date, x AS v FROM a UNION ALL SELECT 'b', key, date, qty FROM b)
 SELECT p.key AS key, p.date AS date, r6(p.v) AS v_a, r6(q.v) AS v_b FROM lng p JOIN lng q
 ON p.key = q.key AND p.date = q.date AND p.method = 'a' AND q.method = 'b'""")
def jn_pair(t):
    a, b = halves(t)
    lng = a.select(F.lit("a").alias("method"), "key", "date", F.col("x").alias("v")).unionByName(
        b.select(F.lit("b").alias("method"), "key", "date", F.col("qty").alias("v")))
    wide = lng.groupBy("key", "date").agg(F.max(F.when(F.col("method") == "a", F.col("v"))).alias("v_a"),
                                          F.max(F.when(F.col("method") == "b", F.col("v"))).alias("v_b"))
    return wide.dropna().select("key", "date", rnd("v_a").alias("v_a"), rnd("v_b").alias("v_b"))


@query("jn_next_obs", f"""WITH {PANEL_A}, s AS (SELECT key, lag(date) OVER (PARTITION BY key ORDER BY date) AS date, x AS x_next FROM pa)
 SELECT key, date, r6(x) AS x, r6(x_next) AS x_next FROM pa JOIN s USING (key, date)""")
def jn_next_obs(t):
    p = t.table_a()
    return p.join(J.next_observation(p, "x", "x_next"), ["key", "date"]).select(
        "key", "date", rnd("x").alias("x"), rnd("x_next").alias("x_next"))


WINDOWS = {"spring": ("1996-03-01", "1996-05-31"), "mid": ("1996-05-01", "1996-08-31"), "late": ("2000-01-01", "2000-12-31")}
WINDOWS_SQL = "win(label, a, b) AS (VALUES " + ", ".join(
    f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in WINDOWS.items()) + ")"


@query("jn_window_range", f"WITH {PANEL_A}, {WINDOWS_SQL} SELECT key, date, label FROM pa JOIN win ON date BETWEEN a AND b")
def jn_window_range(t):
    named = t.spark.createDataFrame([(k, a, b) for k, (a, b) in WINDOWS.items()], "label string, a string, b string")
    named = named.select("label", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    return IV.interval_join(t.panel_a().select("key", "date"), named, "date", "a", "b").select("key", "date", "label")


OPEN_SQL = """wn AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 50 > 0 THEN CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INTEGER) AS DATE) END AS b FROM orders)"""


def order_windows(t):
    """A window for each order, of up to 89 days; some have no end."""
    day = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 50 > 0, F.date_add(day, (F.col("o_orderkey") % 90).cast("int")))
    return t.orders.select(F.col("o_orderkey").alias("id"), day.alias("a"), end.alias("b"))


@query("jn_window_table", f"""WITH {PANEL_A}, {OPEN_SQL}, hit AS (SELECT date, count(*) AS n, min(id) AS first_id, count(b) AS n_ending FROM (SELECT DISTINCT date FROM pa) p JOIN wn ON date >= a AND date <= coalesce(b, DATE '9999-12-31') GROUP BY 1)
 SELECT key, pa.date AS date, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_open, first_id, CAST(coalesce(n_ending, 0) AS BIGINT) AS n_ending FROM pa LEFT JOIN hit ON hit.date = pa.date""")
def jn_window_table(t):
    """Windows of a table that grows with the data, on every row of the panel."""
    p = t.table_a().select("key", "date")
    facts = {"n_open": F.count(F.lit(1)), "first_id": F.min("id"), "n_ending": F.count("b")}
    merge = {"n_open": F.sum, "first_id": F.min, "n_ending": F.sum}
    d = fr.attach(p, IV.by_point(p, order_windows(t), "date", "a", "b", facts, merge), ["date"])
    return d.select("key", "date", F.coalesce("n_open", F.lit(0).cast("long")).alias("n_open"), "first_id", F.coalesce("n_ending", F.lit(0).cast("long")).alias("n_ending"))


FILINGS_SQL = """days AS (SELECT DISTINCT o_custkey AS key, CAST(o_orderdate AS DATE) + INTERVAL 40 DAY AS d FROM orders),
 l AS (SELECT key, CAST(d AS DATE) AS date FROM days),
 r AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY 1, 2)"""


def filings(t):
    day = F.to_date("o_orderdate")
    left = t.orders.select(F.col("o_custkey").alias("key"), F.date_add(day, 40).alias("date")).distinct()
    right = t.orders.groupBy(F.col("o_custkey").alias("key"), day.alias("date")).agg(F.max("o_totalprice").alias("v"))
    return left, right


@query("jn_asof_ffill", f"WITH {FILINGS_SQL} SELECT l.key AS key, l.date AS date, r2(r.v) AS v FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.date >= r.date")
def jn_asof_ffill(t):
    left, right = filings(t)
    return J.asof(left, right, "v", "v").select("key", "date", rnd("v", 2).alias("v"))


@query("jn_next_event", f"""WITH {FILINGS_SQL} SELECT l.key AS key, l.date AS date, CAST(r.date - l.date AS INTEGER) AS days_to
 FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.date < r.date""")
def jn_next_event(t):
    left, right = filings(t)
    return J.next_event(left, right).select("key", "date", F.datediff("next_event", "date").alias("days_to"))


@query("jn_event_flag", f"""WITH {FILINGS_SQL} SELECT l.key AS key, l.date AS date,
 CASE WHEN r.date IS NOT NULL THEN 1 ELSE 0 END AS is_event FROM l LEFT JOIN r ON l.key = r.key AND l.date = r.date""")
def jn_event_flag(t):
    left, right = filings(t)
    return J.event_flag(left, right).select("key", "date", "is_event")

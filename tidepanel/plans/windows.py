"""Window functions, sorting and top-k."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, rnd
from ..operators import frames as fr
from ..operators import panel as P
from ..operators import sliding as SL
from ..operators import windows as W
from ..operators.ranks import with_rank
from .registry import PANEL_A, PANEL_B, query

KD = "SELECT key, date"
OVER = "OVER (PARTITION BY key ORDER BY date)"


def rows(a, b):
    end = "CURRENT ROW" if b == 0 else f"{b} PRECEDING"
    return f"OVER (PARTITION BY key ORDER BY date ROWS BETWEEN {a} PRECEDING AND {end})"


def pa(t, **cols):
    """Panel with the named expressions, rounded."""
    return t.panel_a().select("key", "date", *[rnd(c).alias(k) for k, c in cols.items()])


def sql(**cols):
    return f"WITH {PANEL_A} {KD}, " + ", ".join(f"r6({c}) AS {k}" for k, c in cols.items()) + " FROM pa"


w = fr.by_key


@query("win_lead_target", sql(target=f"lead(x) {OVER}"))
def win_lead_target(t):
    return pa(t, target=F.lead("x").over(w()))


@query("win_lags", sql(l1=f"lag(x,1) {OVER}", l2=f"lag(x,2) {OVER}", l3=f"lag(x,3) {OVER}", l5=f"lag(x,5) {OVER}", f1=f"lead(x,1) {OVER}"))
def win_lags(t):
    return pa(t, **{f"l{k}": F.lag("x", k).over(w()) for k in (1, 2, 3, 5)}, f1=F.lead("x", 1).over(w()))


@query("win_roll_mean_strict", sql(m5=f"CASE WHEN count(x) {rows(4, 0)} = 5 THEN avg(x) {rows(4, 0)} END",
                                   m22=f"CASE WHEN count(x) {rows(21, 0)} = 22 THEN avg(x) {rows(21, 0)} END"))
def win_roll_mean_strict(t):
    return pa(t, m5=W.full_mean("x", 5), m22=W.full_mean("x", 22))


@query("win_roll_mean_loose", sql(m=f"avg(x) {rows(5, 1)}"))
def win_roll_mean_loose(t):
    return pa(t, m=W.mean("x", 5, 1, 1))


@query("win_roll_std", sql(s=f"stddev_samp(x) {rows(5, 1)}"))
def win_roll_std(t):
    return pa(t, s=W.std("x", 5, 2, 1))


RET = f"WITH {PANEL_A}, r AS (SELECT key, date, x, qty, n, x - lag(x) {OVER} AS r FROM pa)"


def returns(t):
    return t.panel_a().withColumn("r", F.col("x") - F.lag("x").over(w()))


@query("win_roll_vol", f"{RET} {KD}, r6(CASE WHEN count(r) {rows(4, 0)} = 5 THEN stddev_samp(r) {rows(4, 0)} * sqrt(252) END) AS vol FROM r")
def win_roll_vol(t):
    return returns(t).select("key", "date", rnd(W.std("r", 5, 5) * 252 ** 0.5).alias("vol"))


def ordered(df, *stats):
    """Key, date and the named statistics, rounded."""
    return SL.with_order_statistics(df, *stats).select("key", "date", *[rnd(s.out).alias(s.out) for s in stats])


@query("win_roll_median", sql(m=f"CASE WHEN count(x) {rows(249, 0)} >= 50 THEN quantile_cont(x, 0.5) {rows(249, 0)} END"))
def win_roll_median(t):
    return ordered(t.panel_a().select("key", "date", "x"), SL.quantile("x", "m", 0.5, 250, 50))


MAD_SQL = f"""{RET}, a AS (SELECT *, CASE WHEN count(r) {rows(249, 0)} >= 50 THEN quantile_cont(r, 0.5) {rows(249, 0)} END AS med FROM r),
 b AS (SELECT *, abs(r - med) AS dev FROM a),
 c AS (SELECT *, CASE WHEN count(dev) {rows(249, 0)} >= 50 THEN quantile_cont(dev, 0.5) {rows(249, 0)} END AS mad FROM b),
 d AS (SELECT *, nullif(lag(1.4826 * mad) {OVER}, 0) AS sigma FROM c)"""


@query("win_mad_scale", f"{MAD_SQL} {KD}, r6(sigma) AS sigma_hat FROM d")
def win_mad_scale(t):
    return ordered(returns(t).select("key", "date", "r"), SL.mad_scale("r", "sigma_hat", 250, 50))


@query("win_roll_quantile", f"{RET} {KD}, r6(CASE WHEN count(r) {rows(500, 1)} >= 250 THEN quantile_cont(r, 0.95) {rows(500, 1)} END) AS q FROM r")
def win_roll_quantile(t):
    return ordered(returns(t).select("key", "date", "r"), SL.quantile("r", "q", 0.95, 500, 250, 1))


@query("win_trailing_pctl", f"""WITH {PANEL_A}, c AS (SELECT key, date, x, list(x) {rows(749, 0)} AS h FROM pa)
 {KD}, r6(CASE WHEN len(h) >= 250 THEN (len(list_filter(h, lambda v: v < x)) + (len(list_filter(h, lambda v: v = x)) + 1) / 2.0) / len(h) END) AS p FROM c""")
def win_trailing_pctl(t):
    return ordered(t.panel_a().select("key", "date", "x"), SL.rank("x", "p", 750, 250))


@query("win_diff", sql(d1=f"x - lag(x) {OVER}", d2=f"x - 2 * lag(x) {OVER} + lag(x, 2) {OVER}"))
def win_diff(t):
    return pa(t, d1=F.col("x") - F.lag("x").over(w()), d2=F.col("x") - 2 * F.lag("x").over(w()) + F.lag("x", 2).over(w()))


@query("win_pct_change", sql(p5=f"x / lag(x, 5) {OVER} - 1", p20=f"x / lag(x, 20) {OVER} - 1", lr=f"ln(x / lag(x) {OVER})"))
def win_pct_change(t):
    r = lambda k: ratio(F.col("x"), F.lag("x", k).over(w()))
    return pa(t, p5=r(5) - 1, p20=r(20) - 1, lr=F.log(r(1)))


@query("win_volume_shock", sql(shock=f"coalesce(CASE WHEN count(qty) {rows(19, 0)} >= 5 THEN qty / nullif(avg(qty) {rows(19, 0)}, 0) END, 1)"))
def win_volume_shock(t):
    return pa(t, shock=W.volume_shock("qty"))


@query("win_surprise", sql(surprise=f"n - avg(n) {rows(19, 0)}", rel=f"(n - avg(n) {rows(19, 0)}) / (avg(n) {rows(19, 0)} + 1)"))
def win_surprise(t):
    m = W.mean("n", 20)
    return pa(t, surprise=F.col("n") - m, rel=(F.col("n") - m) / (m + 1))


@query("win_roll_sum", sql(s3=f"sum(n) {rows(2, 0)}", s5=f"sum(n) {rows(4, 0)}", s7=f"sum(n) {rows(6, 0)}"))
def win_roll_sum(t):
    return pa(t, **{f"s{k}": F.sum("n").over(W.trailing(k)) for k in (3, 5, 7)})


@query("win_meanrev", f"""WITH {PANEL_A}, a AS (SELECT key, date, lag(x) {OVER} AS l1, avg(x) {rows(5, 1)} AS m5, avg(x) {rows(22, 1)} AS m22 FROM pa)
 {KD}, r6(m5 - m22) AS momentum, r6((m5 - m22) - lag(m5 - m22) {OVER}) AS acceleration, r6(l1 / m22 - 1) AS deviation FROM a""")
def win_meanrev(t):
    d = t.panel_a().select("key", "date", F.lag("x").over(w()).alias("l1"), W.mean("x", 5, 1, 1).alias("m5"), W.mean("x", 22, 1, 1).alias("m22"))
    gap = F.col("m5") - F.col("m22")
    return d.select("key", "date", rnd(gap).alias("momentum"), rnd(gap - F.lag(gap).over(w())).alias("acceleration"),
                    rnd(ratio("l1", "m22") - 1).alias("deviation"))


@query("win_fwd_change", f"""WITH {PANEL_A}, a AS (SELECT *, lead(x) {OVER} - x AS d1, lead(x, 3) {OVER} - x AS d3 FROM pa)
 SELECT n >= 5 AS flag, r6(avg(d1)) AS d1, r6(avg(d3)) AS d3, CAST(count(*) AS BIGINT) AS rows_n FROM a GROUP BY 1""")
def win_fwd_change(t):
    d = t.panel_a().withColumn("d1", F.lead("x").over(w()) - F.col("x")).withColumn("d3", F.lead("x", 3).over(w()) - F.col("x"))
    return d.groupBy((F.col("n") >= 5).alias("flag")).agg(rnd(F.avg("d1")).alias("d1"), rnd(F.avg("d3")).alias("d3"), F.count(F.lit(1)).alias("rows_n"))


@query("win_momentum", f"""WITH {PANEL_A}, a AS (SELECT *, avg(x) {rows(4, 0)} - avg(x) {rows(19, 0)} AS m, CAST(n >= 5 AS INTEGER) AS f FROM pa)
 {KD}, r6(m) AS momentum, coalesce(abs(f - lag(f) {OVER}), 0) AS changed FROM a""")
def win_momentum(t):
    f = (F.col("n") >= 5).cast("int")
    return t.panel_a().withColumn("f", f).select("key", "date", rnd(W.mean("x", 5) - W.mean("x", 20)).alias("momentum"),
                                                 F.coalesce(F.abs(F.col("f") - F.lag("f").over(w())), F.lit(0)).alias("changed"))


@query("win_zscore", sql(z="least(greatest((x - avg(x) OVER (PARTITION BY key)) / greatest(stddev_samp(x) OVER (PARTITION BY key), 0.001), -5), 5)"))
def win_zscore(t):
    return pa(t, z=W.zscore("x"))


@query("win_decay_kernel", sql(k=f"0.5 * coalesce(lag(x,1) {OVER}, 0) + 0.25 * coalesce(lag(x,2) {OVER}, 0) + 0.15 * coalesce(lag(x,3) {OVER}, 0) + 0.1 * coalesce(lag(x,4) {OVER}, 0)"))
def win_decay_kernel(t):
    return pa(t, k=W.decay_kernel("x"))


@query("win_ema", f"""WITH RECURSIVE {PANEL_A}, o AS (SELECT key, date, x, row_number() {OVER} AS rn FROM pa),
 f AS (SELECT key, date, rn, CAST(x AS DOUBLE) AS num, CAST(1 AS DOUBLE) AS den FROM o WHERE rn = 1
 UNION ALL SELECT o.key, o.date, o.rn, f.num * CAST(0.5 AS DOUBLE) + o.x, f.den * CAST(0.5 AS DOUBLE) + 1 FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 {KD}, r6(num / den) AS ema FROM f""")
def win_ema(t):
    return W.ema(t.panel_a(), "x", 3).select("key", "date", rnd("ema").alias("ema"))


HOT = f"WITH {PANEL_A}, h AS (SELECT *, n >= 5 AS flag FROM pa)"


def hot(t):
    return t.panel_a().withColumn("flag", F.col("n") >= 5)


@query("win_run_length", f"""{HOT}, i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) {OVER} AS isl FROM h)
 {KD}, CASE WHEN flag THEN CAST(sum(CAST(flag AS INTEGER)) OVER (PARTITION BY key, isl ORDER BY date) AS INTEGER) ELSE 0 END AS run FROM i""")
def win_run_length(t):
    return W.run_length(hot(t), "flag").select("key", "date", "run")


@query("win_entries", f"""{HOT}, e AS (SELECT key, flag AND NOT coalesce(lag(flag) {OVER}, false) AS entry FROM h)
 SELECT key, CAST(count_if(entry) AS BIGINT) AS entries FROM e GROUP BY 1""")
def win_entries(t):
    e = F.col("flag") & ~F.coalesce(F.lag("flag").over(w()), F.lit(False))
    return hot(t).select("key", e.alias("entry")).groupBy("key").agg(F.count_if("entry").alias("entries"))


EPISODE_SQL = f"""WITH {PANEL_A}, m AS (SELECT date, sum(n) >= 40 AS flag, row_number() OVER (ORDER BY date) AS pos FROM pa GROUP BY 1),
 s AS (SELECT *, lag(pos) OVER (ORDER BY date) AS prev FROM m WHERE flag),
 ep AS (SELECT date, CAST(sum(CASE WHEN prev IS NULL OR pos - prev > 5 THEN 1 ELSE 0 END) OVER (ORDER BY date) - 1 AS BIGINT) AS episode FROM s)"""


def market_flag(t, least=40):
    return t.panel_a().groupBy("date").agg((F.sum("n") >= least).alias("flag"), F.avg("x").alias("level"))


@query("win_episodes", f"{EPISODE_SQL} SELECT date, episode FROM ep")
def win_episodes(t):
    return W.episodes(market_flag(t), "flag", 5).filter("flag").select("date", "episode")


@query("win_rank_xs", f"""WITH {PANEL_B}, a AS (SELECT key, date, x, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rk,
 count(*) OVER (PARTITION BY date) AS c FROM pb)
 SELECT key, date, r6(rk / c) AS pct, CAST(least(floor(rk / c * 5 - 1e-9), 4) AS INTEGER) AS quintile FROM a""")
def win_rank_xs(t):
    d = with_rank(t.table_b(), ["date"], "x")
    pct = F.col("rank") / F.col("rank_n")
    return d.select("key", "date", rnd(pct).alias("pct"), F.least(F.floor(pct * 5 - 1e-9), F.lit(4)).cast("int").alias("quintile"))


CLASSES_SQL = """cls AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, c_nationkey AS company, c_custkey AS id, round(sum(o_totalprice), 2) AS cap
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""


def classes(t):
    spend = t.orders.groupBy(F.year("o_orderdate").alias("year"), "o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("cap"))
    who = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("company"))
    return spend.join(who, F.col("o_custkey") == F.col("id")).select("year", "company", "id", "cap")


@query("win_rank_topn", f"""WITH {CLASSES_SQL} SELECT year, id, cap, CAST(row_number() OVER (PARTITION BY year ORDER BY cap DESC, id) AS INTEGER) AS rank
 FROM cls QUALIFY rank <= 10""")
def win_rank_topn(t):
    one = P.universe(classes(t).select("year", F.col("id").alias("company"), "id", "cap"), 10)
    return one.select("year", "id", "cap", "rank")


@query("win_autocorr", f"""WITH {PANEL_A}, c AS (SELECT key, date, x - avg(x) OVER (PARTITION BY key) AS c FROM pa),
 p AS (SELECT key, c * c AS p0, """ + ", ".join(f"c * lag(c, {k}) {OVER} AS p{k}" for k in range(1, 6)) + """ FROM c),
 s AS (SELECT key, count(*) AS n, """ + ", ".join(f"sum(p{k}) AS s{k}" for k in range(6)) + """ FROM p GROUP BY 1)
 """ + " UNION ALL ".join(f"SELECT key, {k} AS lag, r6(s{k} / s0) AS acf, r6(1.96 / sqrt(n)) AS band FROM s" for k in range(6)))
def win_autocorr(t):
    return W.autocorrelation(t.panel_a(), "x", 5).select("key", "lag", rnd("acf").alias("acf"), rnd("band").alias("band"))


@query("win_seq", f"""WITH {PANEL_A}, h AS (SELECT key, date, list(round(x, 4)) {rows(9, 0)} AS h FROM pa)
 {KD}, r4(h[1]) AS oldest, r4(h[10]) AS newest, r4(list_sum(h)) AS total FROM h WHERE len(h) = 10""")
def win_seq(t):
    d = t.panel_a().withColumn("x", F.round("x", 4)).withColumn("h", W.history("x", 10)).filter(F.col("h").isNotNull())
    return d.select("key", "date", rnd(F.col("h")[0], 4).alias("oldest"), rnd(F.col("h")[9], 4).alias("newest"),
                    rnd(F.aggregate("h", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("win_fwd_h", sql(**{f"h{k}": f"lead(x, {k}) {OVER}" for k in (1, 2, 3, 5, 10)}))
def win_fwd_h(t):
    return pa(t, **{f"h{k}": F.lead("x", k).over(w()) for k in (1, 2, 3, 5, 10)})


@query("srt_panel", f"WITH {PANEL_A} SELECT key, date, r6(x) AS x FROM pa ORDER BY key, date")
def srt_panel(t):
    return t.panel_a().orderBy("key", "date").select("key", "date", rnd("x").alias("x"))


@query("srt_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def srt_topk(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


KNN_SQL = f"""WITH {PANEL_B}, m AS (SELECT date, avg(x) AS a, sum(n) AS b FROM pb GROUP BY 1),
 z AS (SELECT date, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b, row_number() OVER (ORDER BY date) - 1 AS pos FROM m),
 nn AS (SELECT t.date AS date, s.date AS past, row_number() OVER (PARTITION BY t.date ORDER BY round(sqrt((t.a - s.a) * (t.a - s.a) + (t.b - s.b) * (t.b - s.b)), 9), s.date) AS rk
 FROM z t JOIN z s ON s.pos < t.pos WHERE t.pos > 20)"""


@query("srt_knn", f"{KNN_SQL} SELECT date, past, CAST(rk AS INTEGER) AS rk FROM nn WHERE rk <= 250")
def srt_knn(t):
    from ..operators.pooled import nearest_past
    m = t.panel_b().groupBy("date").agg(F.avg("x").alias("a"), F.sum("n").cast("double").alias("b"))
    return nearest_past(m, ["a", "b"], 250, 20).select("date", "past", "rk")


@query("srt_argbest", f"""WITH {PANEL_A}, s AS (SELECT key, avg(x) AS m, stddev_samp(x) AS sd FROM pa GROUP BY 1)
 SELECT arg_max(key, m) AS best, arg_max(key, sd) AS noisiest, arg_min(key, m) AS worst FROM s""")
def srt_argbest(t):
    s = t.panel_a().groupBy("key").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("sd"))
    return s.agg(F.max_by("key", "m").alias("best"), F.max_by("key", "sd").alias("noisiest"), F.min_by("key", "m").alias("worst"))


@query("srt_importance", f"""WITH {PANEL_A}, l AS (SELECT lead(x) {OVER} AS y, x, qty, CAST(n AS DOUBLE) AS n FROM pa),
 c AS (SELECT 'x' AS feature, abs(corr(x, y)) AS score FROM l UNION ALL SELECT 'qty', abs(corr(qty, y)) FROM l UNION ALL SELECT 'n', abs(corr(n, y)) FROM l)
 SELECT feature, r6(score) AS score, r6(score / sum(score) OVER () * 100) AS pct FROM c""")
def srt_importance(t):
    from ..operators.evaluate import correlation_scan, importance_table
    d = t.panel_a().withColumn("y", F.lead("x").over(w())).withColumn("n", F.col("n").cast("double"))
    s = correlation_scan(d, ["x", "qty", "n"], "y").select("feature", F.abs("corr").alias("score"))
    return importance_table(s).select("feature", rnd("score").alias("score"), rnd("pct").alias("pct"))

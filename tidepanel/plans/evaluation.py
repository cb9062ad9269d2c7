"""Evaluation of intervals, forecasts and features."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import corr, draw_unit, interval_score, ratio, rnd
from ..operators import evaluate as EV
from ..operators import forecast as FC
from ..operators import frames as fr
from ..operators import gram as G
from ..operators import inference as IN
from ..operators import replicates as RP
from ..operators import steps as S
from ..operators import windows as W
from ..operators.joins import window_label
from ..operators.ranks import quantiles, with_rank
from ..session import written
from .calibration import ACI, SCORE_SQL, WARM, preds, recursion
from .forecasts import ALL5, BASE, F4, H3, RDG_SRC, SPLIT, design_a, r2_sql, split_day, test, train
from .joins import WINDOWS, WINDOWS_SQL
from .linear_sql import gram_cte, predict_sql, solve_cte
from .panels import STATE_SQL, state_b
from .pooled import var_heads
from .registry import PANEL_A, query
from .windows import OVER, rows

# --- three methods of intervals on one frame ----------------------------------------
ROLL_SQL = f"""{SCORE_SQL}, {STATE_SQL}, sr AS (SELECT *, quantile_cont(s, 0.95) {rows(60, 1)} AS rh, quantile_cont(-s, 0.95) {rows(60, 1)} AS rl, stddev_samp(s) {rows(60, 1)} AS sd, count(s) {rows(60, 1)} AS rc FROM sc)"""
BOUNDS = """, bd AS (SELECT 'aci' AS method, key, date, target, m - q_lo AS lo, m + q_hi AS hi, warmup FROM iv
 UNION ALL SELECT 'roll', key, date, target, m - rl, m + rh, rc < 40 FROM iv WHERE rh IS NOT NULL
 UNION ALL SELECT 'norm', key, date, target, m - 1.6 * sd, m + 1.6 * sd, rc < 30 FROM iv WHERE sd IS NOT NULL),
 cs AS (SELECT key, date FROM bd WHERE NOT warmup GROUP BY 1, 2 HAVING count(*) = 3),
 bx AS (SELECT bd.*, level_pctl, coalesce(level_pctl >= 0.8, false) AS stress, CASE WHEN level_pctl >= 0 AND level_pctl <= 0.5 THEN 'calm' WHEN level_pctl > 0.5 AND level_pctl <= 0.8 THEN 'normal' WHEN level_pctl > 0.8 AND level_pctl <= 0.95 THEN 'elevated' WHEN level_pctl > 0.95 AND level_pctl <= 1 THEN 'stress' END AS bin,
  CAST(target >= lo AND target <= hi AS DOUBLE) AS cov, CAST(target <= hi AS DOUBLE) AS cov_hi, CAST(target >= lo AS DOUBLE) AS cov_lo, hi - lo AS width, hi - lo + 20 * greatest(lo - target, 0) + 20 * greatest(target - hi, 0) AS isc
  FROM bd SEMI JOIN cs ON bd.key = cs.key AND bd.date = cs.date LEFT JOIN st ON bd.date = st.date),
 dl AS (SELECT method, date, avg(cov) AS cov, avg(cov_hi) AS cov_hi, avg(isc) AS isc, avg(width) AS width, count(*) AS n, bool_or(stress) AS stress FROM bx GROUP BY 1, 2)"""


def bq(select, more=""):
    return recursion(ACI, "q", src="sr", with_=ROLL_SQL, more=BOUNDS + more) + select


def bounds(t):
    """Long frame (method, key, date, target, lo, hi) on the common sample, with
    the market state and the coverage indicators."""
    d = preds(t).withColumn("_neg", -F.col("s"))
    w = W.trailing(60, 1)
    d = (d.withColumn("rh", F.percentile("s", F.lit(0.95)).over(w)).withColumn("rl", F.percentile("_neg", F.lit(0.95)).over(w))
         .withColumn("sd", F.stddev_samp("s").over(w)).withColumn("rc", F.count("s").over(w)).drop("_neg"))
    iv = S.fold(d, {"aci": S.aci(0.05)}, 0.1, WARM)
    m = F.col("m")
    arms = F.array(F.struct(F.lit("aci").alias("method"), (m - F.col("q_lo")).alias("lo"), (m + F.col("q_hi")).alias("hi"), F.col("warmup").alias("w")),
                   F.struct(F.lit("roll").alias("method"), (m - F.col("rl")).alias("lo"), (m + F.col("rh")).alias("hi"), (F.col("rc") < 40).alias("w")),
                   F.struct(F.lit("norm").alias("method"), (m - 1.6 * F.col("sd")).alias("lo"), (m + 1.6 * F.col("sd")).alias("hi"), (F.col("rc") < 30).alias("w")))
    # the methods of a row stay together, so the common sample is a row filter
    usable = F.forall(arms, lambda a: a["lo"].isNotNull() & ~a["w"])
    long = iv.filter(usable).select("key", "date", "target", F.explode(arms).alias("a")).select("key", "date", "target", "a.*").drop("w")
    st = state_b(t).select("date", "level_pctl", F.coalesce(F.col("level_pctl") >= 0.8, F.lit(False)).alias("stress"))
    x = fr.attach(long, st, ["date"])
    y, lo, hi = F.col("target"), F.col("lo"), F.col("hi")
    return (x.withColumn("covered", (y >= lo) & (y <= hi)).withColumn("covered_hi", y <= hi).withColumn("covered_lo", y >= lo)
            .withColumn("width", hi - lo).withColumn("isc", interval_score(y, lo, hi, 0.1)))


def daily(t):
    b = EV.b2d
    return bounds(t).groupBy("method", "date").agg(F.avg(b("covered")).alias("cov"), F.avg(b("covered_hi")).alias("cov_hi"), F.avg("isc").alias("isc"),
                                                   F.avg("width").alias("width"), F.count(F.lit(1)).alias("n"), F.bool_or("stress").alias("stress"))


def six(d, *cols, keep=()):
    return d.select(*keep, *[rnd(c).alias(c) for c in cols])


@query("ev_marginal", bq("SELECT method, r6(avg(cov)) AS coverage, CAST(count(*) AS BIGINT) AS n FROM bx GROUP BY 1"))
def ev_marginal(t):
    return bounds(t).groupBy("method").agg(rnd(F.avg(EV.b2d("covered"))).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("ev_by_state", bq("SELECT bin AS state_bin, r6(avg(cov)) AS coverage, r6(avg(cov_hi)) AS upper_coverage, r6(avg(cov_lo)) AS lower_coverage, CAST(count(*) AS BIGINT) AS n, r6(avg(width)) AS mean_width FROM bx WHERE method = 'aci' AND bin IS NOT NULL GROUP BY 1"))
def ev_by_state(t):
    c = EV.coverage_by_state(bounds(t).filter("method = 'aci'"), "level_pctl")
    return six(c, "coverage", "upper_coverage", "lower_coverage", "mean_width", keep=("state_bin", "n"))


@query("ev_point_table", f"""{BASE}, d AS (SELECT * FROM h WHERE y IS NOT NULL AND rv_m IS NOT NULL), u AS (SELECT 'rv_d' AS model, y, rv_d AS p FROM d UNION ALL SELECT 'rv_w', y, rv_w FROM d UNION ALL SELECT 'rv_m', y, rv_m FROM d)
 SELECT model, r6(avg(exp(y - p) - (y - p) - 1)) AS qlike, r6(sqrt(avg((y - p) * (y - p)))) AS rmse, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY 1""")
def ev_point_table(t):
    return six(EV.point_table(FC.design(t.table_a()), H3, "y"), "qlike", "rmse", keep=("model", "n"))


@query("ev_var_table")
def ev_var_table(t):
    """Breach rates overall and by state, and the share of keys passing each test."""
    st = state_b(t).select("date", F.coalesce(F.col("level_pctl") >= 0.8, F.lit(False)).alias("stress"))
    d = fr.attach(var_heads(t), st, ["date"]).withColumn("e", F.col("s") > F.col("q"))
    e = EV.b2d("e")
    rates = d.groupBy("method").agg(F.avg(e).alias("rate"), F.avg(F.when(~F.col("stress"), e)).alias("calm"), F.avg(F.when(F.col("stress"), e)).alias("stress"))
    passes = IN.backtests(d, ["method", "key"], 0.1).groupBy("method").agg(
        *[F.avg((F.col(c) > 0.05).cast("double")).alias(c.replace("_p", "_pass")) for c in ("kupiec_p", "independence_p", "cc_p", "dq_p")])
    return six(rates.join(passes, "method"), "rate", "calm", "stress", "kupiec_pass", "independence_pass", "cc_pass", "dq_pass", keep=("method",))


@query("ev_main_table", bq("""SELECT method, r6(avg(cov)) AS marginal, r6(avg(CASE WHEN bin = 'calm' THEN cov END)) AS calm, r6(avg(CASE WHEN bin = 'normal' THEN cov END)) AS normal,
 r6(avg(CASE WHEN bin = 'elevated' THEN cov END)) AS elevated, r6(avg(CASE WHEN bin = 'stress' THEN cov END)) AS stress, r6(avg(CASE WHEN bin = 'stress' THEN cov_hi END)) AS stress_upper, r6(avg(width)) AS width, r6(avg(isc)) AS score FROM bx GROUP BY 1"""))
def ev_main_table(t):
    d = bounds(t).withColumn("bin", EV.cut("level_pctl", EV.STATE_EDGES, EV.STATE_LABELS))
    at = lambda b, c="covered": F.avg(F.when(F.col("bin") == b, EV.b2d(c)))
    return six(d.groupBy("method").agg(F.avg(EV.b2d("covered")).alias("marginal"), *[at(b).alias(b) for b in EV.STATE_LABELS],
                                       at("stress", "covered_hi").alias("stress_upper"), F.avg("width").alias("width"), F.avg("isc").alias("score")),
               "marginal", *EV.STATE_LABELS, "stress_upper", "width", "score", keep=("method",))


@query("ev_per_entity", bq("""SELECT method, r6(quantile_cont(c, 0.05)) AS q05, r6(quantile_cont(c, 0.5)) AS q50, r6(quantile_cont(c, 0.75)) AS q75, r6(avg(CASE WHEN c < 0.85 THEN 1.0 ELSE 0 END)) AS share_low
 FROM (SELECT method, key, avg(cov) AS c FROM bx GROUP BY 1, 2 HAVING count(*) >= 25) GROUP BY 1"""))
def ev_per_entity(t):
    e = bounds(t).groupBy("method", "key").agg(F.avg(EV.b2d("covered")).alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 25")
    q = quantiles(e, ["method"], "c", [.05, .5, .75], ["q05", "q50", "q75"])
    low = e.groupBy("method").agg(F.avg((F.col("c") < 0.85).cast("double")).alias("share_low"))
    return six(q.join(low, "method"), "q05", "q50", "q75", "share_low", keep=("method",))


RUN_SQL = """, rf AS (SELECT date, coalesce(level_pctl >= 0.8, false) AS f FROM st), ri AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (ORDER BY date) AS isl FROM rf),
 rl AS (SELECT date, CASE WHEN f THEN sum(CAST(f AS INTEGER)) OVER (PARTITION BY isl ORDER BY date) ELSE 0 END AS run FROM ri)"""


def stress_runs(t):
    d = state_b(t).withColumn("f", F.coalesce(F.col("level_pctl") >= 0.8, F.lit(False))).withColumn("_one", F.lit(0))
    return W.run_length(d, "f", "run", ["_one"]).select("date", "run")


@query("ev_dse_profile", bq("""SELECT method, CASE WHEN run = 1 THEN '1' WHEN run = 2 THEN '2' WHEN run = 3 THEN '3' WHEN run <= 5 THEN '4-5' WHEN run <= 10 THEN '6-10' ELSE '>10' END AS bucket, r6(avg(cov)) AS coverage, CAST(count(*) AS BIGINT) AS n
 FROM bx JOIN rl ON bx.date = rl.date WHERE run > 0 GROUP BY 1, 2""", RUN_SQL))
def ev_dse_profile(t):
    d = fr.attach(bounds(t), stress_runs(t).filter("run > 0"), ["date"], "inner").withColumn("bucket", EV.dse_bucket("run"))
    return d.groupBy("method", "bucket").agg(rnd(F.avg(EV.b2d("covered"))).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("ev_trajectory", bq("SELECT CAST(run AS INTEGER) AS run, r6(avg(hi - lo)) AS width, r6(avg(target)) AS target, r6(avg(1 - cov)) AS miss, r6(avg(cov)) AS coverage FROM bx JOIN rl ON bx.date = rl.date WHERE run BETWEEN 1 AND 5 AND method = 'aci' GROUP BY 1", RUN_SQL))
def ev_trajectory(t):
    d = fr.attach(bounds(t).filter("method = 'aci'"), stress_runs(t).filter("run between 1 and 5"), ["date"], "inner")
    c = EV.b2d("covered")
    return six(d.groupBy("run").agg(F.avg("width").alias("width"), F.avg("target").alias("target"), F.avg(1 - c).alias("miss"), F.avg(c).alias("coverage")),
               "width", "target", "miss", "coverage", keep=("run",))


@query("ev_episode_table", bq("SELECT label, method, r6(avg(cov)) AS coverage, CAST(count(*) AS BIGINT) AS n FROM bx JOIN win ON date BETWEEN a AND b GROUP BY 1, 2", ", " + WINDOWS_SQL))
def ev_episode_table(t):
    d = bounds(t).withColumn("label", F.explode(window_label("date", WINDOWS)))
    return d.groupBy("label", "method").agg(rnd(F.avg(EV.b2d("covered"))).alias("coverage"), F.count(F.lit(1)).alias("n"))


@query("ev_subperiod", bq("""SELECT method, dropped, r6((sum(s) - max(CASE WHEN yr = dropped THEN s ELSE 0 END)) / (sum(c) - max(CASE WHEN yr = dropped THEN c ELSE 0 END))) AS coverage
 FROM yr, (SELECT DISTINCT yr AS dropped FROM yr) d GROUP BY 1, 2""", ", yr AS (SELECT method, CAST(year(date) AS INTEGER) AS yr, sum(cov) AS s, count(*) AS c FROM bx GROUP BY 1, 2)"))
def ev_subperiod(t):
    """Leave-one-year-out coverage from yearly sums: total minus the year."""
    y = bounds(t).groupBy("method", F.year("date").alias("dropped")).agg(F.sum(EV.b2d("covered")).alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("method")
    return y.select("method", "dropped", rnd(ratio(F.sum("s").over(w) - F.col("s"), F.sum("c").over(w) - F.col("c"))).alias("coverage"))


EP_SQL = """, ec AS (SELECT date, coalesce(level_pctl >= 0.8, false) AS f, row_number() OVER (ORDER BY date) AS pos FROM st), e1 AS (SELECT *, lag(pos) OVER (ORDER BY date) AS prev FROM ec WHERE f),
 ep AS (SELECT date, CAST(sum(CASE WHEN prev IS NULL OR pos - prev > 5 THEN 1 ELSE 0 END) OVER (ORDER BY date) - 1 AS BIGINT) AS episode FROM e1)"""


def stress_episodes(t):
    d = state_b(t).select("date", F.coalesce(F.col("level_pctl") >= 0.8, F.lit(False)).alias("f"))
    return W.episodes(d, "f", 5).filter("f").select("date", "episode")


@query("ev_loo_episode", bq("SELECT method, episode, r6((sum(s) OVER w - s) / (sum(c) OVER w - c)) AS coverage FROM es WINDOW w AS (PARTITION BY method)", EP_SQL + ", es AS (SELECT method, episode, sum(cov) AS s, count(*) AS c FROM bx JOIN ep ON bx.date = ep.date GROUP BY 1, 2)"))
def ev_loo_episode(t):
    e = fr.attach(bounds(t), stress_episodes(t), ["date"], "inner").groupBy("method", "episode").agg(F.sum(EV.b2d("covered")).alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("method")
    return e.select("method", "episode", rnd(ratio(F.sum("s").over(w) - F.col("s"), F.sum("c").over(w) - F.col("c"))).alias("coverage"))


@query("ev_directional", bq("SELECT method, bin, r6(avg(1 - cov_hi)) AS up_miss, r6(avg(1 - cov_lo)) AS down_miss FROM bx WHERE bin IS NOT NULL GROUP BY 1, 2"))
def ev_directional(t):
    d = bounds(t).withColumn("bin", EV.cut("level_pctl", EV.STATE_EDGES, EV.STATE_LABELS)).filter(F.col("bin").isNotNull())
    return six(d.groupBy("method", "bin").agg(F.avg(1 - EV.b2d("covered_hi")).alias("up_miss"), F.avg(1 - EV.b2d("covered_lo")).alias("down_miss")), "up_miss", "down_miss", keep=("method", "bin"))


@query("ev_dispersion", bq("SELECT method, r6(sqrt(sum(n * (c - 0.9) * (c - 0.9)) / sum(n))) AS rms, r6(max(abs(c - 0.9))) AS worst FROM (SELECT method, bin, avg(cov) AS c, count(*) AS n FROM bx WHERE bin IS NOT NULL GROUP BY 1, 2) GROUP BY 1"))
def ev_dispersion(t):
    d = bounds(t).withColumn("bin", EV.cut("level_pctl", EV.STATE_EDGES, EV.STATE_LABELS)).filter(F.col("bin").isNotNull())
    g = d.groupBy("method", "bin").agg(F.avg(EV.b2d("covered")).alias("c"), F.count(F.lit(1)).alias("n"))
    dev = F.col("c") - 0.9
    return six(g.groupBy("method").agg(F.sqrt(F.sum(F.col("n") * dev * dev) / F.sum("n")).alias("rms"), F.max(F.abs(dev)).alias("worst")), "rms", "worst", keep=("method",))


# --- forecasts ---------------------------------------------------------------------------
FIT = f"{BASE}, {RDG_SRC}, " + gram_cte("g", "hh", [], F4, "y", f"date < DATE '{SPLIT}'", lam="1.0") + ", " + solve_cte("b", "g", [], 4) + f", pr AS (SELECT hh.*, {predict_sql(F4)} AS p FROM hh, b WHERE date >= DATE '{SPLIT}')"
PRD = f"{FIT}, pt AS (SELECT * FROM pr WHERE y IS NOT NULL AND p IS NOT NULL)"


def predicted(t):
    d = design_a(t)
    return G.fit_predict(train(d), test(d), [], F4, "y", 1.0, out="p").filter(F.col("y").isNotNull() & F.col("p").isNotNull())


@query("ev_regression", f"{PRD}, sg AS (SELECT *, sign(y - lag(y) {OVER}) AS sy, sign(p - lag(p) {OVER}) AS sp FROM pt) SELECT key, r4(sqrt(avg((y - p) ** 2))) AS rmse, r4(avg(abs(y - p))) AS mae, r4({r2_sql('p')}) AS r2, r4(avg(CASE WHEN sy IS NULL THEN NULL WHEN sy = sp THEN 1.0 ELSE 0 END) * 100) AS direction, CAST(count(*) AS BIGINT) AS n FROM sg GROUP BY 1")
def ev_regression(t):
    d = EV.regression_metrics(predicted(t), ["key"])
    return d.select("key", *[rnd(c, 4).alias(c) for c in ("rmse", "mae", "r2", "direction")], "n")


@query("ev_r2_groups", f"""{PRD}, g1 AS (SELECT 'key' AS kind, key AS grp, {r2_sql('p')} AS r2, count(*) AS n FROM pt GROUP BY 2 UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), {r2_sql('p')}, count(*) FROM pt GROUP BY 2
 UNION ALL SELECT 'regime', CASE WHEN n > 5 THEN 'high' ELSE 'low' END, {r2_sql('p')}, count(*) FROM pt GROUP BY 2)
 SELECT kind, r4(avg(r2)) AS mean, r4(coalesce(stddev_samp(r2), 0)) AS sd, r4(min(r2)) AS lo, r4(max(r2)) AS hi, CAST(count_if(r2 > 0) AS BIGINT) AS wins FROM g1 WHERE n > 50 GROUP BY 1""")
def ev_r2_groups(t):
    """One pass: every row counts once per grouping."""
    kinds = F.array(F.struct(F.lit("key").alias("kind"), F.col("key").alias("grp")), F.struct(F.lit("year").alias("kind"), F.year("date").cast("string").alias("grp")),
                    F.struct(F.lit("regime").alias("kind"), F.when(F.col("n") > 5, "high").otherwise("low").alias("grp")))
    g = predicted(t).select("y", "p", F.explode(kinds).alias("k")).groupBy("k.kind", "k.grp").agg(EV.r2("y", "p").alias("r2"), F.count(F.lit(1)).alias("n")).filter("n > 50")
    return g.groupBy("kind").agg(rnd(F.avg("r2"), 4).alias("mean"), rnd(F.coalesce(F.stddev_samp("r2"), F.lit(0.0)), 4).alias("sd"), rnd(F.min("r2"), 4).alias("lo"),
                                 rnd(F.max("r2"), 4).alias("hi"), F.count_if(F.col("r2") > 0).alias("wins"))


@query("ev_classif", """WITH d AS (SELECT l.doc_id AS doc_id, quality AS y, n_chars AS s FROM labels l JOIN documents USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM d),
 m AS (SELECT median(s) AS m FROM d), c AS (SELECT count_if(y = 1 AND s > m) AS tp, count_if(y = 0 AND s > m) AS fp, count_if(y = 1 AND s <= m) AS fn, count_if(y = 0 AND s <= m) AS tn FROM d, m),
 a AS (SELECT (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r),
 v AS (SELECT s, sum(y) AS pos, count(*) AS c FROM d GROUP BY 1), q AS (SELECT pos, sum(pos) OVER w AS tp, sum(c) OVER w AS k, sum(pos) OVER () AS np FROM v WINDOW w AS (ORDER BY s DESC)), ap AS (SELECT sum(pos / np * tp / k) AS pr_auc FROM q)
 SELECT r6(auc) AS auc, r6(pr_auc) AS pr_auc, r6(tp / (tp + fp)) AS precision, r6(tp / (tp + fn)) AS recall, r6(2.0 * tp / (2 * tp + fp + fn)) AS f1, r6((tp + tn) / (tp + fp + fn + tn)) AS accuracy FROM a, ap, c""")
def ev_classif(t):
    d = t.labels.join(t.documents.select("doc_id", F.col("n_chars").alias("s")), "doc_id").withColumn("g", F.lit(0))
    d = fr.with_scalars(d, quantiles(d, [], "s", [0.5], ["m"]), "_m").withColumn("hit", (F.col("s") > F.col("_m.m")).cast("int"))
    a = EV.auc(d, ["g"], "quality", "s").select("g", "auc")
    pr = EV.pr_auc(d, "quality", "s").select("pr_auc").scalar()
    return six(EV.confusion(d, ["g"], "quality", "hit").join(a, "g").withColumn("pr_auc", pr), "auc", "pr_auc", "precision", "recall", "f1", "accuracy")


@query("ev_tail", f"""{PRD}, q AS (SELECT quantile_cont(y, 0.9) AS qy, quantile_cont(p, 0.9) AS qp, stddev_samp(y) AS sd FROM pt), f AS (SELECT pt.*, y >= qy AS a, p >= qp AS b, sd FROM pt, q)
 SELECT CAST(count_if(a) AS BIGINT) AS n_tail, r4(avg(CASE WHEN a THEN CAST(b AS DOUBLE) END)) AS hit_rate, r4(avg(CASE WHEN a THEN CAST(y - p > sd AS DOUBLE) END)) AS severe_rate,
 r4(1 - sum(CASE WHEN a THEN (y - p) ** 2 END) / (var_pop(CASE WHEN a THEN y END) * count_if(a))) AS r2_tail, r4(1 - sum(CASE WHEN NOT a THEN (y - p) ** 2 END) / (var_pop(CASE WHEN NOT a THEN y END) * count_if(NOT a))) AS r2_rest,
 r4(sqrt(avg(CASE WHEN a THEN (y - p) ** 2 END))) AS rmse_tail FROM f""")
def ev_tail(t):
    d = EV.tail_metrics(predicted(t).select("key", "date", "y", "p"), "y", "p", 0.9)
    return d.select("n_tail", *[rnd(c, 4).alias(c) for c in ("hit_rate", "severe_rate", "r2_tail", "r2_rest", "rmse_tail")])


@query("ev_mz", f"""{PRD}, s AS (SELECT key, count(*) AS n, regr_intercept(y, p) AS a, regr_slope(y, p) AS b, regr_r2(y, p) AS r, sum((y - p) ** 2) AS s0, var_pop(y) * count(*) AS t FROM pt GROUP BY 1)
 SELECT key, r4(a) AS alpha, r4(b) AS beta, r4(r) AS r2, r4(((s0 - (1 - r) * t) / 2) / ((1 - r) * t / (n - 2))) AS f_stat, CAST(n AS BIGINT) AS n FROM s""")
def ev_mz(t):
    d = EV.mincer_zarnowitz(predicted(t), ["key"], "y", "p")
    return d.select("key", *[rnd(c, 4).alias(c) for c in ("alpha", "beta", "r2", "f_stat")], "n")


@query("ev_ic_decay", f"""{PRD}, hz AS (SELECT * FROM (""" + " UNION ALL ".join(f"SELECT {h} AS h, p, lead(x, {h}) {OVER} AS yh FROM pt" for h in (1, 3, 10)) + """) WHERE yh IS NOT NULL),
 rk AS (SELECT h, rank() OVER (PARTITION BY h ORDER BY p) + (count(*) OVER (PARTITION BY h, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY h ORDER BY yh) + (count(*) OVER (PARTITION BY h, yh) - 1) / 2.0 AS ry FROM hz)
 SELECT h, r4(corr(rp, ry)) AS ic, CAST(count(*) AS BIGINT) AS n FROM rk GROUP BY 1""")
def ev_ic_decay(t):
    d = predicted(t)
    d = d.withColumn("p", F.round("p", 12))
    cols = F.array(*[F.struct(F.lit(h).alias("h"), F.lead("x", h).over(fr.by_key()).alias("yh")) for h in (1, 3, 10)])
    e = d.withColumn("hs", cols).select("p", F.explode("hs").alias("s")).select("p", "s.*")
    return EV.spearman(e, ["h"], "p", "yh").select("h", rnd("spearman", 4).alias("ic"), "n")


@query("ev_corr_scan", f"{BASE}, {RDG_SRC}, c AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, corr({f}, y) AS c, count(*) FILTER (WHERE {f} IS NOT NULL AND y IS NOT NULL) AS n FROM hh" for f in ALL5) + ") SELECT feature, r6(c) AS corr, abs(c * sqrt((n - 2) / (1 - c * c))) > 1.96 AS significant FROM c")
def ev_corr_scan(t):
    d = EV.correlation_scan(design_a(t), ALL5, "y")
    return d.select("feature", rnd("corr").alias("corr"), "significant")


@query("ev_partial_corr", f"{BASE}, {RDG_SRC}, c AS (SELECT corr(qty, y) AS xy, corr(qty, rv_m) AS xz, corr(y, rv_m) AS yz FROM hh WHERE qty IS NOT NULL AND y IS NOT NULL AND rv_m IS NOT NULL), p AS (SELECT (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS p, yz FROM c) SELECT r6(p) AS partial_corr, r6(p * p * (1 - yz * yz)) AS r2_gain FROM p")
def ev_partial_corr(t):
    return six(EV.partial_corr(design_a(t), "qty", "y", "rv_m"), "partial_corr", "r2_gain")


@query("ev_orthogonal", f"{BASE}, {RDG_SRC}, " + gram_cte("g", "hh", [], ["rv_d", "n"], "qty", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b", "g", [], 2) +
       f", o AS (SELECT hh.*, qty - {predict_sql(['rv_d', 'n'])} AS resid FROM hh, b WHERE date < DATE '{SPLIT}' AND rv_d IS NOT NULL) SELECT r4(var_pop(resid) / var_pop(qty)) AS unique_share, r4(corr(resid, y)) AS resid_corr, r4(corr(qty, y)) AS raw_corr FROM o")
def ev_orthogonal(t):
    d = train(design_a(t))
    o = G.fit_predict(d, d, [], ["rv_d", "n"], "qty", out="shadow").withColumn("resid", F.col("qty") - F.col("shadow"))
    return o.agg(rnd(F.var_pop("resid") / F.var_pop("qty"), 4).alias("unique_share"), rnd(corr("resid", "y"), 4).alias("resid_corr"), rnd(corr("qty", "y"), 4).alias("raw_corr"))


@query("ev_drift", """WITH d AS (SELECT value AS v, ts < TIMESTAMP '2024-01-15' AS tr FROM events), c AS (SELECT v, count_if(tr) AS a, count_if(NOT tr) AS b FROM d GROUP BY 1),
 f AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM c WINDOW w AS (ORDER BY v)),
 m AS (SELECT (avg(CASE WHEN NOT tr THEN v END) - avg(CASE WHEN tr THEN v END)) / stddev_samp(CASE WHEN tr THEN v END) AS sh FROM d) SELECT r6(max(abs(fa - fb))) AS ks, r6(max(sh)) AS mean_shift FROM f, m""")
def ev_drift(t):
    return six(EV.ks_shift(t.events, "value", F.col("ts") < F.lit("2024-01-15").cast("timestamp")), "ks", "mean_shift")


@query("ev_persistence", f"WITH {PANEL_A}, l AS (SELECT key, n >= 5 AS busy, x, lag(x) {OVER} AS lx FROM pa), c AS (SELECT key, busy, corr(x, lx) AS c FROM l WHERE lx IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20) SELECT busy, r6(avg(c)) AS persistence, CAST(count(*) AS BIGINT) AS keys FROM c GROUP BY 1")
def ev_persistence(t):
    l = t.panel_a().select("key", (F.col("n") >= 5).alias("busy"), "x", F.lag("x").over(fr.by_key()).alias("lx")).filter(F.col("lx").isNotNull())
    c = l.groupBy("key", "busy").agg(corr("x", "lx").alias("c"), F.count(F.lit(1)).alias("n")).filter("n >= 20")
    return c.groupBy("busy").agg(rnd(F.avg("c")).alias("persistence"), F.count(F.lit(1)).alias("keys"))


@query("ev_error_link", f"{PRD}, e AS (SELECT abs(y - p) AS e, qty, CASE WHEN n > 5 THEN 'high' WHEN n < 3 THEN 'low' ELSE 'normal' END AS regime FROM pt) SELECT regime, r4(corr(e, qty)) AS link, r4(avg(e)) AS mae, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1 HAVING count(*) > 50")
def ev_error_link(t):
    d = predicted(t).select(F.abs(F.col("y") - F.col("p")).alias("e"), "qty", F.when(F.col("n") > 5, "high").when(F.col("n") < 3, "low").otherwise("normal").alias("regime"))
    return d.groupBy("regime").agg(rnd(corr("e", "qty"), 4).alias("link"), rnd(F.avg("e"), 4).alias("mae"), F.count(F.lit(1)).alias("n")).filter("n > 50")


@query("ev_entity_r2", f"{BASE}, {RDG_SRC}, " + gram_cte("g", "hh", ["key"], H3, "y", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b", "g", ["key"], 3) + ", " + gram_cte("g2", "hh", ["key"], ["rv_m"], "y", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b2", "g2", ["key"], 1) +
       f", e AS (SELECT hh.key AS key, y, {predict_sql(H3, 'b')} AS p, {predict_sql(['rv_m'], 'b2')} AS q FROM hh JOIN b ON hh.key = b.key JOIN b2 ON hh.key = b2.key WHERE date >= DATE '{SPLIT}' AND y IS NOT NULL AND rv_m IS NOT NULL) SELECT key, r4({r2_sql('p')}) AS r2_full, r4({r2_sql('q')}) AS r2_core, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 1 HAVING count(*) >= 50")
def ev_entity_r2(t):
    """Both models and both fits come from two rows of sums per key."""
    d = design_a(t).dropna(subset=["y", "rv_m"]).withColumn("part", F.when(F.col("date") < split_day(), "tr").otherwise("te"))
    g = G.sums(d, ["key", "part"], H3, "y")
    tr = G.solve(G.solve(g.filter("part = 'tr' and n_train >= 100"), 3, out="full"), 3, subset=[2], out="core").select("key", "full", "core")
    te = g.filter("part = 'te' and n_train >= 50").join(tr, "key")
    te = G.r2_from_sums(G.r2_from_sums(te, 3, beta="full", out="r2_full"), 3, [2], "core", "r2_core")
    return te.select("key", rnd("r2_full", 4).alias("r2_full"), rnd("r2_core", 4).alias("r2_core"), F.col("n_train").alias("n"))


@query("ev_overlap_check", f"""WITH {PANEL_A}, d AS (SELECT key, date, date < DATE '{SPLIT}' AS tr FROM pa) SELECT (SELECT max(date) FROM d WHERE tr) AS train_end, (SELECT min(date) FROM d WHERE NOT tr) AS test_start,
 CAST((SELECT min(date) FROM d WHERE NOT tr) - (SELECT max(date) FROM d WHERE tr) AS INTEGER) AS gap_days, CAST((SELECT count(*) FROM (SELECT key FROM d WHERE tr INTERSECT SELECT key FROM d WHERE NOT tr)) AS BIGINT) AS shared_keys""")
def ev_overlap_check(t):
    d = t.panel_a().withColumn("tr", F.col("date") < split_day())
    k = d.groupBy("key").agg(F.max(F.when(F.col("tr"), F.col("date"))).alias("a"), F.min(F.when(~F.col("tr"), F.col("date"))).alias("b"))
    o = k.agg(F.max("a").alias("train_end"), F.min("b").alias("test_start"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared_keys"))
    return o.select("train_end", "test_start", F.datediff("test_start", "train_end").alias("gap_days"), "shared_keys")


def two_part_sums(t, feats=F4):
    """One row with the training sums and the test sums under the prefix t_."""
    d = design_a(t).dropna(subset=["y", "rv_m"]).withColumn("part", F.when(F.col("date") < split_day(), "tr").otherwise("te"))
    g = G.sums(d, ["part"], feats, "y")
    cols = G.g_columns(len(feats))
    both = g.filter("part = 'tr'").withColumn("_te", g.filter("part = 'te'").select(F.struct(*cols)).scalar())
    return both.select("*", *[F.col(f"_te.{c}").alias("t_" + c) for c in cols]).drop("_te")


ABL = {"none": [0, 1, 2, 3], "no_daily": [1, 2, 3], "no_qty": [0, 1, 2]}


def abl_sql():
    ctes, outs = [], []
    for i, (name, keep) in enumerate(ABL.items()):
        f = [F4[k] for k in keep]
        ctes.append(gram_cte(f"ga{i}", "d", [], f, "y", "tr", lam="1.0") + ", " + solve_cte(f"ba{i}", f"ga{i}", [], len(f)))
        outs.append(f"SELECT '{name}' AS dropped, 1 - sum((y - {predict_sql(f)}) ** 2) / (var_pop(y) * count(*)) AS r2 FROM d, ba{i} WHERE NOT tr")
    return f"{BASE}, {RDG_SRC}, d AS (SELECT *, date < DATE '{SPLIT}' AS tr FROM hh WHERE y IS NOT NULL AND rv_m IS NOT NULL), {', '.join(ctes)}, o AS ({' UNION ALL '.join(outs)}) SELECT dropped, r4(r2) AS r2, r4((SELECT r2 FROM o WHERE dropped = 'none') - r2) AS lost FROM o"


@query("ev_ablation", abl_sql())
def ev_ablation(t):
    """Every feature subset is a sub-matrix of the same sums."""
    g = two_part_sums(t)
    for i, keep in enumerate(ABL.values()):
        g = G.r2_from_sums(G.solve(g, 4, 1.0, keep, f"b{i}"), 4, keep, f"b{i}", f"r{i}", "t_")
    rows_ = F.array(*[F.struct(F.lit(n).alias("dropped"), rnd(f"r{i}", 4).alias("r2"), rnd(F.col("r0") - F.col(f"r{i}"), 4).alias("lost")) for i, n in enumerate(ABL)])
    return g.select(F.explode(rows_).alias("s")).select("s.*")


SHIFTS = [-3, -1, 0, 1, 3]


def shift_col(k):
    return f"lag(qty, {k}) {OVER}" if k >= 0 else f"lead(qty, {-k}) {OVER}"


@query("ev_time_shift", f"{BASE}, {RDG_SRC}, sh AS (" + " UNION ALL ".join(f"SELECT {k} AS shift, key, date, y, rv_m, {shift_col(k)} AS sig FROM hh" for k in SHIFTS) + "), sv AS (SELECT * FROM sh WHERE y IS NOT NULL AND rv_m IS NOT NULL AND sig IS NOT NULL), "
       + gram_cte("g", "sv", ["shift"], ["rv_m", "sig"], "y", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b", "g", ["shift"], 2) + f" SELECT b.shift AS shift, r4(1 - sum((y - {predict_sql(['rv_m', 'sig'])}) ** 2) / (var_pop(y) * count(*))) AS r2 FROM sv JOIN b ON sv.shift = b.shift WHERE date >= DATE '{SPLIT}' GROUP BY 1")
def ev_time_shift(t):
    w = fr.by_key()
    vals = F.array(*[F.struct(F.lit(k).alias("shift"), (F.lag("qty", k) if k >= 0 else F.lead("qty", -k)).over(w).alias("sig")) for k in SHIFTS])
    d = design_a(t).withColumn("v", vals).select("key", "date", "y", "rv_m", F.explode("v").alias("v")).select("key", "date", "y", "rv_m", "v.*")
    return grouped_r2(d, ["shift"], ["rv_m", "sig"], F.when(F.col("date") < split_day(), "tr").otherwise("te"))


def grouped_r2(d, by, feats, part, lam=0.0, digits=4):
    """Fit on part 'tr', R2 on part 'te' of every group, from sums alone."""
    p = len(feats)
    g = G.sums(d.withColumn("part", part).filter(F.col("part").isNotNull()), [*by, "part"], feats, "y")
    beta = G.solve(g.filter("part = 'tr'"), p, lam).select(*by, "beta")
    out = G.r2_from_sums(g.filter("part = 'te'").join(beta, by), p)
    return out.select(*by, rnd("r2", digits).alias("r2"))


@query("ev_purged_cv", f"{BASE}, dr AS (SELECT *, dense_rank() OVER (ORDER BY date) AS dr FROM h), yrs AS (SELECT CAST(y0 AS INTEGER) AS fold, (SELECT min(dr) FROM dr WHERE year(date) = y0) AS first FROM (SELECT unnest(range(1997, (SELECT max(year(date)) FROM h) + 1)) AS y0) r), cv AS (SELECT fold, dr.*, year(date) = fold AS te FROM dr, yrs WHERE year(date) = fold OR dr.dr < first - 5), "
       + gram_cte("g", "cv", ["fold"], H3, "y", "NOT te") + ", " + solve_cte("b", "g", ["fold"], 3) + f" SELECT b.fold AS fold, r4({r2_sql(predict_sql(H3))}) AS r2 FROM cv JOIN b ON cv.fold = b.fold WHERE te GROUP BY 1")
def ev_purged_cv(t):
    """Year-forward folds, from 1997 to the last year of the data, with the last five
    training dates purged. The rank of a date comes from the calendar, and each row
    belongs to at most all folds."""
    d = FC.design(t.table_a())
    cal = d.select("date").distinct().withColumn("dr", F.row_number().over(fr.calendar()))
    years = list(range(1997, cal.agg(F.max(F.year("date"))).first()[0] + 1))
    first = cal.agg(*[F.min(F.when(F.year("date") == y, F.col("dr"))).alias(f"f{y}") for y in years])
    d = fr.with_scalars(fr.attach(d, cal, ["date"]), first)
    tags = F.array(*[F.struct(F.lit(y).alias("fold"), F.when(F.year("date") == y, "te").when(F.col("dr") < F.col(f"_g.f{y}") - 5, "tr").alias("part0")) for y in years])
    e = d.withColumn("v", F.explode(tags)).select("y", *H3, "v.*")
    return grouped_r2(e, ["fold"], H3, F.col("part0"))


@query("ev_placebo")
def ev_placebo(t):
    """Fit on a shuffled target for several seeds; z of the true fit against the
    shuffled ones. The permutation pairs two hashed orders, whose positions come
    from range-wise ranks, so no task sorts the whole target."""
    part = F.when(F.col("date") < split_day(), "tr").otherwise("te")
    d = design_a(t).dropna(subset=["y", "rv_m"]).select("key", "date", "y", *H3)
    true = grouped_r2(d.withColumn("seed", F.lit(0)), ["seed"], H3, part).agg(F.max("r2")).scalar()
    e = fr.rows_of(d, list(range(1, 11)), "seed")
    e = e.withColumn("to", F.xxhash64(F.lit("to"), "seed", "key", "date")).withColumn("from", F.xxhash64(F.lit("from"), "seed", "key", "date"))
    e = written(e)
    src = with_rank(e.select("seed", "y", "from"), ["seed"], "from", "i").select("seed", "i", "y")
    dst = with_rank(e.drop("y", "from"), ["seed"], "to", "i").drop("to", "i_n")
    r = grouped_r2(dst.join(src, ["seed", "i"]), ["seed"], H3, part)
    return r.agg(F.max(true).alias("true_r2"), rnd(F.avg("r2"), 4).alias("shuffled_mean"), rnd(F.max("r2"), 4).alias("shuffled_max"),
                 rnd(F.try_divide(F.max(true) - F.avg("r2"), F.stddev_samp("r2")), 2).alias("z"))


@query("ev_noise")
def ev_noise(t):
    """R2 when a feature is disturbed by hashed normal noise of growing size."""
    d = fr.rows_of(design_a(t).dropna(subset=["y", "rv_m"]), [0.0, 0.1, 0.5, 1.0], "level")
    u1, u2 = draw_unit("noise-a", "level", "key", "date"), draw_unit("noise-b", "level", "key", "date")
    z = F.sqrt(-2 * F.log(u1)) * F.cos(6.283185307179586 * u2)
    sd = design_a(t).agg(F.stddev_samp("rv_w")).scalar()
    d = d.withColumn("rv_w", F.col("rv_w") + F.col("level") * sd * z)
    return grouped_r2(d, ["level"], H3, F.when(F.col("date") < split_day(), "tr").otherwise("te"))


STABILITY_REPS = 500


@query("ev_coef_stability")
def ev_coef_stability(t):
    """Coefficients over hashed bootstrap replicates: Poisson weights per row."""
    d = design_a(t).dropna(subset=["y", *H3])
    products = G.products(d, ["key", "date"], H3, "y")
    g = RP.weighted_sums(products, ["key", "date"], G.g_columns(len(H3)), STABILITY_REPS, "stab").withColumn("n_train", F.col("g0").cast("long"))
    b = G.solve(g, 3).select("rep", F.posexplode("beta").alias("i", "b")).filter("i > 0")
    return b.groupBy("i").agg(rnd(F.avg("b"), 4).alias("mean"), rnd(F.stddev_samp("b"), 4).alias("sd"), rnd(F.percentile("b", 0.025), 4).alias("lo"),
                              rnd(F.percentile("b", 0.975), 4).alias("hi"), rnd(F.avg((F.col("b") > 0).cast("double")), 4).alias("share_positive"))


@query("ev_regime_ttest", f"{BASE}, {RDG_SRC}, " + gram_cte("g", "hh", [], F4, "y", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b", "g", [], 4) + ", " + gram_cte("g2", "hh", [], ["rv_m"], "y", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b2", "g2", [], 1) +
       f""", q AS (SELECT quantile_cont(qty, 0.25) AS q1, quantile_cont(qty, 0.75) AS q3 FROM hh WHERE date >= DATE '{SPLIT}' AND y IS NOT NULL AND rv_m IS NOT NULL), e AS (SELECT y, qty, n, {predict_sql(F4, 'b')} AS p, {predict_sql(['rv_m'], 'b2')} AS c FROM hh, b, b2 WHERE date >= DATE '{SPLIT}' AND y IS NOT NULL AND rv_m IS NOT NULL),
 s AS (SELECT 'all' AS slice, e.* FROM e UNION ALL SELECT 'low', e.* FROM e, q WHERE qty <= q1 UNION ALL SELECT 'high', e.* FROM e, q WHERE qty > q3 UNION ALL SELECT 'high_busy', e.* FROM e, q WHERE qty > q3 AND n > 5), d AS (SELECT *, (y - c) ** 2 - (y - p) ** 2 AS dd FROM s)
 SELECT slice, r4(sum(dd) / (var_pop(y) * count(*))) AS r2_gain, r4(avg(abs(y - c)) - avg(abs(y - p))) AS mae_gain, r4(avg(dd) / (stddev_samp(dd) / sqrt(count(*)))) AS t_stat, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY 1""")
def ev_regime_ttest(t):
    d = design_a(t)
    te = test(d).dropna(subset=["y", "rv_m"])
    e = G.fit_predict(train(d), te, [], F4, "y", out="p")
    e = G.fit_predict(train(d), e, [], ["rv_m"], "y", out="c")
    e = fr.with_scalars(e, quantiles(te, [], "qty", [.25, .75], ["q1", "q3"]))
    from ..operators.aggregates import sliced
    high = F.col("qty") > F.col("_g.q3")
    s = sliced(e, {"all": F.lit(True), "low": F.col("qty") <= F.col("_g.q1"), "high": high, "high_busy": high & (F.col("n") > 5)})
    y, p, c = F.col("y"), F.col("p"), F.col("c")
    s = s.withColumn("dd", (y - c) * (y - c) - (y - p) * (y - p))
    cnt = F.count(F.lit(1))
    return s.groupBy("slice").agg(rnd(ratio(F.sum("dd"), F.var_pop("y") * cnt), 4).alias("r2_gain"), rnd(F.avg(F.abs(y - c)) - F.avg(F.abs(y - p)), 4).alias("mae_gain"),
                                  rnd(ratio(F.avg("dd"), F.stddev_samp("dd") / F.sqrt(cnt)), 4).alias("t_stat"), cnt.alias("n"))

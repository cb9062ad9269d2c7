"""Forecasters and linear model operators."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import forecast as FC
from ..operators import frames as fr
from ..operators import gram as G
from ..operators import windows as W
from ..operators.evaluate import r2
from ..operators.ranks import quantiles
from .linear_sql import gram_cte, predict_sql, solve_cte
from .panels import HAR_SQL
from .registry import PANEL_A, query
from .windows import OVER, RET, returns, rows

START = "1997-01-01"
SPLIT = "1999-01-01"
BASE = f"WITH {PANEL_A}, {HAR_SQL}"
H3 = ["rv_d", "rv_w", "rv_m"]


def split_day():
    return F.lit(SPLIT).cast("date")


@query("fc_folds", """WITH e AS (SELECT max(CAST(l_shipdate AS DATE)) AS e FROM lineitem), r AS (SELECT unnest(range(TIMESTAMP '1997-01-01', CAST(e AS TIMESTAMP), INTERVAL 3 MONTH)) AS d, e FROM e)
 SELECT CAST(d AS DATE) AS train_end, CAST(d AS DATE) AS test_start, CAST(least(d + INTERVAL 3 MONTH, e) AS DATE) AS test_end FROM r""")
def fc_folds(t):
    """The horizon is the last day of the data."""
    end = t.lineitem.agg(F.max(F.to_date("l_shipdate")).alias("e")).first()["e"]
    return FC.folds(t.spark, START, str(end))


@query("fc_walkforward", f"""WITH {PANEL_A}, q AS (SELECT CAST(date_trunc('quarter', date) AS DATE) AS test_start, count(*) AS n_test, min(date) AS first_test FROM pa GROUP BY 1)
 SELECT test_start, CAST(n_test AS BIGINT) AS n_test, first_test, CAST((SELECT count(*) FROM pa WHERE date < test_start) AS BIGINT) AS n_train, (SELECT max(date) FROM pa WHERE date < test_start) AS last_train
 FROM q WHERE test_start >= DATE '{START}' AND (SELECT count(*) FROM pa WHERE date < test_start) >= 500""")
def fc_walkforward(t):
    return FC.fold_log(t.panel_a(), START)


HAR_FIT = (f"hq AS (SELECT DISTINCT key, CAST(date_trunc('quarter', date) AS DATE) AS q FROM h WHERE date >= DATE '{START}'), "
           "tr AS (SELECT hq.q AS q, h.* FROM h JOIN hq ON h.key = hq.key AND ydate < hq.q), "
           + gram_cte("g", "tr", ["key", "q"], H3, "y") + ", " + solve_cte("b", "g", ["key", "q"], 3)
           + f""", fcst AS (SELECT h.key AS key, h.date AS date, y, x, rv_d, rv_w, rv_m, CASE WHEN n_train >= 100 THEN {predict_sql(H3)} END AS har FROM h
 LEFT JOIN b ON h.key = b.key AND b.q = date_trunc('quarter', h.date) WHERE h.date >= DATE '{START}')""")


def har_forecasts(t, p=None):
    return FC.walk_forward(FC.design(p if p is not None else t.table_a()), H3, START, shared=False)


@query("fc_har", f"{BASE}, {HAR_FIT} SELECT key, date, r4(y) AS target, r4(har) AS har FROM fcst")
def fc_har(t):
    return har_forecasts(t).select("key", "date", rnd("y", 4).alias("target"), rnd("har", 4).alias("har"))


F4 = ["rv_d", "rv_w", "rv_m", "qty"]
RDG_SRC = f"hh AS (SELECT h.*, CAST(pa.qty AS DOUBLE) AS qty, CAST(pa.n AS DOUBLE) AS n FROM h JOIN pa USING (key, date))"
RIDGE = f"{BASE}, {RDG_SRC}, " + gram_cte("g", "hh", [], F4, "y", f"date < DATE '{SPLIT}'", lam="100.0") + ", " + solve_cte("b", "g", [], 4)


def design_a(t):
    return FC.design(t.table_a()).withColumn("n", F.col("n").cast("double"))


def train(d):
    return d.filter(F.col("date") < split_day())


def test(d):
    return d.filter(F.col("date") >= split_day())


@query("fc_ridge", f"{RIDGE} SELECT key, date, date < DATE '{SPLIT}' AS is_train, r4({predict_sql(F4)}) AS pred, r4(y - {predict_sql(F4)}) AS residual FROM hh, b")
def fc_ridge(t):
    d = design_a(t)
    out = G.fit_predict(train(d), d, [], F4, "y", 100.0)
    return out.select("key", "date", (F.col("date") < split_day()).alias("is_train"), rnd("pred", 4).alias("pred"),
                      rnd(F.col("y") - F.col("pred"), 4).alias("residual"))


def r2_sql(p, where="true"):
    return f"1 - sum((y - {p}) * (y - {p})) FILTER (WHERE y IS NOT NULL AND {p} IS NOT NULL) / (var_pop(y) FILTER (WHERE y IS NOT NULL AND {p} IS NOT NULL) * count(y) FILTER (WHERE y IS NOT NULL AND {p} IS NOT NULL))"


def r2_of(d, pred="pred", by=()):
    k = d.filter(F.col("y").isNotNull() & F.col(pred).isNotNull())
    return k.groupBy(*by).agg(rnd(r2("y", pred), 4).alias("r2"), F.count(F.lit(1)).alias("n"))


def group_models_sql(by, feats=H3, lam="1.0", src="hh"):
    return (gram_cte("g", src, [by], feats, "y", f"date < DATE '{SPLIT}'", lam=lam) + ", " + solve_cte("b", "g", [by], len(feats)) +
            f", pr AS (SELECT {src}.*, {predict_sql(feats)} AS p FROM {src} JOIN b USING ({by}) WHERE date >= DATE '{SPLIT}')")


@query("fc_sector_models", f"{BASE}, {RDG_SRC}, {group_models_sql('key')} SELECT key, r4({r2_sql('p')}) AS r2, CAST(count(*) FILTER (WHERE y IS NOT NULL AND p IS NOT NULL) AS BIGINT) AS n FROM pr GROUP BY 1")
def fc_sector_models(t):
    d = design_a(t)
    return r2_of(G.fit_predict(train(d), test(d), ["key"], H3, "y", 1.0, least=100), by=["key"])


@query("fc_stack", f"{RIDGE}, risk AS (SELECT key, date, qty / 100.0 AS risk FROM pa WHERE qty > 50) SELECT hh.key AS key, hh.date AS date, r4({predict_sql(F4)}) AS tech, r4(coalesce(risk, 0.2)) AS risk, r4(coalesce(risk, 0.2) * {predict_sql(F4)}) AS inter FROM hh CROSS JOIN b LEFT JOIN risk ON risk.key = hh.key AND risk.date = hh.date")
def fc_stack(t):
    d = design_a(t)
    tech = G.fit_predict(train(d), d, [], F4, "y", 100.0).select("key", "date", F.col("pred").alias("tech"))
    risk = t.table_a().filter("qty > 50").select("key", "date", (F.col("qty") / 100.0).alias("risk"))
    s = tech.join(risk, ["key", "date"], "left").withColumn("risk", F.coalesce("risk", F.lit(0.2)))
    return s.select("key", "date", rnd("tech", 4).alias("tech"), rnd("risk", 4).alias("risk"), rnd(F.col("risk") * F.col("tech"), 4).alias("inter"))


GRID = [i / 10 for i in range(11)]


@query("fc_ens_weights", f"{BASE}, d AS (SELECT * FROM h WHERE y IS NOT NULL AND rv_m IS NOT NULL), c AS (" + " UNION ALL ".join(
    f"SELECT {w}::DOUBLE AS w, 1 - sum((y - ({w} * rv_d + (1 - {w}) * rv_m)) ** 2) / (var_pop(y) * count(*)) AS r2 FROM d" for w in GRID) +
    "), v AS (SELECT 1 - sum((y - (rv_d + rv_w + rv_m) / 3) ** 2) / (var_pop(y) * count(*)) AS mean_r2 FROM d) SELECT w, r6(r2) AS r2, w = (SELECT arg_max(w, r2) FROM c) AS best, r6(mean_r2) AS mean_r2 FROM c, v")
def fc_ens_weights(t):
    d = FC.design(t.table_a()).dropna(subset=["y", "rv_m"])
    g = FC.grid_r2(d, "y", GRID, lambda w: w * F.col("rv_d") + (1 - w) * F.col("rv_m"))
    mean = d.withColumn("m", (F.col("rv_d") + F.col("rv_w") + F.col("rv_m")) / 3).agg(r2("y", "m")).scalar()
    best = g.agg(F.max_by("w", "r2")).scalar()
    return g.select("w", rnd("r2").alias("r2"), (F.col("w") == best).alias("best"), rnd(mean).alias("mean_r2"))


HEDGE_SQL = """dl AS (SELECT date, least(avg(exp(y - rv_d) - (y - rv_d) - 1), 10) AS l1, coalesce(least(avg(exp(y - rv_w) - (y - rv_w) - 1), 10), 0) AS l2 FROM h GROUP BY 1),
 dc AS (SELECT date, -2.0 * coalesce(sum(coalesce(l1, 0)) OVER w, 0) AS c1, -2.0 * coalesce(sum(coalesce(l2, 0)) OVER w, 0) AS c2 FROM dl WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 dw AS (SELECT date, exp(c1 - greatest(c1, c2)) / (exp(c1 - greatest(c1, c2)) + exp(c2 - greatest(c1, c2))) AS w1, exp(c2 - greatest(c1, c2)) / (exp(c1 - greatest(c1, c2)) + exp(c2 - greatest(c1, c2))) AS w2 FROM dc)"""


@query("fc_hedge", f"{BASE}, {HEDGE_SQL} SELECT key, h.date AS date, r6(w1) AS w1, r6(CASE WHEN rv_w IS NULL THEN rv_d ELSE (w1 * rv_d + w2 * rv_w) / (w1 + w2) END) AS pool FROM h JOIN dw ON h.date = dw.date")
def fc_hedge(t):
    d = FC.hedge(FC.design(t.table_a()), ["rv_d", "rv_w"], 2.0, "y")
    return d.select("key", "date", rnd("w_rv_d").alias("w1"), rnd("pool").alias("pool"))


REC = "WITH RECURSIVE " + RET[5:] + ", o AS (SELECT key, date, r, row_number() OVER (PARTITION BY key ORDER BY date) AS rn FROM r WHERE r IS NOT NULL), v0 AS (SELECT key, var_pop(r) AS v FROM o WHERE rn <= 20 GROUP BY 1)"


@query("fc_ewma", REC + """, f AS (SELECT o.*, v0.v AS v FROM o JOIN v0 USING (key) WHERE rn = 1 UNION ALL SELECT o.*, CAST(0.94 AS DOUBLE) * f.v + CAST(0.06 AS DOUBLE) * f.r * f.r FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, date, r6(ln(v)) AS log_var FROM f""")
def fc_ewma(t):
    return FC.ewma(returns(t).dropna(subset=["r"]), "r").select("key", "date", rnd("log_var").alias("log_var"))


@query("fc_garch_fixed", REC + """, f AS (SELECT o.*, v0.v AS v FROM o JOIN v0 USING (key) WHERE rn = 1 UNION ALL SELECT o.*, CAST(0.05 AS DOUBLE) + CAST(0.1 AS DOUBLE) * f.r * f.r + CAST(0.8 AS DOUBLE) * f.v FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, date, r6(v) AS variance FROM f""")
def fc_garch_fixed(t):
    return FC.garch_fixed(returns(t).dropna(subset=["r"]), "r", 0.05, 0.1, 0.8).select("key", "date", rnd("variance").alias("variance"))


@query("fc_garch_grid")
def fc_garch_grid(t):
    r = returns(t).dropna(subset=["r"]).select("key", "date", "r")
    d = FC.garch_grid(r, "r", 0.05, 500, 252).filter(~F.isnan("var_q"))
    return d.select("key", "date", rnd("var_q").alias("var_q"), (-F.col("r") > F.col("var_q")).alias("breach"))


@query("fc_caviar_grid")
def fc_caviar_grid(t):
    r = returns(t).dropna(subset=["r"]).select("key", "date", "r")
    d = FC.caviar_grid(r, "r", 0.05, 500, 252).filter(~F.isnan("var_q"))
    return d.select("key", "date", rnd("var_q").alias("var_q"), (-F.col("r") > F.col("var_q")).alias("breach"))


@query("fc_har_qreg")
def fc_har_qreg(t):
    d = FC.har_quantiles(FC.design(t.table_a()), [0.05, 0.5, 0.95], 500, 252).filter(~F.isnan("q500"))
    return d.select("key", "date", rnd("q050", 4).alias("q050"), rnd("q500", 4).alias("q500"), rnd("q950", 4).alias("q950"))


@query("fc_vol_surprise", f"{BASE}, s AS (SELECT key, date, y - rv_w AS surprise FROM h) SELECT key, date, r6(surprise) AS surprise, abs(surprise) > 1 AS extreme, CAST(sign(surprise) AS INTEGER) AS direction FROM s WHERE surprise IS NOT NULL")
def fc_vol_surprise(t):
    s = F.col("y") - F.col("rv_w")
    return FC.design(t.table_a()).withColumn("s", s).dropna(subset=["s"]).select(
        "key", "date", rnd("s").alias("surprise"), (F.abs("s") > 1).alias("extreme"), F.signum("s").cast("int").alias("direction"))


@query("fc_conditional_corr", f"{BASE}, {RDG_SRC}, q AS (SELECT quantile_cont(qty, 0.8) AS q FROM hh) SELECT key, date, r6(CASE WHEN qty > q THEN rv_w + 0.5 * (rv_d - rv_w) ELSE rv_w END) AS pred FROM hh, q")
def fc_conditional_corr(t):
    d = design_a(t)
    d = fr.with_scalars(d, quantiles(d, [], "qty", [0.8], ["q"]))
    p = F.when(F.col("qty") > F.col("_g.q"), F.col("rv_w") + 0.5 * (F.col("rv_d") - F.col("rv_w"))).otherwise(F.col("rv_w"))
    return d.select("key", "date", rnd(p).alias("pred"))


REG_SRC = f"{RDG_SRC}, hr AS (SELECT *, CASE WHEN n > 5 THEN 'high' WHEN n < 3 THEN 'low' ELSE 'normal' END AS regime FROM hh)"


def regime_rows(t):
    return design_a(t).withColumn("regime", F.when(F.col("n") > 5, "high").when(F.col("n") < 3, "low").otherwise("normal"))


@query("fc_regime_models", f"{BASE}, {REG_SRC}, {group_models_sql('regime', src='hr')} SELECT regime, r4({r2_sql('p')}) AS r2, CAST(count(*) FILTER (WHERE y IS NOT NULL AND p IS NOT NULL) AS BIGINT) AS n FROM pr GROUP BY 1")
def fc_regime_models(t):
    d = regime_rows(t)
    return r2_of(G.fit_predict(train(d), test(d), ["regime"], H3, "y", 1.0), by=["regime"])


@query("fc_entity_models", f"{BASE}, {RDG_SRC}, " + gram_cte("g", "hh", ["key"], H3, "y", f"date < DATE '{SPLIT}'", lam="1.0") + ", " + solve_cte("b", "g", ["key"], 3) + ", "
       + gram_cte("ga", "hh", [], H3, "y", f"date < DATE '{SPLIT}'", lam="1.0") + ", " + solve_cte("ba", "ga", [], 3)
       + f" SELECT hh.key AS key, date, r4(CASE WHEN b.n_train >= 30 THEN {predict_sql(H3, 'b')} ELSE {predict_sql(H3, 'ba')} END) AS pred FROM hh LEFT JOIN b ON hh.key = b.key CROSS JOIN ba WHERE date >= DATE '{SPLIT}'")
def fc_entity_models(t):
    """A key with fewer than 30 training rows takes the global model."""
    d = design_a(t)
    tr = train(d)
    own = G.solve(G.sums(tr, ["key"], H3, "y").filter("n_train >= 30"), 3, 1.0).select("key", "beta")
    shared = G.solve(G.sums(tr, [], H3, "y"), 3, 1.0).select("beta").scalar()
    out = fr.attach(test(d), own, ["key"]).withColumn("_all", shared).withColumn("beta", F.coalesce("beta", "_all"))
    return out.select("key", "date", rnd(G.predict(H3), 4).alias("pred"))


@query("fc_weighted", f"{BASE}, {RDG_SRC}, sp AS (SELECT min(date) AS a, max(date) AS b FROM hh WHERE date < DATE '{SPLIT}'), hw AS (SELECT hh.*, 0.5 + CAST(date - a AS DOUBLE) / CAST(b - a AS DOUBLE) AS wt FROM hh, sp), "
       + gram_cte("g", "hw", [], H3, "y", f"date < DATE '{SPLIT}'", "wt", "1.0") + ", " + solve_cte("b", "g", [], 3) + " SELECT r4(b0) AS b0, r4(b1) AS b1, r4(b2) AS b2, r4(b3) AS b3 FROM b")
def fc_weighted(t):
    tr = train(design_a(t))
    tr = fr.with_scalars(tr, tr.agg(F.min("date").alias("a"), F.max("date").alias("b")))
    w = 0.5 + F.datediff("date", "_g.a").cast("double") / F.datediff("_g.b", "_g.a")
    b = G.solve(G.sums(tr, [], H3, "y", w), 3, 1.0)
    return b.select(*[rnd(F.col("beta")[i], 4).alias(f"b{i}") for i in range(4)])


ALL5 = ["rv_d", "rv_w", "rv_m", "qty", "n"]


@query("fc_select", f"{BASE}, {RDG_SRC}, d AS (SELECT * FROM hh WHERE y IS NOT NULL AND rv_m IS NOT NULL AND date < DATE '{SPLIT}'), c AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, y) AS c, count(*) AS n FROM d" for f in ALL5) + ") SELECT feature, r6(c) AS corr, r4(c * c / (1 - c * c) * (n - 2)) AS f_stat, CAST(row_number() OVER (ORDER BY abs(c) DESC) AS INTEGER) AS rank FROM c QUALIFY rank <= 3")
def fc_select(t):
    from pyspark.sql import Window

    from ..operators.evaluate import correlation_scan
    c = correlation_scan(train(design_a(t)).dropna(subset=["y", "rv_m"]), ALL5, "y")
    c2 = F.col("corr") * F.col("corr")
    d = c.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("corr"))))).filter("rank <= 3")
    return d.select("feature", rnd("corr").alias("corr"), rnd(F.try_divide(c2, 1 - c2) * (F.col("n") - 2), 4).alias("f_stat"), "rank")


@query("fc_two_stage", f"{BASE}, {RDG_SRC}, " + gram_cte("g1", "hh", [], ["rv_d"], "y", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b1_", "g1", [], 1)
       + ", s2 AS (SELECT hh.*, b0 + b1 * rv_d AS p1, y - (b0 + b1 * rv_d) AS res FROM hh, b1_), " + gram_cte("g2", "s2", [], ["rv_m", "qty"], "res", f"date < DATE '{SPLIT}'") + ", " + solve_cte("b2_", "g2", [], 2)
       + f" SELECT key, date, r4(p1) AS stage1, r4(p1 + b0 + b1 * rv_m + b2 * qty) AS total FROM s2, b2_ WHERE date >= DATE '{SPLIT}'")
def fc_two_stage(t):
    d = design_a(t)
    d = G.fit_predict(train(d), d, [], ["rv_d"], "y", out="p1").withColumn("res", F.col("y") - F.col("p1"))
    d = G.fit_predict(train(d), d, [], ["rv_m", "qty"], "res", out="p2")
    return test(d).select("key", "date", rnd("p1", 4).alias("stage1"), rnd(F.col("p1") + F.col("p2"), 4).alias("total"))


POLY = ["rv_d", "rv_m", "d2", "m2", "dm"]


@query("fc_poly", f"{BASE}, hp AS (SELECT *, (rv_d - 11) * (rv_d - 11) AS d2, (rv_m - 11) * (rv_m - 11) AS m2, (rv_d - 11) * (rv_m - 11) AS dm FROM h), " + gram_cte("g", "hp", [], POLY, "y", f"date < DATE '{SPLIT}'", lam="1.0") + ", " + solve_cte("b", "g", [], 5)
       + f" SELECT key, date, r4({predict_sql(POLY)}) AS pred FROM hp, b WHERE date >= DATE '{SPLIT}' AND rv_m IS NOT NULL")
def fc_poly(t):
    u, v = F.col("rv_d") - 11, F.col("rv_m") - 11
    d = FC.design(t.table_a()).withColumn("d2", u * u).withColumn("m2", v * v).withColumn("dm", u * v)
    out = G.fit_predict(train(d), test(d), [], POLY, "y", 1.0)
    return out.filter("rv_m is not null").select("key", "date", rnd("pred", 4).alias("pred"))


LAMS = [0.0, 1.0, 100.0]


def param_sql(name, feats):
    parts = []
    for i, lam in enumerate(LAMS):
        g, b = f"g{name}{i}", f"b{name}{i}"
        parts.append(gram_cte(g, "d", [], feats, "y", "is_train", lam=str(lam)) + ", " + solve_cte(b, g, [], len(feats)))
    return ", ".join(parts)


def param_rows(name, feats):
    out = []
    for i, lam in enumerate(LAMS):
        p = predict_sql(feats)
        e = f"(y - {p}) * (y - {p})"
        out.append(f"SELECT '{name}' AS features, {lam}::DOUBLE AS lam, r4(1 - sum({e}) FILTER (WHERE is_train) / (var_pop(y) FILTER (WHERE is_train) * count(*) FILTER (WHERE is_train))) AS train_r2, "
                   f"r4(1 - sum({e}) FILTER (WHERE NOT is_train) / (var_pop(y) FILTER (WHERE NOT is_train) * count(*) FILTER (WHERE NOT is_train))) AS test_r2 FROM d, b{name}{i}")
    return " UNION ALL ".join(out)


@query("fc_param_grid", f"{BASE}, {RDG_SRC}, d AS (SELECT *, date < DATE '{SPLIT}' AS is_train FROM hh WHERE y IS NOT NULL AND rv_m IS NOT NULL), {param_sql('har', H3)}, {param_sql('all', F4)} {param_rows('har', H3)} UNION ALL {param_rows('all', F4)}")
def fc_param_grid(t):
    """All penalties and feature subsets from the two rows of sums."""
    d = design_a(t).dropna(subset=["y", "rv_m"]).withColumn("part", F.when(F.col("date") < split_day(), "tr").otherwise("te"))
    g = G.sums(d, ["part"], F4, "y")
    tr, te = g.filter("part = 'tr'"), g.filter("part = 'te'")
    cols = G.g_columns(4)
    both = tr.withColumn("_te", te.select(F.struct(*cols)).scalar())
    both = both.select("*", *[F.col(f"_te.{c}").alias("t_" + c) for c in cols])
    parts = []
    for name, keep in (("har", [0, 1, 2]), ("all", [0, 1, 2, 3])):
        s = G.solve(fr.rows_of(both, LAMS, "lam"), 4, F.col("lam"), keep)
        s = G.r2_from_sums(s, 4, keep, out="train_r2")
        s = G.r2_from_sums(s, 4, keep, out="test_r2", sums_prefix="t_")
        parts.append(s.select(F.lit(name).alias("features"), "lam", rnd("train_r2", 4).alias("train_r2"), rnd("test_r2", 4).alias("test_r2")))
    return parts[0].unionByName(parts[1])


@query("fc_naive", f"WITH {PANEL_A}, a AS (SELECT key, date, lead(x) {OVER} AS y, x AS walk, avg(x) {rows(4, 0)} AS m5, avg(x) {rows('UNBOUNDED', 0)} AS mean FROM pa), d AS (SELECT * FROM a WHERE y IS NOT NULL)"
       " SELECT model, r4(1 - sum((y - p) ** 2) / (var_pop(y) * count(*))) AS r2 FROM (SELECT 'walk' AS model, y, walk AS p FROM d UNION ALL SELECT 'm5', y, m5 FROM d UNION ALL SELECT 'mean', y, mean FROM d) GROUP BY 1")
def fc_naive(t):
    from pyspark.sql import Window
    w = fr.by_key()
    d = t.panel_a().select("key", "date", F.lead("x").over(w).alias("y"), F.col("x").alias("walk"), W.mean("x", 5).alias("m5"),
                           F.avg("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mean")).dropna(subset=["y"])
    return d.unpivot(["y"], ["walk", "m5", "mean"], "model", "p").groupBy("model").agg(rnd(r2("y", "p"), 4).alias("r2"))



"""Inference on the daily frame (method, date)."""

from pyspark.sql import functions as F

from ..functions.columns import ratio, rnd
from ..operators import evaluate as EV
from ..operators import forecast as FC
from ..operators import frames as fr
from ..operators import inference as IN
from ..operators import replicates as RP
from ..operators import sliding as SL
from ..session import written
from .evaluation import EP_SQL, PRD, RUN_SQL, bounds, bq, daily, predicted, six, stress_runs
from .forecasts import BASE
from .registry import query
from .windows import rows

# Replicates of the published reports.
BLOCK_REPS, WILD_REPS, EPISODE_REPS, RW_REPS, MCS_REPS, IID_REPS = 2000, 9999, 10000, 4999, 2000, 1000


def hac_sql(src, by="", lag="CAST(floor(4 * power(n / 100.0, 2.0 / 9.0) + 1e-12) AS INTEGER)", name="hm", most=12):
    """Mean and HAC standard error of column v of ``src`` by date."""
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    lagged = ", ".join(f"sum(c * l{k}) AS s{k}" for k in range(1, most + 1))
    var = "s0" + "".join(f" + CASE WHEN lg >= {k} THEN 2 * (1 - {k} / (lg + 1.0)) * coalesce(s{k}, 0) ELSE 0 END" for k in range(1, most + 1))
    return (f"{name}c AS (SELECT *, v - avg(v) OVER ({part.strip()}) AS c FROM {src}), {name}l AS (SELECT *, " + ", ".join(f"lag(c, {k}) OVER ({part}ORDER BY date) AS l{k}" for k in range(1, most + 1)) +
            f" FROM {name}c), {name}s AS (SELECT {head}count(*) AS n, avg(v) AS mean, sum(c * c) AS s0, {lagged} FROM {name}l{grp}), {name}g AS (SELECT *, {lag} AS lg FROM {name}s), "
            f"{name} AS (SELECT {head}CAST(n AS BIGINT) AS n, mean, sqrt(({var}) / n / n) AS se, lg AS lag FROM {name}g)")


DM_SRC = f"{BASE}, d AS (SELECT date, avg((exp(y - rv_w) - (y - rv_w) - 1) - (exp(y - rv_m) - (y - rv_m) - 1)) AS v FROM h WHERE y IS NOT NULL AND rv_m IS NOT NULL GROUP BY 1), "


def dm_daily(t):
    from ..functions.columns import qlike
    d = FC.design(t.table_a()).dropna(subset=["y", "rv_m"])
    return IN.daily_mean(d, qlike("y", "rv_w") - qlike("y", "rv_m"), [])


@query("in_dm", DM_SRC + hac_sql("d") + " SELECT n, r6(mean) AS mean, r4(mean / se) AS dm FROM hm")
def in_dm(t):
    return IN.dm_test(dm_daily(t), []).select("n", rnd("mean").alias("mean"), rnd("dm", 4).alias("dm"))


@query("in_dm_h", f"{BASE}, e AS (SELECT key, date, (y - rv_w) ** 2 - (y - rv_m) ** 2 AS v FROM h WHERE y IS NOT NULL AND rv_m IS NOT NULL), " + hac_sql("e", "key", "2", most=2) + " SELECT key, n, r4(mean / se) AS dm FROM hm")
def in_dm_h(t):
    """Unclustered, squared errors, horizon 3 (bandwidth 2), one test per key."""
    d = FC.design(t.table_a()).dropna(subset=["y", "rv_m"])
    e = d.select("key", "date", (F.pow(F.col("y") - F.col("rv_w"), 2) - F.pow(F.col("y") - F.col("rv_m"), 2)).alias("v"))
    return IN.dm_test(e, ["key"], 2).select("key", "n", rnd("dm", 4).alias("dm"))


@query("in_hac_mean", bq("SELECT method, n, r6(mean) AS mean, r6(se) AS se, lag FROM hm", ", dv AS (SELECT method, date, cov AS v FROM dl), " + hac_sql("dv", "method")))
def in_hac_mean(t):
    return IN.hac_mean(daily(t).withColumn("v", F.col("cov")), ["method"]).select("method", "n", rnd("mean").alias("mean"), rnd("se").alias("se"), "lag")


PAIR = ", sl AS (SELECT a.method AS method, a.date AS date, a.cov - r.cov AS v, a.stress AS stress, run FROM dl a JOIN dl r ON a.date = r.date AND r.method = 'aci' AND a.method <> 'aci' LEFT JOIN rl ON rl.date = a.date), ps AS (SELECT 'marginal' AS slice, * FROM sl UNION ALL SELECT 'stress', * FROM sl WHERE stress UNION ALL SELECT 'early', * FROM sl WHERE run BETWEEN 1 AND 3), pv AS (SELECT method || ':' || slice AS grp, date, v FROM ps), "


def gaps(t):
    """Differences to the reference method per date."""
    d = written(daily(t))
    ref = d.filter("method = 'aci'").select("date", F.col("cov").alias("ref"), F.col("cov_hi").alias("ref_hi"), F.col("isc").alias("ref_isc"))
    return d.filter("method <> 'aci'").join(ref, "date").withColumn("v", F.col("cov") - F.col("ref"))


@query("in_paired_vs_ref", bq("SELECT grp, n, r6(mean) AS diff, r6(se) AS se, r4(mean / se) AS t, r6(mean - 1.96 * se) AS ci_lo, r6(mean + 1.96 * se) AS ci_hi FROM hm", RUN_SQL + PAIR + hac_sql("pv", "grp")))
def in_paired_vs_ref(t):
    from ..operators.aggregates import sliced
    d = gaps(t).join(stress_runs(t), "date", "left")
    s = sliced(d, {"marginal": F.lit(True), "stress": F.col("stress"), "early": F.col("run").between(1, 3)})
    s = s.select(F.concat_ws(":", "method", "slice").alias("grp"), "date", "v")
    h = IN.hac_mean(s, ["grp"])
    m, se = F.col("mean"), F.col("se")
    return h.select("grp", "n", rnd(m).alias("diff"), rnd(se).alias("se"), rnd(m / se, 4).alias("t"), rnd(m - 1.96 * se).alias("ci_lo"), rnd(m + 1.96 * se).alias("ci_hi"))


def hash_sql(seed, *parts):
    return f"CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 8)) AS BIGINT)"


def draws_sql(seed, block=20, reps=BLOCK_REPS, circular=False, src="dl"):
    span = "T" if circular else f"(T - {block} + 1)"
    at = "(st0 + k) % T" if circular else "st0 + k"
    return (f", pq AS (SELECT DISTINCT date FROM {src}), ps0 AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS T FROM pq), "
            f"dr0 AS (SELECT rep, b, T, {hash_sql(seed, 'rep', 'b')} % {span} AS st0 FROM (SELECT max(T) AS T FROM ps0), range(1, {reps + 1}) rr(rep), range(0, (SELECT CAST(ceil(max(T) / {block}.0) AS BIGINT) FROM ps0)) bb(b)), "
            f"drw AS (SELECT rep, {at} AS pos, count(*) AS times FROM dr0, range(0, {block}) kk(k) WHERE b * {block} + k < T GROUP BY 1, 2)")


@query("in_block_boot", bq("SELECT method, r6(quantile_cont(m, 0.025)) AS ci_lo, r6(quantile_cont(m, 0.975)) AS ci_hi, r6(stddev_samp(m)) AS se FROM bm GROUP BY 1",
                           draws_sql("boot") + ", bm AS (SELECT rep, method, sum(cov * times) / sum(times) AS m FROM drw JOIN ps0 USING (pos) JOIN dl USING (date) GROUP BY 1, 2)"))
def in_block_boot(t):
    m = RP.block_means(daily(t), ["method"], ["cov"], BLOCK_REPS, 20, "boot")
    return six(m.groupBy("method").agg(F.percentile("cov", 0.025).alias("ci_lo"), F.percentile("cov", 0.975).alias("ci_hi"), F.stddev_samp("cov").alias("se")), "ci_lo", "ci_hi", "se", keep=("method",))


DISP = """, bb AS (SELECT method, date, bin, sum(cov) AS s, count(*) AS c FROM bx WHERE bin IS NOT NULL GROUP BY 1, 2, 3),
 rb AS (SELECT rep, method, bin, sum(s * times) / sum(c * times) AS cv, sum(c * times) AS c FROM drw JOIN ps0 USING (pos) JOIN bb USING (date) GROUP BY 1, 2, 3),
 rd AS (SELECT rep, method, sqrt(sum(c * (cv - 0.9) ** 2) / sum(c)) AS d FROM rb GROUP BY 1, 2), df AS (SELECT b.method AS method, a.rep AS rep, a.d - b.d AS diff FROM rd a JOIN rd b ON a.rep = b.rep AND a.method = 'aci' AND b.method <> 'aci')"""


@query("in_dispersion_boot", bq("SELECT method, r6(avg(diff)) AS mean_diff, r6(quantile_cont(diff, 0.025)) AS ci_lo, r6(quantile_cont(diff, 0.975)) AS ci_hi, r6(2 * least(avg(CAST(diff <= 0 AS DOUBLE)), avg(CAST(diff >= 0 AS DOUBLE)))) AS p FROM df GROUP BY 1", draws_sql("disp") + DISP))
def in_dispersion_boot(t):
    """The reference against each other method; replicates re-weight per-date sums of every (method, bin)."""
    d = bounds(t).withColumn("bin", EV.cut("level_pctl", EV.STATE_EDGES, EV.STATE_LABELS))
    b = written(d.groupBy("method", "date", "bin").agg(F.sum(EV.b2d("covered")).alias("s"), F.count(F.lit(1)).alias("c")))
    dates = [r["date"] for r in b.select("date").distinct().collect()]
    r = RP.block_sums(b.filter(F.col("bin").isNotNull()), ["method", "bin"], ["s", "c"], dates, BLOCK_REPS, 20, "disp").filter("c > 0")
    g = r.groupBy("rep", "method").agg(F.sqrt(F.sum(F.col("c") * F.pow(F.col("s") / F.col("c") - 0.9, 2)) / F.sum("c")).alias("d"))
    ref = g.filter("method = 'aci'").select("rep", F.col("d").alias("ref"))
    w = g.filter("method <> 'aci'").join(ref, "rep").withColumn("diff", F.col("ref") - F.col("d"))
    p = 2 * F.least(F.avg((F.col("diff") <= 0).cast("double")), F.avg((F.col("diff") >= 0).cast("double")))
    return w.groupBy("method").agg(rnd(F.avg("diff")).alias("mean_diff"), rnd(F.percentile("diff", 0.025)).alias("ci_lo"), rnd(F.percentile("diff", 0.975)).alias("ci_hi"), rnd(p).alias("p"))


LAGS = [0, 5, 10, 22]


@query("in_hac_lags", DM_SRC + ", ".join(hac_sql("d", lag=str(k), name=f"h{k}", most=max(k, 1)) for k in LAGS) + " " + " UNION ALL ".join(f"SELECT {k} AS lag, r4(mean / se) AS t FROM h{k}" for k in LAGS))
def in_hac_lags(t):
    return IN.hac_lags(dm_daily(t), LAGS).select("lag", rnd("t", 4).alias("t"))


@query("in_balance_z", bq("SELECT a.method AS method, r4((a.mean - b.mean) / sqrt(a.se * a.se + b.se * b.se)) AS z FROM hs a JOIN hn b ON a.method = b.method",
                          ", vs AS (SELECT method, date, 1 - cov AS v FROM dl WHERE stress), vn AS (SELECT method, date, 1 - cov AS v FROM dl WHERE NOT stress), " + hac_sql("vs", "method", name="hs") + ", " + hac_sql("vn", "method", name="hn")))
def in_balance_z(t):
    d = daily(t).select("method", "date", (1 - F.col("cov")).alias("v"), "stress")
    h = IN.hac_mean(d, ["method", "stress"])
    a = h.groupBy("method").agg(*[F.max(F.when(c, F.col(x))).alias(x + n) for n, c in (("1", F.col("stress")), ("0", ~F.col("stress"))) for x in ("mean", "se")])
    return a.select("method", rnd((F.col("mean1") - F.col("mean0")) / F.sqrt(F.col("se1") * F.col("se1") + F.col("se0") * F.col("se0")), 4).alias("z"))


GAP = ", gp AS (SELECT a.method AS method, a.date AS date, a.cov - r.cov AS v, a.stress AS stress FROM dl a JOIN dl r ON a.date = r.date AND r.method = 'aci' AND a.method <> 'aci')"
REG = GAP + ", rg AS (SELECT method, avg(CASE WHEN NOT stress THEN v END) AS b0, avg(CASE WHEN stress THEN v END) - avg(CASE WHEN NOT stress THEN v END) AS b1, count(*)::DOUBLE AS n, count_if(stress)::DOUBLE AS n1 FROM gp GROUP BY 1), ru AS (SELECT gp.*, CAST(stress AS INTEGER)::DOUBLE AS x, v - b0 - b1 * CAST(stress AS INTEGER) AS u FROM gp JOIN rg USING (method))"


@query("in_stress_reg", bq("SELECT method, r6(b0) AS b0, r6(b1) AS b1, CAST(n AS BIGINT) AS n, CAST(n1 AS BIGINT) AS n1 FROM rg", REG))
def in_stress_reg(t):
    d = IN.stress_regression(gaps(t), ["method"])
    return d.select("method", rnd("b0").alias("b0"), rnd("b1").alias("b1"), "n", "n1")


def sandwich(m00, m01, m11, n="n", n1="n1"):
    return f"(({m00}) / (({n} - {n1}) ** 2) - 2 * ({m01}) * {n} / ({n1} * ({n} - {n1}) ** 2) + ({m11}) * ({n} / ({n1} * ({n} - {n1}))) ** 2)"


def hac_beta_sql(src="ru", reg="rg", by="method", most=12, name="hb"):
    p = f"PARTITION BY {by} ORDER BY date"
    lg = "CAST(floor(4 * power(n / 100.0, 2.0 / 9.0) + 1e-12) AS INTEGER)"
    cols = ["sum(u * u) AS a0, sum(u * u * x) AS b0_, sum(u * x * u * x) AS c0"]
    lags = []
    for k in range(1, most + 1):
        lags.append(f"lag(u, {k}) OVER ({p}) AS u{k}, lag(u * x, {k}) OVER ({p}) AS g{k}")
        cols.append(f"coalesce(sum(u * u{k}), 0) AS a{k}, coalesce(sum(u * g{k} + u * x * u{k}), 0) AS b{k}_, coalesce(sum(u * x * g{k}), 0) AS c{k}")
    w = lambda k: f"(CASE WHEN lg >= {k} THEN 1 - {k} / (lg + 1.0) ELSE 0 END)"
    tot = {e: f"{e}0{'_' if e == 'b' else ''}" + "".join(f" + {w(k)} * {e}{k}{'_' if e == 'b' else ''} * {1 if e == 'b' else 2}" for k in range(1, most + 1)) for e in "abc"}
    keys = ", ".join(f"{name}s.{k}" for k in by.split(", "))
    on = " AND ".join(f"{name}s.{k} = {reg}.{k}" for k in by.split(", "))
    return (f"{name}l AS (SELECT *, {', '.join(lags)} FROM {src}), {name}s AS (SELECT {by}, {', '.join(cols)} FROM {name}l GROUP BY {by}), "
            f"{name} AS (SELECT {keys}, b0, b1, n, sqrt({sandwich(tot['a'], tot['b'], tot['c'])}) AS se FROM (SELECT *, {lg} AS lg FROM {reg}) {reg} JOIN {name}s ON {on})")


@query("in_hac_beta", bq("SELECT method, r6(b1) AS b1, r6(se) AS se, r4(b1 / se) AS t FROM hb", REG + ", " + hac_beta_sql()))
def in_hac_beta(t):
    d = IN.hac_beta(gaps(t), ["method"])
    return d.select("method", rnd("b1").alias("b1"), rnd("se").alias("se"), rnd(ratio("b1", "se"), 4).alias("t"))


CL = EP_SQL + ", cl AS (SELECT dd.date AS date, CASE WHEN dd.stress THEN 'ep' || CAST(episode AS VARCHAR) ELSE 'q' || CAST(year(dd.date) AS VARCHAR) || 'Q' || CAST(quarter(dd.date) AS VARCHAR) END AS cluster FROM (SELECT DISTINCT date, stress FROM dl) dd LEFT JOIN ep ON ep.date = dd.date)"


def clustered(t):
    """Gaps with their episode or quarter; episodes are numbered on the calendar
    of the market frame."""
    from .evaluation import stress_episodes
    quarter = F.concat(F.lit("q"), F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string"))
    d = gaps(t).join(stress_episodes(t), "date", "left")
    return d.withColumn("cluster", F.when(F.col("stress"), F.concat(F.lit("ep"), F.col("episode").cast("string"))).otherwise(quarter))


CSE = ", cg AS (SELECT method, cluster, sum(u) AS g0, sum(u * x) AS g1 FROM ru JOIN cl USING (date) GROUP BY 1, 2), cm AS (SELECT method, sum(g0 * g0) AS m00, sum(g0 * g1) AS m01, sum(g1 * g1) AS m11, count(*)::DOUBLE AS g FROM cg GROUP BY 1), ce AS (SELECT method, b1, g, sqrt(g / (g - 1) * (n - 1) / (n - 2) * " + sandwich("m00", "m01", "m11") + ") AS se FROM cm JOIN rg USING (method))"


@query("in_cluster_se", bq("SELECT method, r6(b1) AS b1, CAST(g AS BIGINT) AS g, r6(se) AS se FROM ce", CL + REG + CSE))
def in_cluster_se(t):
    d = IN.cluster_se(clustered(t), ["method"], "cluster")
    return d.select("method", rnd("b1").alias("b1"), "g", rnd("se").alias("se"))


WILD = f""", wg0 AS (SELECT method, avg(v) AS am FROM gp GROUP BY 1),
 wd AS (SELECT method, cluster, sum(v - am) AS r0, sum(CASE WHEN stress THEN v - am ELSE 0 END) AS r1, count(*)::DOUBLE AS c0, count_if(stress)::DOUBLE AS c1 FROM gp JOIN cl USING (date) JOIN wg0 USING (method) GROUP BY 1, 2),
 wb AS (SELECT rep, wd.*, CASE WHEN {hash_sql('wild', 'rep', 'cluster')} % 2 = 0 THEN 1.0 ELSE -1.0 END AS w FROM wd, range(1, {WILD_REPS + 1}) r(rep)),
 wt AS (SELECT method, rep, sum(c0) AS n, sum(c1) AS n1, sum(w * r0) AS s0, sum(w * r1) AS s1, count(*)::DOUBLE AS g FROM wb GROUP BY 1, 2), wc AS (SELECT *, (s0 - s1) / (n - n1) AS b0, s1 / n1 - (s0 - s1) / (n - n1) AS b1 FROM wt),
 wg AS (SELECT method, rep, w * r0 - b0 * c0 - b1 * c1 AS g0, w * r1 - (b0 + b1) * c1 AS g1 FROM wb JOIN wc USING (method, rep)), wm AS (SELECT method, rep, sum(g0 * g0) AS m00, sum(g0 * g1) AS m01, sum(g1 * g1) AS m11 FROM wg GROUP BY 1, 2),
 wx AS (SELECT method, abs(b1 / sqrt(g / (g - 1) * (n - 1) / (n - 2) * {sandwich('m00', 'm01', 'm11')})) AS tb FROM wm JOIN wc USING (method, rep)), wo AS (SELECT method, abs(b1 / se) AS t FROM ce)"""


def per_method(d, run):
    """The result of ``run`` on the rows of each method; methods are a short list."""
    d, out = written(d), None
    for name in sorted(r["method"] for r in d.select("method").distinct().collect()):
        one = run(d.filter(F.col("method") == name)).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("in_wild", bq("SELECT method, r6(avg(CAST(tb >= t AS DOUBLE))) AS p, r4(max(t)) AS t_obs, CAST(count(*) AS BIGINT) AS reps FROM wx JOIN wo USING (method) GROUP BY 1", CL + REG + CSE + WILD))
def in_wild(t):
    d = per_method(clustered(t), lambda one: IN.wild_cluster(one, "cluster", WILD_REPS))
    return d.select("method", rnd("p").alias("p"), rnd("t_obs", 4).alias("t_obs"), "reps")


_CDF = "(" + " + ".join(f"CASE WHEN u > {c!r}::DOUBLE THEN 1 ELSE 0 END" for c in RP.POISSON.tolist()) + ")"
IID = f""", iw AS (SELECT rep, y, p, (CAST(('0x' || substr(md5('iid:' || CAST((rep - 1) // 4 AS VARCHAR) || ':' || key || ':' || CAST(date AS VARCHAR)), 1 + 8 * ((rep - 1) % 4), 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
 FROM pt, range(1, {IID_REPS + 1}) r(rep)), iv AS (SELECT rep, y, p, {_CDF}::DOUBLE AS w FROM iw), ir AS (SELECT 1 - sum(w * (y - p) ** 2) / (sum(w * y * y) - sum(w * y) ** 2 / sum(w)) AS r2 FROM iv GROUP BY rep)
 SELECT r4(avg(r2)) AS mean, r4(quantile_cont(r2, 0.025)) AS lo, r4(quantile_cont(r2, 0.975)) AS hi FROM ir"""


@query("in_iid_boot", PRD + IID)
def in_iid_boot(t):
    """Percentile interval of R2 from Poisson weights per row."""
    e = F.col("y") - F.col("p")
    d = predicted(t).select("key", "date", "y", (e * e).alias("ee"), (F.col("y") * F.col("y")).alias("yy"), F.lit(1.0).alias("one"))
    g = RP.weighted_sums(d, ["key", "date"], ["ee", "one", "y", "yy"], IID_REPS, "iid")
    r = g.select((1 - F.col("ee") / (F.col("yy") - F.col("y") * F.col("y") / F.col("one"))).alias("r2"))
    return r.agg(rnd(F.avg("r2"), 4).alias("mean"), rnd(F.percentile("r2", 0.025), 4).alias("lo"), rnd(F.percentile("r2", 0.975), 4).alias("hi"))


EB = f""", eg AS (SELECT method, episode, sum(v) AS s, count(*)::DOUBLE AS c FROM gp JOIN ep USING (date) GROUP BY 1, 2),
 ei AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY episode) - 1 AS i, count(*) OVER (PARTITION BY method) AS E FROM eg),
 ed AS (SELECT method, rep, {hash_sql('episode', 'rep', 'j')} % E AS i FROM (SELECT method, max(E) AS E FROM ei GROUP BY 1) m, range(1, {EPISODE_REPS + 1}) r(rep), range(1, (SELECT max(E) + 1 FROM ei)) q(j) WHERE j <= E),
 em AS (SELECT method, rep, sum(s) / sum(c) AS m FROM ed JOIN ei USING (method, i) GROUP BY 1, 2), eo AS (SELECT method, sum(s) / sum(c) AS gap, count(*) AS episodes FROM eg GROUP BY 1)"""


@query("in_episode_boot", bq("SELECT method, r6(max(gap)) AS gap, r6(quantile_cont(m, 0.025)) AS ci_lo, r6(quantile_cont(m, 0.975)) AS ci_hi, r6(least(2 * least(avg(CAST(m <= 0 AS DOUBLE)), avg(CAST(m >= 0 AS DOUBLE))), 1)) AS p, CAST(max(episodes) AS BIGINT) AS episodes FROM em JOIN eo USING (method) GROUP BY 1", EP_SQL + GAP + EB))
def in_episode_boot(t):
    d = per_method(clustered(t).filter("episode is not null"), lambda one: IN.episode_bootstrap(one, EPISODE_REPS))
    return six(d, "gap", "ci_lo", "ci_hi", "p", keep=("method", "episodes"))


RW = draws_sql("rw", reps=RW_REPS).split(", drw AS")[0] + f""", rwp AS (SELECT rep, b * 20 + k AS date, st0 + k AS pos FROM dr0, range(0, 20) kk(k) WHERE b * 20 + k < T),
 rj AS (SELECT rep, method, rwp.date AS date, v, stress FROM rwp JOIN ps0 USING (pos) JOIN gp ON gp.date = ps0.date), rr AS (SELECT rep, method, avg(CASE WHEN NOT stress THEN v END) AS b0, avg(CASE WHEN stress THEN v END) - avg(CASE WHEN NOT stress THEN v END) AS b1, count(*)::DOUBLE AS n, count_if(stress)::DOUBLE AS n1 FROM rj GROUP BY 1, 2),
 rv AS (SELECT rj.*, CAST(stress AS INTEGER)::DOUBLE AS x, v - b0 - b1 * CAST(stress AS INTEGER) AS u FROM rj JOIN rr USING (rep, method)), {hac_beta_sql('rv', 'rr', 'rep, method', name='rb')},
 rt AS (SELECT rb.method AS method, rep, abs((rb.b1 - hb.b1) / rb.se) AS tb FROM rb JOIN hb ON rb.method = hb.method), ro AS (SELECT method, abs(b1 / se) AS t, row_number() OVER (ORDER BY abs(b1 / se) DESC, method) AS rk FROM hb),
 rm AS (SELECT method, rep, rk, t, max(tb) OVER (PARTITION BY rep ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mx FROM rt JOIN ro USING (method)), rq AS (SELECT method, rk, max(t) AS t, avg(CAST(mx >= t AS DOUBLE)) AS p FROM rm GROUP BY 1, 2)"""


@query("in_romano_wolf", bq("SELECT method, r4(t) AS t, r6(max(p) OVER (ORDER BY rk)) AS p_adj FROM rq", REG + ", " + hac_beta_sql() + RW))
def in_romano_wolf(t):
    """Every replicate keeps its own date order, so the HAC error is recomputed
    on the bootstrap series itself."""
    d = gaps(t).select("method", "date", "v", "stress")
    obs = written(IN.hac_beta(d, ["method"]).select("method", F.col("b1").alias("b1_obs"), ratio("b1", "se").alias("t")))
    slopes = RP.block_hac_slopes(d.withColumn("flag", F.col("stress").cast("double")), ["method"], "v", "flag", RW_REPS, 20, "rw")
    boot = slopes.join(obs, "method").select("rep", "method", ratio(F.col("b1") - F.col("b1_obs"), "se").alias("tb"))
    out = IN.stepdown(obs.select("method", "t"), boot, "method")
    return out.select("method", rnd(F.abs("t"), 4).alias("t"), rnd("p_adj").alias("p_adj"))


@query("in_mcs")
def in_mcs(t):
    d = IN.confidence_set(daily(t), "isc", 0.1, MCS_REPS, 20)
    return d.select("method", rnd("mean_loss").alias("mean_loss"), rnd("mcs_p").alias("mcs_p"), "in_mcs")


@query("in_noninf", bq("SELECT hm.method AS method, r6(mean) AS diff, r6(mean - 1.96 * se) AS ci_lo, r6(mean + 1.96 * se) AS ci_hi, r6(0.02 * m) AS margin, mean + 1.96 * se < 0.02 * m AS noninferior FROM hm, (SELECT avg(isc) AS m FROM dl WHERE method = 'aci')",
                       ", iv2 AS (SELECT a.method AS method, a.date AS date, a.isc - r.isc AS v FROM dl a JOIN dl r ON a.date = r.date AND r.method = 'aci' AND a.method <> 'aci'), " + hac_sql("iv2", "method")))
def in_noninf(t):
    g = gaps(t).withColumn("v", F.col("isc") - F.col("ref_isc"))
    margin = g.select("date", "ref_isc").distinct().agg(F.avg("ref_isc") * 0.02).scalar()
    h = IN.hac_mean(g, ["method"]).withColumn("margin", margin)
    m, se = F.col("mean"), F.col("se")
    return h.select("method", rnd(m).alias("diff"), rnd(m - 1.96 * se).alias("ci_lo"), rnd(m + 1.96 * se).alias("ci_hi"), rnd("margin").alias("margin"), (m + 1.96 * se < F.col("margin")).alias("noninferior"))


@query("in_rho_neff", bq("SELECT r6(greatest(vm - vw / nb, 0) / (greatest(vm - vw / nb, 0) + vw)) AS rho, r6(nb) AS nbar, r6(nb / (1 + (nb - 1) * (greatest(vm - vw / nb, 0) / (greatest(vm - vw / nb, 0) + vw)))) AS n_eff FROM ra",
                         ", rp AS (SELECT date, avg(1 - cov_hi) AS m, var_samp(1 - cov_hi) AS v, count(*) AS n FROM bx WHERE method = 'aci' GROUP BY 1 HAVING count(*) > 1), ra AS (SELECT var_samp(m) AS vm, avg(v) AS vw, avg(n) AS nb FROM rp)"))
def in_rho_neff(t):
    d = bounds(t).filter("method = 'aci'").withColumn("miss", 1 - EV.b2d("covered_hi"))
    return six(IN.rho_neff(d, "miss"), "rho", "nbar", "n_eff")


# --- exceedances of a trailing quantile --------------------------------------------------
EXC = f"{BASE}, ex0 AS (SELECT key, date, x, quantile_cont(x, 0.95) {rows(120, 1)} AS q, count(*) {rows(120, 1)} AS c FROM pa), ex AS (SELECT key, date, x > q AS e, lag(x > q) OVER (PARTITION BY key ORDER BY date) AS pe FROM ex0 WHERE c >= 60), ec AS (SELECT key, count(*)::DOUBLE AS n, count_if(e)::DOUBLE AS x, count_if(NOT pe AND NOT e)::DOUBLE AS n00, count_if(NOT pe AND e)::DOUBLE AS n01, count_if(pe AND NOT e)::DOUBLE AS n10, count_if(pe AND e)::DOUBLE AS n11 FROM ex GROUP BY 1)"
XL = lambda k, p: f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END)"
KUP = f"(-2 * (x * ln(0.05) + (n - x) * ln(0.95) - {XL('x', 'x / n')} - {XL('(n - x)', '(1 - x / n)')}))"
IND_CTE = ", ei0 AS (SELECT *, n01 / greatest(n00 + n01, 1) AS p01, n11 / greatest(n10 + n11, 1) AS p11, (n01 + n11) / (n00 + n01 + n10 + n11) AS pp FROM ec)"
IND = f"(CASE WHEN n01 + n11 = 0 OR n00 + n10 = 0 THEN 0 ELSE -2 * ({XL('(n01 + n11)', 'pp')} + {XL('(n00 + n10)', '(1 - pp)')} - {XL('n01', 'p01')} - {XL('n00', '(1 - p01)')} - {XL('n11', 'p11')} - (CASE WHEN p11 = 1 THEN 0 ELSE {XL('n10', '(1 - p11)')} END)) END)"


def exceed(t):
    d = SL.with_order_statistics(t.panel_a(), SL.quantile("x", "q", 0.95, 120, 60, 1)).filter(F.col("q").isNotNull())
    return d.select("key", "date", (F.col("x") > F.col("q")).alias("e"), (F.col("n") >= 5).alias("busy"))


@query("in_kupiec", f"{EXC} SELECT key, CAST(n AS BIGINT) AS n, r6(x / n) AS rate, r4({KUP}) AS stat FROM ec")
def in_kupiec(t):
    c = IN.exceedance_counts(exceed(t), ["key"])
    return c.select("key", "n", rnd(F.col("x") / F.col("n")).alias("rate"), rnd(IN.kupiec(F.col("n"), F.col("x"), 0.05), 4).alias("stat"))


def ind_of(c):
    return IN.independence(*[F.col(f"n{s}") for s in ("00", "01", "10", "11")])


@query("in_christoffersen", f"{EXC}{IND_CTE} SELECT key, r4({IND}) AS stat FROM ei0")
def in_christoffersen(t):
    c = IN.exceedance_counts(exceed(t), ["key"])
    return c.select("key", rnd(ind_of(c), 4).alias("stat"))


@query("in_cc", f"{EXC}{IND_CTE} SELECT key, r4({KUP} + {IND}) AS stat, r6(exp(-({KUP} + {IND}) / 2)) AS p FROM ei0")
def in_cc(t):
    c = IN.exceedance_counts(exceed(t), ["key"])
    s = IN.kupiec(F.col("n"), F.col("x"), 0.05) + ind_of(c)
    return c.select("key", rnd(s, 4).alias("stat"), rnd(F.exp(-s / 2)).alias("p"))


@query("in_dq")
def in_dq(t):
    d = IN.dq(exceed(t), ["key"], 0.05, ["busy"])
    return d.select("key", rnd("dq", 4).alias("dq"), rnd("dq_p").alias("p"))


@query("in_backtest_panel", f"{EXC}{IND_CTE} SELECT key, CAST(n AS BIGINT) AS n, r6(x / n) AS rate, r4({KUP}) AS kupiec, r4({IND}) AS independence, r4({KUP} + {IND}) AS cc, r6(exp(-({KUP} + {IND}) / 2)) AS cc_p FROM ei0")
def in_backtest_panel(t):
    """The dynamic quantile columns are shown by in_dq."""
    d = IN.backtests(exceed(t), ["key"], 0.05, "busy")
    return d.select("key", "n", rnd("rate").alias("rate"), *[rnd(c, 4).alias(c) for c in ("kupiec", "independence", "cc")], rnd("cc_p").alias("cc_p"))

"""Pooled calibrators and the reports built on them."""

from pyspark.sql import functions as F

from ..functions.columns import interval_score, rnd
from ..operators import frames as fr
from ..operators import pooled as PO
from ..operators import regimes as R
from ..operators import scaling as sc
from ..operators import sliding as SL
from ..operators import steps as S
from ..operators import windows as W
from .calibration import ACI, GB, MAD, SCORE_SQL, WARM, preds, recursion
from .panels import STATE_SQL, state_b
from .registry import query

CUTS = [0.5, 0.8]
DAYS = 40
STD_SQL = f"{SCORE_SQL}, {MAD('z', 'sc')}, {STATE_SQL}"
PI = {i: f"(CASE WHEN level_pctl IS NULL THEN 1::DOUBLE / 3 ELSE {GB[i].replace('R_', '')} END)" for i in range(3)}


def std_rows(t):
    return PO.scores(preds(t), "m", window=60, least=20).filter(F.col("s_std").isNotNull())


def member(t):
    return R.fixed_bins(state_b(t), "level_pctl", CUTS).select("date", "pi")


def by_date(states, issue, arms=None, a="0.05", sides=("hi", "lo"), src="z", score="s_std", more="", pi=True, days=DAYS, corr=""):
    """SQL of a recursion over dates. In updates ZS is the list of the side's
    scores, MISSES their count above the issued threshold, N the day's size."""
    import re

    def side(e, sd, row):
        e = e.replace("MISSES", "(len(list_filter(ZS, lambda v: v > (ISSUE)))::DOUBLE)").replace("ISSUE", issue)
        for st in states:
            e = re.sub(rf"\b{st}\b", f"f.{st}_{sd}", e)
        e = re.sub(r"\bZS\b", f"{row}.zs_{sd}", e)
        e = re.sub(r"\bQ0\b", f"q0.{sd}", e)
        e = re.sub(r"\bN\b", f"{row}.n", e)
        return re.sub(r"\bPI(\d)\b", lambda m: f"{row}.p{m.group(1)}", e)
    first = ", ".join(f"CAST({side(s0, sd, 'o')} AS DOUBLE) AS {st}_{sd}" for st, (s0, _) in states.items() for sd in sides)
    nxt = ", ".join(f"CASE WHEN f.rn > {days + 1} THEN {side(up, sd, 'f')} ELSE f.{st}_{sd} END" for st, (_, up) in states.items() for sd in sides)
    final = ", ".join(f"{side(issue, sd, 'f')} AS q_{sd}" for sd in sides)
    pis = "".join(f", {PI[i]} AS p{i}" for i in range(3)) if pi else ""
    quant = ", ".join(f"quantile_cont({'v' if sd == 'hi' else '-v'}, 1 - {a}) AS {sd}" for sd in sides)
    return (f"WITH RECURSIVE {STD_SQL}{more}, dd AS (SELECT date, list({score}) AS zs_hi, list(-{score}) AS zs_lo, count(*)::DOUBLE AS n FROM {src} WHERE {score} IS NOT NULL GROUP BY 1), "
            f"o AS (SELECT dd.*, row_number() OVER (ORDER BY dd.date) AS rn{pis} FROM dd LEFT JOIN st ON dd.date = st.date), "
            f"q0 AS (SELECT {quant} FROM (SELECT unnest(zs_hi) AS v FROM o WHERE rn <= {days + 1})), "
            f"f AS (SELECT o.*, {first} FROM o, q0 WHERE rn = 1 UNION ALL SELECT o.*, {nxt} FROM f JOIN o ON o.rn = f.rn + 1), "
            f"th AS (SELECT date, rn <= {days + 1} AS warmup, {final} FROM f) ")


def fixed_states(etas, norm="1", a="0.05"):
    return {f"k{i}": ("Q0", f"k{i} + {e}::DOUBLE * PI{i} * (MISSES - {a}::DOUBLE * N) / {norm}") for i, e in enumerate(etas)}


ISSUE3 = "k0 * PI0 + k1 * PI1 + k2 * PI2"
ETAS = (0.004, 0.01, 0.02)
IVD = "SELECT key, z.date AS date, r4(q_lo) AS q_lo, r4(q_hi) AS q_hi, s_std <= q_hi AND -s_std <= q_lo AS covered, warmup, r4((q_lo + q_hi) * sigma) AS width FROM z JOIN th ON z.date = th.date WHERE s_std IS NOT NULL"


def shown(d):
    return d.select("key", "date", rnd("q_lo", 4).alias("q_lo"), rnd("q_hi", 4).alias("q_hi"), "covered", "warmup", rnd("width", 4).alias("width"))


@query("cf_panel_fixed", by_date(fixed_states(ETAS), ISSUE3) + IVD)
def cf_panel_fixed(t):
    d, _ = PO.run_pooled(std_rows(t), member(t), 3, {"fixed": PO.FixedWalk(0.1, ETAS)}, 0.1, DAYS)
    return shown(d)


RATES = (0.001, 0.008, 0.032)


def adaptive_states(k=3, rates=RATES, a="0.05", tau="0.95", corr="0.002"):
    st = {}
    e = len(rates)
    for i in range(k):
        cost = {j: f"(l{i}{j} - 5::DOUBLE * PI{i} * list_sum(list_transform(ZS, lambda v: CASE WHEN v > b{i}{j} THEN {tau}::DOUBLE * (v - b{i}{j}) ELSE (1 - {tau}::DOUBLE) * (b{i}{j} - v) END)) / N)" for j in range(e)}
        top = "greatest(" + ", ".join(cost.values()) + ")"
        tot = "(" + " + ".join(f"exp({c} - {top})" for c in cost.values()) + ")"
        for j, r in enumerate(rates):
            st[f"b{i}{j}"] = ("Q0", f"b{i}{j} + {r}::DOUBLE * PI{i} * (len(list_filter(ZS, lambda v: v > b{i}{j}))::DOUBLE - {a}::DOUBLE * N)")
            st[f"l{i}{j}"] = ("0::DOUBLE", f"ln((1 - 0.01::DOUBLE * PI{i}) * exp({cost[j]} - {top}) / {tot} + 0.01::DOUBLE * PI{i} / {e})")
        st[f"c{i}"] = ("0::DOUBLE", f"c{i} + {corr}::DOUBLE * PI{i} * (MISSES - {a}::DOUBLE * N)")
    return st


def adaptive_issue(k=3, e=len(RATES)):
    parts = []
    for i in range(k):
        top = "greatest(" + ", ".join(f"l{i}{j}" for j in range(e)) + ")"
        tot = "(" + " + ".join(f"exp(l{i}{j} - {top})" for j in range(e)) + ")"
        mix = " + ".join(f"exp(l{i}{j} - {top}) * b{i}{j}" for j in range(e))
        parts.append(f"PI{i} * (({mix}) / {tot} + c{i})")
    return " + ".join(parts)


@query("cf_panel_adaptive", by_date(adaptive_states(), adaptive_issue()) + IVD)
def cf_panel_adaptive(t):
    d, _ = PO.run_pooled(std_rows(t), member(t), 3, {"adaptive": PO.AdaptiveWalk(0.1, RATES)}, 0.1, DAYS)
    return shown(d)


XS = f"""WITH RECURSIVE {STD_SQL}, d0 AS (SELECT date, list(s_std) AS v, list(-s_std) AS w, row_number() OVER (ORDER BY date) AS rn FROM z WHERE s_std IS NOT NULL GROUP BY 1),
 o AS (SELECT date, rn, v, w, list_sort(flatten(list(v) OVER p)) AS ch, list_sort(flatten(list(w) OVER p)) AS cl FROM d0 WINDOW p AS (ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
 f AS (SELECT o.*, 0.05::DOUBLE AS ah, 0.05::DOUBLE AS al FROM o WHERE rn = 1
 UNION ALL SELECT o.*, CASE WHEN f.rn > {DAYS + 1} THEN least(greatest(f.ah + 0.005::DOUBLE * (0.05::DOUBLE - len(list_filter(f.v, lambda u: u > f.ch[CAST(least(len(f.ch), ceil((len(f.ch) + 1) * (1 - f.ah) - 1e-12)) AS INTEGER)]))::DOUBLE / len(f.v)), 1e-4::DOUBLE), 0.499::DOUBLE) ELSE f.ah END,
 CASE WHEN f.rn > {DAYS + 1} THEN least(greatest(f.al + 0.005::DOUBLE * (0.05::DOUBLE - len(list_filter(f.w, lambda u: u > f.cl[CAST(least(len(f.cl), ceil((len(f.cl) + 1) * (1 - f.al) - 1e-12)) AS INTEGER)]))::DOUBLE / len(f.w)), 1e-4::DOUBLE), 0.499::DOUBLE) ELSE f.al END
 FROM f JOIN o ON o.rn = f.rn + 1),
 th AS (SELECT date, rn <= {DAYS + 1} AS warmup, ch[CAST(least(len(ch), ceil((len(ch) + 1) * (1 - ah) - 1e-12)) AS INTEGER)] AS q_hi, cl[CAST(least(len(cl), ceil((len(cl) + 1) * (1 - al) - 1e-12)) AS INTEGER)] AS q_lo FROM f WHERE rn > 1) """


@query("cf_panel_xs", XS + IVD)
def cf_panel_xs(t):
    d, _ = PO.run_xs(std_rows(t), 0.1, DAYS)
    return shown(d.filter(F.col("q_hi") < F.lit(float("inf"))))


@query("cf_knn", f"""WITH {SCORE_SQL}, {MAD('z', 'sc')},
 ds AS (SELECT date, list(s_std) AS v, row_number() OVER (ORDER BY date) - 1 AS pos FROM z WHERE s_std IS NOT NULL GROUP BY 1),
 mm AS (SELECT ds.date AS date, pos, v, avg(x) AS a, sum(n) AS b FROM ds JOIN pb ON pb.date = ds.date GROUP BY 1, 2, 3),
 zs AS (SELECT date, pos, v, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b FROM mm),
 nn AS (SELECT t.date AS date, s.v AS v, row_number() OVER (PARTITION BY t.date ORDER BY round(sqrt((t.a - s.a) * (t.a - s.a) + (t.b - s.b) * (t.b - s.b)), 9), s.date) AS rk FROM zs t JOIN zs s ON s.pos < t.pos WHERE t.pos > {DAYS}),
 pool AS (SELECT date, unnest(v) AS v FROM nn WHERE rk <= 250), th AS (SELECT date, quantile_cont(v, 0.95) AS q_hi, quantile_cont(-v, 0.95) AS q_lo FROM pool GROUP BY 1)
 SELECT key, z.date AS date, r4(q_lo) AS q_lo, r4(q_hi) AS q_hi, coalesce(s_std <= q_hi AND -s_std <= q_lo, false) AS covered, q_hi IS NULL AS warmup, r4((q_lo + q_hi) * sigma) AS width FROM z LEFT JOIN th ON z.date = th.date WHERE s_std IS NOT NULL""")
def cf_knn(t):
    m = t.table_b().groupBy("date").agg(F.avg("x").alias("a"), F.sum("n").cast("double").alias("b"))
    return shown(PO.run_knn(std_rows(t), m, ["a", "b"], 0.1, 250, DAYS))


CQR_SQL = """, cq AS (SELECT sc.key AS key, sc.date AS date, target, sc.m - 0.3 * abs(sc.m - 10.0) AS blo, sc.m + 0.2 * abs(sc.m - 10.0) AS bhi FROM sc),
 cz AS (SELECT *, (bhi - blo) / 2 AS half, greatest(blo - target, target - bhi) / ((bhi - blo) / 2) AS s_std FROM cq WHERE (bhi - blo) / 2 > 1e-8)"""


@query("cf_cqr_repair", by_date(fixed_states(ETAS, a="0.2"), ISSUE3, a="0.2", sides=("hi",), src="cz", more=CQR_SQL) +
       "SELECT key, cz.date AS date, r4(q_hi) AS q_hi, r4((blo + bhi) / 2 - (1 + q_hi) * half) AS lo, r4((blo + bhi) / 2 + (1 + q_hi) * half) AS hi, s_std <= q_hi AS covered, warmup FROM cz JOIN th ON cz.date = th.date")
def cf_cqr_repair(t):
    span = F.abs(F.col("m") - 10.0)
    d = sc.cqr_score(preds(t), "target", F.col("m") - 0.3 * span, F.col("m") + 0.2 * span)
    d = d.withColumn("s_std", F.col("s_cqr")).withColumn("sigma_hat", F.lit(1.0))
    out, _ = PO.run_pooled(d, member(t), 3, {"cqr": PO.FixedWalk(0.2, ETAS, one_sided=True)}, 0.2, DAYS, one_sided=True)
    mid, half = (F.col("band_lo") + F.col("band_hi")) / 2, (1 + F.col("q_hi")) * F.col("halfwidth")
    return out.select("key", "date", rnd("q_hi", 4).alias("q_hi"), rnd(mid - half, 4).alias("lo"), rnd(mid + half, 4).alias("hi"), "covered", "warmup")


VAR_SQL = f""", vz AS (SELECT key, date, -(target - m) / exp(m / 20.0) AS s FROM sc), vr AS (SELECT *, s AS s_std, row_number() OVER (PARTITION BY key ORDER BY date) AS rn FROM vz),
 fh AS (SELECT key, date, s, rn, CASE WHEN count(s) OVER w >= 50 THEN quantile_cont(s, 0.9) OVER w END AS q FROM vr WINDOW w AS (PARTITION BY key ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))"""


def var_rows(t):
    z = -(F.col("target") - F.col("m")) / F.exp(F.col("m") / 20.0)
    return preds(t).withColumn("s", z).withColumn("s_std", z).withColumn("sigma_hat", F.lit(1.0))


def var_heads(t):
    """Long table (method, key, date, s, q) of all one-sided thresholds."""
    d = var_rows(t)
    keep = ["key", "date", "s"]
    fhs = SL.with_order_statistics(d.select(*keep), SL.quantile("s", "q", 0.9, 100, 50, 1)).select(F.lit("fhs").alias("method"), *keep, "q")
    aci = S.fold(d.select(*keep), {"aci": S.aci(0.1)}, 0.1, WARM, one_sided=True).filter(~F.col("warmup"))
    walks = {"pooled": PO.FixedWalk(0.1, ETAS, one_sided=True), "adaptive": PO.AdaptiveWalk(0.1, RATES, one_sided=True)}
    pool, _ = PO.run_pooled(d.select(*keep, "s_std", "sigma_hat"), member(t), 3, walks, 0.1, DAYS, one_sided=True)
    pool = pool.filter(~F.col("warmup")).select(F.col("arm").alias("method"), *keep, F.col("q_hi").alias("q"))
    normal = d.select(F.lit("normal").alias("method"), *keep, F.lit(1.2815515655446004).alias("q"))
    return (fhs.filter(F.col("q").isNotNull()).unionByName(aci.select(F.lit("aci").alias("method"), *keep, F.col("q_hi").alias("q")))
            .unionByName(pool).unionByName(normal))


@query("cf_var_head", by_date(fixed_states(ETAS, a="0.1"), ISSUE3, a="0.1", sides=("hi",), src="vr", more=VAR_SQL) +
       "SELECT 'fhs' AS method, key, date, r4(q) AS q, s > q AS breach FROM fh WHERE q IS NOT NULL UNION ALL SELECT 'normal', key, date, r4(1.2815515655446004), s > 1.2815515655446004 FROM vr "
       "UNION ALL SELECT 'pooled', key, vr.date, r4(q_hi), s > q_hi FROM vr JOIN th ON vr.date = th.date WHERE NOT warmup")
def cf_var_head(t):
    d = var_heads(t).filter(F.col("method").isin("fhs", "normal", "pooled"))
    return d.select("method", "key", "date", rnd("q", 4).alias("q"), (F.col("s") > F.col("q")).alias("breach"))


def aci_iv(t):
    d = S.fold(preds(t), {"aci": S.aci(0.05)}, 0.1, WARM)
    return d.withColumn("lo", F.col("m") - F.col("q_lo")).withColumn("hi", F.col("m") + F.col("q_hi")).withColumn("width", F.col("q_lo") + F.col("q_hi"))


ONSET_MORE = f""", {STATE_SQL}, rs AS (SELECT date, coalesce(level_pctl >= 0.8, false) AS f FROM st), ri AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (ORDER BY date) AS isl FROM rs),
 rl AS (SELECT date, CASE WHEN f THEN sum(CAST(f AS INTEGER)) OVER (PARTITION BY isl ORDER BY date) ELSE 0 END AS run FROM ri), rp AS (SELECT date, lag(run) OVER (ORDER BY date) AS prev FROM rl),
 ow AS (SELECT iv.key AS key, iv.date AS date, mult, target, m - q_lo * CASE WHEN prev BETWEEN 1 AND 3 THEN mult ELSE 1 END AS lo, m + q_hi * CASE WHEN prev BETWEEN 1 AND 3 THEN mult ELSE 1 END AS hi
 FROM iv LEFT JOIN rp ON iv.date = rp.date, (VALUES (1.0::DOUBLE), (1.25::DOUBLE), (1.5::DOUBLE), (2.0::DOUBLE)) mm(mult) WHERE NOT warmup)"""
MULTS = [1.0, 1.25, 1.5, 2.0]


def onset(t):
    d = state_b(t).withColumn("f", F.coalesce(F.col("level_pctl") >= 0.8, F.lit(False))).withColumn("_one", F.lit(0))
    run = W.run_length(d, "f", "run", ["_one"])
    prev = run.select("date", F.lag("run").over(fr.calendar()).alias("prev"))
    iv = fr.rows_of(fr.attach(aci_iv(t).filter(~F.col("warmup")), prev, ["date"]), MULTS, "mult")
    k = F.when(F.col("prev").between(1, 3), F.col("mult")).otherwise(1.0)
    return iv.withColumn("lo", F.col("m") - F.col("q_lo") * k).withColumn("hi", F.col("m") + F.col("q_hi") * k)


@query("cf_onset_widen", recursion(ACI, "q", more=ONSET_MORE) + "SELECT key, date, mult, r6(lo) AS lo, r6(hi) AS hi, target >= lo AND target <= hi AS covered FROM ow")
def cf_onset_widen(t):
    y = F.col("target")
    return onset(t).select("key", "date", "mult", rnd("lo").alias("lo"), rnd("hi").alias("hi"), ((y >= F.col("lo")) & (y <= F.col("hi"))).alias("covered"))


@query("ev_pareto", recursion(ACI, "q", more=ONSET_MORE) + "SELECT mult, r6(avg(CAST(target >= lo AND target <= hi AS DOUBLE))) AS coverage, r6(avg(hi - lo + 20 * greatest(lo - target, 0) + 20 * greatest(target - hi, 0))) AS score, r6(avg(hi - lo)) AS width FROM ow GROUP BY 1")
def ev_pareto(t):
    y = F.col("target")
    d = onset(t)
    return d.groupBy("mult").agg(rnd(F.avg(((y >= F.col("lo")) & (y <= F.col("hi"))).cast("double"))).alias("coverage"),
                                 rnd(F.avg(interval_score(y, "lo", "hi", 0.1))).alias("score"), rnd(F.avg(F.col("hi") - F.col("lo"))).alias("width"))


@query("cf_validity_diag", by_date(fixed_states(ETAS), ISSUE3) + """SELECT r4(min(q_lo)) AS min_lo, r4(min(q_hi)) AS min_hi, CAST(count_if(q_lo < 0) AS BIGINT) AS neg_lo, CAST(count_if(q_hi < 0) AS BIGINT) AS neg_hi,
 CAST(count_if(q_lo + q_hi < 0) AS BIGINT) AS crossed, CAST(count(*) AS BIGINT) AS n FROM z JOIN th ON z.date = th.date WHERE s_std IS NOT NULL AND NOT warmup""")
def cf_validity_diag(t):
    d, _ = PO.run_pooled(std_rows(t), member(t), 3, {"fixed": PO.FixedWalk(0.1, ETAS)}, 0.1, DAYS)
    return d.filter(~F.col("warmup")).agg(
        rnd(F.min("q_lo"), 4).alias("min_lo"), rnd(F.min("q_hi"), 4).alias("min_hi"), F.count_if(F.col("q_lo") < 0).alias("neg_lo"),
        F.count_if(F.col("q_hi") < 0).alias("neg_hi"), F.count_if(F.col("q_lo") + F.col("q_hi") < 0).alias("crossed"), F.count(F.lit(1)).alias("n"))


def rate_expr(i, e=len(RATES)):
    top = "greatest(" + ", ".join(f"l{i}{j}_hi" for j in range(e)) + ")"
    tot = "(" + " + ".join(f"exp(l{i}{j}_hi - {top})" for j in range(e)) + ")"
    return "(" + " + ".join(f"exp(l{i}{j}_hi - {top}) * {r}::DOUBLE" for j, r in enumerate(RATES)) + f") / {tot}"


@query("cf_eff_rate", by_date(adaptive_states(), adaptive_issue()) + f", rt AS (SELECT p2, rn, {rate_expr(0)} AS e0, {rate_expr(2)} AS e2 FROM f) SELECT r6(avg(e0)) AS calm_rate, r6(avg(e2)) AS stress_rate, r6(avg(CASE WHEN p2 = 1 THEN e2 END)) AS stress_on_stress, r6(avg(CASE WHEN rn > 200 THEN e2 END)) AS late_rate FROM rt")
def cf_eff_rate(t):
    """Effective rates per regime from the diagnostics table (date, rates)."""
    m = member(t)
    _, path = PO.run_pooled(std_rows(t), m, 3, {"adaptive": PO.AdaptiveWalk(0.1, RATES)}, 0.1, DAYS)
    d = path.join(m, "date", "left").withColumn("rn", F.row_number().over(fr.calendar()))
    e0, e2 = F.col("rates")[0], F.col("rates")[2]
    return d.agg(rnd(F.avg(e0)).alias("calm_rate"), rnd(F.avg(e2)).alias("stress_rate"),
                 rnd(F.avg(F.when(F.col("pi")[2] == 1, e2))).alias("stress_on_stress"), rnd(F.avg(F.when(F.col("rn") > 200, e2))).alias("late_rate"))


ARM_ETAS = {"slow": (0.002, 0.002, 0.002), "avg": (0.3, 0.3, 0.3), "fast": (0.02, 0.02, 0.02)}


ARM_OUT = "r6(avg(CAST(s_std <= q_hi AND -s_std <= q_lo AS DOUBLE))) AS coverage, r4(avg((q_lo + q_hi) * sigma)) AS width, CAST(count(*) AS BIGINT) AS n FROM z JOIN th ON z.date = th.date WHERE s_std IS NOT NULL AND NOT warmup"
ARM_SQL = {a: by_date(fixed_states(e, "N" if a == "avg" else "1"), ISSUE3) for a, e in ARM_ETAS.items()}
ARM_SQL["bank"] = by_date(adaptive_states(), adaptive_issue())


@query("cf_arm_grid", " UNION ALL ".join(f"SELECT * FROM ({q} SELECT '{a}' AS arm, {ARM_OUT})" for a, q in ARM_SQL.items()))
def cf_arm_grid(t):
    """All arms walk the same digest in one job."""
    walks = {a: PO.FixedWalk(0.1, e, average=(a == "avg")) for a, e in ARM_ETAS.items()}
    walks["bank"] = PO.AdaptiveWalk(0.1, RATES)
    d, _ = PO.run_pooled(std_rows(t), member(t), 3, walks, 0.1, DAYS)
    return d.filter(~F.col("warmup")).groupBy("arm").agg(
        rnd(F.avg(F.col("covered").cast("double"))).alias("coverage"), rnd(F.avg("width"), 4).alias("width"), F.count(F.lit(1)).alias("n"))


@query("cf_bound", f"""WITH {STD_SQL}, r AS (SELECT z.date AS date, s_std, {PI[0]} AS p0, {PI[1]} AS p1, {PI[2]} AS p2 FROM z LEFT JOIN st ON z.date = st.date WHERE s_std IS NOT NULL),
 b AS (SELECT max(abs(s_std)) AS b, count(*) / count(DISTINCT date) AS nbar, sum(p0) AS n0, sum(p1) AS n1, sum(p2) AS n2 FROM r)
 SELECT regime, r4(nk) AS n_regime, r4((2 * b + 0.01 * nbar) / (0.01 * nk)) AS fixed_bound, r4((2 * b + (0.032 + 0.002) * nbar) / (0.002 * nk)) AS adaptive_bound FROM (SELECT 0 AS regime, b, nbar, n0 AS nk FROM b UNION ALL SELECT 1, b, nbar, n1 FROM b UNION ALL SELECT 2, b, nbar, n2 FROM b)""")
def cf_bound(t):
    d = fr.attach(std_rows(t), member(t), ["date"]).withColumn("pi", F.coalesce("pi", F.array(*[F.lit(1 / 3)] * 3)))
    per = d.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("s_std")).alias("b"), *[F.sum(F.col("pi")[i]).alias(f"n{i}") for i in range(3)])
    a = per.agg(F.max("b").alias("b"), (F.sum("n") / F.count(F.lit(1))).alias("nbar"), F.array(*[F.sum(f"n{i}") for i in range(3)]).alias("nk"))
    a = a.select("b", "nbar", F.posexplode("nk").alias("regime", "nk"))
    bound = lambda eta, top: rnd((2 * F.col("b") + top * F.col("nbar")) / (eta * F.col("nk")), 4)
    return a.select("regime", rnd("nk", 4).alias("n_regime"), bound(0.01, 0.01).alias("fixed_bound"), bound(0.002, 0.034).alias("adaptive_bound"))

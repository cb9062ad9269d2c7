"""Regime estimators."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import regimes as R
from ..operators import windows as W
from .panels import STATE_SQL, state_b
from .registry import PANEL_B, query
from .windows import RET, returns

CUTS = [0.5, 0.8, 0.95]
ST = f"WITH {PANEL_B}, {STATE_SQL}"
BIN = "CASE WHEN level_pctl >= 0.95 THEN 3 WHEN level_pctl >= 0.8 THEN 2 WHEN level_pctl >= 0.5 THEN 1 WHEN level_pctl IS NOT NULL THEN 0 END"


def hot_sql(b, k):
    return ", ".join(f"r6(CASE WHEN {b} IS NULL THEN 1.0 / {k} WHEN {b} = {i} THEN 1 ELSE 0 END) AS p{i}" for i in range(k))


def spread(d, k, *extra):
    return d.select(*extra, "date", *[rnd(F.col("pi")[i]).alias(f"p{i}") for i in range(k)])


@query("rg_fixed_bins", f"{ST}, b AS (SELECT date, {BIN} AS b FROM st) SELECT date, {hot_sql('b', 4)} FROM b")
def rg_fixed_bins(t):
    return spread(R.fixed_bins(state_b(t), "level_pctl", CUTS), 4)


@query("rg_transition", f"""{ST}, b AS (SELECT date, {BIN} AS b, coalesce(level_pctl >= 0.95, false) AS s FROM st), i AS (SELECT *, sum(CASE WHEN s THEN 0 ELSE 1 END) OVER (ORDER BY date) AS isl FROM b),
 r AS (SELECT date, CASE WHEN s AND sum(CAST(s AS INTEGER)) OVER (PARTITION BY isl ORDER BY date) > 2 THEN 4 ELSE b END AS b FROM i) SELECT date, {hot_sql('b', 5)} FROM r""")
def rg_transition(t):
    return spread(R.transition(state_b(t), "level_pctl", CUTS, fresh=2), 5)


@query("rg_acute", f"{ST}, b AS (SELECT date, CASE WHEN level_pctl IS NULL THEN NULL WHEN dispersion > 0.55 THEN 4 ELSE {BIN} END AS b, CASE WHEN level_pctl IS NULL THEN NULL WHEN dispersion > 0.55 THEN 3 ELSE {BIN} END AS c FROM st) SELECT date, {hot_sql('b', 5)}, coalesce(c, -1) AS base_bin FROM b")
def rg_acute(t):
    m = state_b(t).withColumn("ratio", F.col("dispersion") / 0.55)
    d = R.acute(m, "level_pctl", CUTS, "ratio")
    base = R.acute(m, "level_pctl", CUTS, "ratio", baseline=True, out="pb")
    pos = F.when(F.col("level_pctl").isNotNull(), F.array_position("pb", 1.0) - 1).otherwise(-1).cast("int")
    return spread(d, 5).join(base.select("date", pos.alias("base_bin")), "date")


@query("rg_quantile_bins", f"""{ST}, q AS (SELECT date, level, quantile_cont(level, [1/3.0, 2/3.0]) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS e, count(*) OVER (ORDER BY date ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM st),
 b AS (SELECT date, CASE WHEN n < 30 THEN NULL WHEN level >= e[2] THEN 2 WHEN level >= e[1] THEN 1 ELSE 0 END AS b FROM q) SELECT date, {hot_sql('b', 3)} FROM b""")
def rg_quantile_bins(t):
    return spread(R.quantile_bins(state_b(t), "level", 3, 60), 3)


@query("rg_overlap", f"{ST}, b AS (SELECT date, {BIN} AS b FROM st) SELECT date, 1.0::DOUBLE AS p0, " + ", ".join(f"r6(CASE WHEN b = {i} THEN 1 ELSE 0 END) AS p{i + 1}" for i in range(4)) + " FROM b")
def rg_overlap(t):
    return spread(state_b(t).withColumn("pi", R.overlapping("level_pctl", CUTS)), 5)


MEAN, SD, TRANS = [-0.6, 0.0, 0.7], [0.5, 0.4, 0.6], [[0.9, 0.08, 0.02], [0.05, 0.9, 0.05], [0.02, 0.18, 0.8]]


def hmm_sql():
    lik = [f"greatest(exp(-0.5 * (((r - ({m}::DOUBLE)) / {s}::DOUBLE) ** 2 + ln(2 * pi() * {s}::DOUBLE * {s}::DOUBLE))), 1e-300::DOUBLE)" for m, s in zip(MEAN, SD)]
    step = [f"({' + '.join(f'f.p{i} * {TRANS[i][j]}::DOUBLE' for i in range(3))}) * o.l{j}" for j in range(3)]
    tot = " + ".join(step)
    first = [f"({' + '.join(f'{TRANS[i][j]}::DOUBLE / 3' for i in range(3))}) * l{j}" for j in range(3)]
    ft = " + ".join(first)
    return ("WITH RECURSIVE " + RET[5:] + f", o AS (SELECT key, date, {', '.join(f'{l} AS l{i}' for i, l in enumerate(lik))}, row_number() OVER (PARTITION BY key ORDER BY date) AS rn FROM r WHERE r IS NOT NULL), "
            f"f AS (SELECT key, date, rn, {', '.join(f'({e}) / ({ft}) AS p{i}' for i, e in enumerate(first))} FROM o WHERE rn = 1 "
            f"UNION ALL SELECT o.key, o.date, o.rn, {', '.join(f'({e}) / ({tot})' for e in step)} FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1) "
            "SELECT key, date, r6(p0) AS p0, r6(p1) AS p1, r6(p2) AS p2 FROM f")


@query("rg_hmm_filter", hmm_sql())
def rg_hmm_filter(t):
    d = R.hmm_filter(returns(t).dropna(subset=["r"]), "r", MEAN, SD, TRANS)
    return spread(d, 3, "key")


def hmm_input(t):
    return t.table_b().withColumn("vol", W.std("x", 8, 4)).select("key", "date", "x", "vol")


@query("rg_hmm_online")
def rg_hmm_online(t):
    d = R.hmm_online(hmm_input(t), ["x", "vol"], 2, 63, 120)
    return d.select("key", "date", rnd(F.col("pi")[0], 4).alias("p0"), rnd(F.col("pi")[1], 4).alias("p1"))


@query("rg_hmm_smoothed")
def rg_hmm_smoothed(t):
    d = R.hmm_smoothed(hmm_input(t), ["x", "vol"], 2)
    return d.select("key", "date", rnd(F.col("pi")[0], 4).alias("p0"), rnd(F.col("pi")[1], 4).alias("p1"))


@query("rg_hindsight_label", f"""{ST}, f AS (SELECT date, level, disp_pctl > 0.5 AS lab FROM st WHERE disp_pctl IS NOT NULL), s AS (SELECT avg(CASE WHEN lab THEN 1.0 ELSE 0 END) AS share FROM f),
 o AS (SELECT list_sort(list(level)) AS v, (count(*) - 1) * (1 - (SELECT share FROM s)) AS pos FROM f),
 q AS (SELECT v[CAST(floor(pos) AS INTEGER) + 1] + (v[CAST(ceil(pos) AS INTEGER) + 1] - v[CAST(floor(pos) AS INTEGER) + 1]) * (pos - floor(pos)) AS q FROM o) SELECT date, lab AS hindsight, level > q AS matched FROM f, q""")
def rg_hindsight_label(t):
    """A label and the tail of the level that holds the same share of days."""
    f = state_b(t).filter("disp_pctl is not null").select("date", "level", (F.col("disp_pctl") > 0.5).alias("lab"))
    share = f.agg(F.avg(F.col("lab").cast("double"))).scalar()
    ordered = f.agg(F.array_sort(F.collect_list("level")).alias("v"))
    d = f.withColumn("_v", ordered.scalar()).withColumn("_pos", (F.size("_v") - 1) * (1 - share))
    lo, hi = F.floor("_pos").cast("int"), F.ceil("_pos").cast("int")
    q = F.get("_v", lo) + (F.get("_v", hi) - F.get("_v", lo)) * (F.col("_pos") - lo)
    return d.select("date", F.col("lab").alias("hindsight"), (F.col("level") > q).alias("matched"))


@query("rg_mad_diag", f"{ST}, b AS (SELECT date, {BIN} AS b, level_pctl >= 0.95 AS s, CASE WHEN disp_pctl >= 0.95 THEN 3 WHEN disp_pctl >= 0.8 THEN 2 WHEN disp_pctl >= 0.5 THEN 1 WHEN disp_pctl IS NOT NULL THEN 0 END AS c FROM st), g AS (SELECT s, (" + " + ".join(
    f"abs(CASE WHEN b IS NULL THEN 0.25 WHEN b = {i} THEN 1 ELSE 0 END - CASE WHEN c IS NULL THEN 0.25 WHEN c = {i} THEN 1 ELSE 0 END)" for i in range(4)) + ") / 4 AS gap FROM b) SELECT r6(avg(gap)) AS all_days, r6(avg(CASE WHEN s THEN gap END)) AS flagged_days FROM g")
def rg_mad_diag(t):
    m = state_b(t)
    flag = m.select("date", F.coalesce(F.col("level_pctl") >= 0.95, F.lit(False)).alias("flag"))
    d = R.membership_distance(R.fixed_bins(m, "level_pctl", CUTS), R.fixed_bins(m, "disp_pctl", CUTS), 4, flag)
    return d.select(rnd("all_days").alias("all_days"), rnd("flagged_days").alias("flagged_days"))

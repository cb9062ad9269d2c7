"""Per-entity online calibrators, with recursive SQL as the check."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import frames as fr
from ..operators import regimes as R
from ..operators import steps as S
from ..operators import windows as W
from ..operators.evaluate import coverage_by_state
from ..operators.pooled import scores
from . import forecasts as FQ
from .panels import STATE_SQL, state_b
from .registry import PANEL_A, PANEL_B, query
from .windows import OVER, rows

WARM = 50
# Forecast: trailing mean; target: the next observation of the key.
SCORE_SQL = f"""{PANEL_B}, sc0 AS (SELECT key, date, lead(x) {OVER} AS target, avg(x) {rows(4, 0)} AS m FROM pb),
 sc AS (SELECT key, date, target, m, target - m AS s FROM sc0 WHERE target IS NOT NULL)"""


def preds(t):
    d = t.table_b().select("key", "date", F.lead("x").over(fr.by_key()).alias("target"), W.mean("x", 5).alias("m"))
    return d.filter(F.col("target").isNotNull()).withColumn("s", F.col("target") - F.col("m"))


def recursion(states: dict[str, tuple[str, str]], issue: str, ctx: str = "", src: str = "sc", with_: str = SCORE_SQL, a: str = "0.05",
              warm: int = WARM, sides=("hi", "lo"), least: int | None = None, more: str = "") -> str:
    """SQL of a per-key recursion. ``states`` maps a state to (start, update), in
    which z is the side's score, q its issued threshold, miss the side's miss as
    0/1, q0 the warm-up quantile and T the length of the key; names end in the side."""
    least = warm + 50 if least is None else least

    def side(e, sd, row):
        import re
        e = re.sub(r"\bISSUE\b", f"({issue})", e)
        e = re.sub(r"\bMISS\b", f"(CASE WHEN Z > ({issue}) THEN 1::DOUBLE ELSE 0::DOUBLE END)", e)
        for st in states:
            e = re.sub(rf"\b{st}\b", f"f.{st}_{sd}", e)
        e = re.sub(r"\bZ\b", f"{row}.s" if sd == "hi" else f"(-{row}.s)", e)
        e = re.sub(r"\bQ0\b", f"q0.{sd}", e)
        e = re.sub(r"\bT\b", "q0.len", e)
        e = re.sub(r"\bC_(\w+)\b", lambda m: f"{row}.{m.group(1)}_{sd}", e)
        return re.sub(r"\bR_(\w+)\b", lambda m: f"{row}.{m.group(1)}", e)
    first = ", ".join(f"CAST({side(s0, sd, 'o')} AS {'DOUBLE[]' if '[' in s0 or 'list' in s0 else 'DOUBLE'}) AS {st}_{sd}" for st, (s0, _) in states.items() for sd in sides)
    nxt = ", ".join(f"CASE WHEN f.rn > {warm} THEN {side(up, sd, 'f')} ELSE f.{st}_{sd} END" for st, (_, up) in states.items() for sd in sides)
    final = ", ".join(f"{side(issue, sd, 'f')} AS q_{sd}" for sd in sides)
    quant = ", ".join(f"quantile_cont({'s' if sd == 'hi' else '-s'}, 1 - {a}) FILTER (WHERE rn <= {warm}) AS {sd}" for sd in sides)
    return (f"WITH RECURSIVE {with_}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS rn{ctx} FROM {src}), "
            f"q0 AS (SELECT key, count(*) AS len, {quant} FROM o GROUP BY key HAVING count(*) > {least}), "
            f"f AS (SELECT o.*, {first} FROM o JOIN q0 USING (key) WHERE rn = 1 UNION ALL SELECT o.*, {nxt} FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1), "
            f"iv AS (SELECT f.*, {final}, rn <= {warm} AS warmup FROM f){more} ")


IV = "SELECT key, date, r6(q_lo) AS q_lo, r6(q_hi) AS q_hi, s <= q_hi AND -s <= q_lo AS covered, warmup FROM iv"


def result(d):
    return d.select("key", "date", rnd("q_lo").alias("q_lo"), rnd("q_hi").alias("q_hi"), "covered", "warmup")


def run(t, rule, d=None):
    return result(S.fold(d if d is not None else preds(t), {"one": rule}, 0.1, WARM))


MAD = lambda c, src, k=60, m=20: f"""{c}1 AS (SELECT *, CASE WHEN count(s) {rows(k - 1, 0)} >= {m} THEN quantile_cont(s, 0.5) {rows(k - 1, 0)} END AS med FROM {src}),
 {c}2 AS (SELECT *, abs(s - med) AS dev FROM {c}1), {c}3 AS (SELECT *, CASE WHEN count(dev) {rows(k - 1, 0)} >= {m} THEN quantile_cont(dev, 0.5) {rows(k - 1, 0)} END AS mad FROM {c}2),
 {c} AS (SELECT *, nullif(lag(1.4826 * mad) {OVER}, 0) AS sigma, s / nullif(lag(1.4826 * mad) {OVER}, 0) AS s_std FROM {c}3)"""  # noqa: E731


@query("cf_scores", f"WITH {SCORE_SQL}, {MAD('z', 'sc')} SELECT key, date, r6(s) AS residual, r6(sigma) AS sigma_hat, r4(s_std) AS s_std FROM z")
def cf_scores(t):
    d = scores(preds(t), "m", window=60, least=20)
    return d.select("key", "date", rnd("residual").alias("residual"), rnd("sigma_hat").alias("sigma_hat"), rnd("s_std", 4).alias("s_std"))


ACI = {"q": ("Q0", "q + 0.05::DOUBLE * (MISS - 0.05::DOUBLE)")}


@query("cf_aci", recursion(ACI, "q") + IV)
def cf_aci(t):
    return run(t, S.aci(0.05))


@query("cf_aci_onesided", recursion({"q": ("Q0", "q + 0.05::DOUBLE * (MISS - 0.1::DOUBLE)")}, "q", a="0.1", sides=("hi",)) + "SELECT key, date, r6(q_hi) AS q_hi, s <= q_hi AS covered, warmup FROM iv")
def cf_aci_onesided(t):
    d = S.fold(preds(t), {"one": S.aci(0.1)}, 0.1, WARM, one_sided=True)
    return d.select("key", "date", rnd("q_hi").alias("q_hi"), "covered", "warmup")


@query("cf_sfogd", recursion({"q": ("Q0", "q + 1::DOUBLE / sqrt(g + (MISS - 0.05::DOUBLE) * (MISS - 0.05::DOUBLE)) * (MISS - 0.05::DOUBLE)"),
                              "g": ("1e-8::DOUBLE", "g + (MISS - 0.05::DOUBLE) * (MISS - 0.05::DOUBLE)")}, "q") + IV)
def cf_sfogd(t):
    return run(t, S.sfogd(0.05))


RATES = list(S.EXPERT_RATES)
_E = range(1, 7)
_top = "greatest(" + ", ".join(f"l{i}" for i in _E) + ")"
_sum = "(" + " + ".join(f"exp(l{i} - {_top})" for i in _E) + ")"
_mixq = "(" + " + ".join(f"exp(l{i} - {_top}) * b{i}" for i in _E) + f") / {_sum}"
_loss = {i: f"(l{i} - 5::DOUBLE * (CASE WHEN Z > b{i} THEN 0.95::DOUBLE * (Z - b{i}) ELSE 0.05::DOUBLE * (b{i} - Z) END))" for i in _E}
_ntop = "greatest(" + ", ".join(_loss.values()) + ")"
_nsum = "(" + " + ".join(f"exp({v} - {_ntop})" for v in _loss.values()) + ")"
DT = {**{f"b{i}": ("Q0", f"b{i} + {RATES[i - 1]}::DOUBLE * ((CASE WHEN Z > b{i} THEN 1::DOUBLE ELSE 0::DOUBLE END) - 0.05::DOUBLE)") for i in _E},
      **{f"l{i}": ("0::DOUBLE", f"ln(0.99::DOUBLE * exp({_loss[i]} - {_ntop}) / {_nsum} + 0.01::DOUBLE / 6)") for i in _E}}


@query("cf_dtaci", recursion(DT, _mixq) + IV)
def cf_dtaci(t):
    return run(t, S.dtaci(0.05))


TCP_CTX = "".join(f", coalesce(CASE WHEN len(list(s) {rows(60, 1)}) >= 5 THEN (list_sort(list({'s' if sd == 'hi' else '-s'}) {rows(60, 1)}))[CAST(least(len(list(s) {rows(60, 1)}), ceil((len(list(s) {rows(60, 1)}) + 1) * 0.95 - 1e-12)) AS INTEGER)] END, 1e12::DOUBLE) AS base_{sd}" for sd in ("hi", "lo"))


TCP = {"c": ("0::DOUBLE", "c + 0.01::DOUBLE / power(1 + 0.01::DOUBLE * (f.rn - 51), 0.75::DOUBLE) * (MISS - 0.05::DOUBLE)")}


@query("cf_tcp", recursion(TCP, "C_base + c", TCP_CTX)
       + "SELECT key, date, r6(CASE WHEN q_lo < 1e11 THEN q_lo END) AS q_lo, r6(CASE WHEN q_hi < 1e11 THEN q_hi END) AS q_hi, s <= q_hi AND -s <= q_lo AS covered, warmup FROM iv")
def cf_tcp(t):
    d = S.fold(S.tcp_context(preds(t), 0.05), {"one": S.tcp(0.05)}, 0.1, WARM)
    inf = F.lit(float("inf"))
    d = d.withColumn("q_lo", F.when(F.col("q_lo") < inf, F.col("q_lo"))).withColumn("q_hi", F.when(F.col("q_hi") < inf, F.col("q_hi")))
    return result(d)


PID_CTX = "".join(f", CASE WHEN count(s) {rows(80, 1)} >= 50 THEN quantile_cont({'s' if sd == 'hi' else '-s'}, 0.95) {rows(80, 1)} END AS cast_{sd}" for sd in ("hi", "lo"))
_off = "tan(least(greatest(e * (ln(len::DOUBLE) / (20::DOUBLE * len)), -1.5::DOUBLE), 1.5::DOUBLE))"


def pid_sql():
    off = _off.replace("len", "w")
    d = "(CASE WHEN C_cast IS NULL THEN 0::DOUBLE ELSE C_cast - b END)"
    miss = f"((CASE WHEN Z - {d} > k + {off} THEN 1::DOUBLE ELSE 0::DOUBLE END) - 0.05::DOUBLE)"
    return recursion({"k": ("Q0", f"k + 0.05::DOUBLE * {miss}"), "e": ("0::DOUBLE", f"e + {miss}"), "b": ("Q0", "b"), "w": ("T", "w")}, f"k + {off} + {d}", PID_CTX)


@query("cf_pid", pid_sql() + IV)
def cf_pid(t):
    return run(t, S.pid(0.05), S.pid_context(preds(t), 0.05, 80, 50))


GROUPS_SQL = f"{SCORE_SQL}, {STATE_SQL}, sg AS (SELECT sc.*, level_pctl FROM sc LEFT JOIN st ON sc.date = st.date)"
BINS = [("0", "0.5"), ("0.5", "0.8"), ("0.8", "9")]
GB = {i: f"(CASE WHEN R_level_pctl >= {a}::DOUBLE AND R_level_pctl < {b}::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END)" for i, (a, b) in enumerate(BINS)}


def with_state(t, *cols):
    return fr.attach(preds(t), state_b(t).select("date", *cols), ["date"])


RKR = {"m": ("Q0", "m + 0.05::DOUBLE * (MISS - 0.05::DOUBLE)"), **{f"g{i}": ("0::DOUBLE", f"g{i} + 0.05::DOUBLE * {GB[i]} * (MISS - 0.05::DOUBLE)") for i in range(3)}}
RKR_ISSUE = "m + " + " + ".join(f"g{i} * {GB[i]}" for i in range(3))


@query("cf_rkr", recursion(RKR, RKR_ISSUE, src="sg", with_=GROUPS_SQL) + IV)
def cf_rkr(t):
    d = with_state(t, "level_pctl").withColumn("groups", R.overlapping("level_pctl", [0.5, 0.8]))
    return run(t, S.rkr(0.05), d)


PI = {i: f"(CASE WHEN R_level_pctl IS NULL THEN 1::DOUBLE / 3 ELSE {GB[i]} * 0.8::DOUBLE + 0.2::DOUBLE / 3 END)" for i in range(3)}
MON_RATES = (0.02, 0.05, 0.1)
MON = {f"q{i}": ("Q0", f"q{i} + {e}::DOUBLE * {PI[i]} * (MISS - 0.05::DOUBLE)") for i, e in enumerate(MON_RATES)}
MON_ISSUE = " + ".join(f"q{i} * {PI[i]}" for i in range(3))


def soft(d):
    """Soft memberships: the hard bins mixed with the uniform vector."""
    d = R.fixed_bins(d, "level_pctl", [0.5, 0.8])
    return d.withColumn("pi", F.when(F.col("level_pctl").isNull(), F.col("pi")).otherwise(F.transform("pi", lambda v: v * 0.8 + 0.2 / 3)))


@query("cf_mondrian", recursion(MON, MON_ISSUE, src="sg", with_=GROUPS_SQL) + IV)
def cf_mondrian(t):
    return run(t, S.mondrian(0.05, MON_RATES), soft(with_state(t, "level_pctl")))


@query("cf_pogo")
def cf_pogo(t):
    d = scores(preds(t), "m", window=60, least=20).filter(F.col("s_std").isNotNull())
    d = R.fixed_bins(fr.attach(d, state_b(t).select("date", "level_pctl"), ["date"]), "level_pctl", [0.5, 0.8])
    return result(S.fold(d, {"pogo": S.pogo(0.05)}, 0.1, WARM, score="s_std"))


@query("entry_coverage", recursion(ACI, "q", src="sh", with_=f"{PANEL_A}, {FQ.HAR_SQL}, {FQ.HAR_FIT}, sh AS (SELECT key, date, round(y - har, 7) AS s, rv_m FROM fcst WHERE y IS NOT NULL AND har IS NOT NULL)", warm=100,
                                 more=", bn AS (SELECT *, CASE WHEN rv_m > 0 AND rv_m <= 11.5 THEN 'calm' WHEN rv_m > 11.5 THEN 'stress' END AS state_bin FROM iv WHERE NOT warmup)")
       + "SELECT state_bin, r6(avg(CAST(s <= q_hi AND -s <= q_lo AS DOUBLE))) AS coverage, r6(avg(CAST(s <= q_hi AS DOUBLE))) AS upper_coverage, r6(avg(CAST(-s <= q_lo AS DOUBLE))) AS lower_coverage, CAST(count(*) AS BIGINT) AS n, r4(avg(q_lo + q_hi)) AS mean_width FROM bn GROUP BY 1")
def entry_coverage(t):
    """The whole chain: panel, HAR forecasts, per-key intervals, coverage by state."""
    d = FQ.har_forecasts(t).withColumn("s", F.round(F.col("y") - F.col("har"), 7)).filter(F.col("s").isNotNull())
    iv = S.fold(d.select("key", "date", "s", "rv_m"), {"aci": S.aci(0.05)}, 0.1, 100).withColumn("width", F.col("q_lo") + F.col("q_hi"))
    c = coverage_by_state(iv, "rv_m", [0.0, 11.5, 1e9], ["calm", "stress"])
    return c.select("state_bin", *[rnd(x).alias(x) for x in ("coverage", "upper_coverage", "lower_coverage")], "n", rnd("mean_width", 4).alias("mean_width"))

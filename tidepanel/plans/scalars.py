"""Scalar, date, string and array functions."""

from pyspark.sql import functions as F

from ..functions import special as sp
from ..functions import text as tx
from ..functions.columns import (bin_left, cosine, cut, interval_score, pinball, qlike, ratio, rnd, softmax)
from ..operators import frames as fr
from ..operators import scaling as sc
from .registry import PANEL_A, query
from .rows import LAGGED_SQL, lagged

L = f"{LAGGED_SQL} SELECT key, date, "


def out(t, **cols):
    return lagged(t).select("key", "date", *[rnd(c).alias(k) for k, c in cols.items()])


def xl():
    return F.col("x"), F.col("lx")


@query("sc_qlike", L + "r6(exp(x - lx) - (x - lx) - 1) AS loss FROM l")
def sc_qlike(t):
    return out(t, loss=qlike("x", "lx"))


@query("sc_pinball", L + "r6(CASE WHEN x - lx >= 0 THEN 0.9 * (x - lx) ELSE (0.9 - 1) * (x - lx) END) AS loss FROM l WHERE lx IS NOT NULL")
def sc_pinball(t):
    x, lx = xl()
    return lagged(t).dropna(subset=["lx"]).select("key", "date", rnd(pinball(x - lx, 0.9)).alias("loss"))


@query("sc_interval_score", L + "r6(1.0 + 20.0 * greatest(lx - 0.5 - x, 0) + 20.0 * greatest(x - lx - 0.5, 0)) AS score FROM l WHERE lx IS NOT NULL")
def sc_interval_score(t):
    x, lx = xl()
    return lagged(t).dropna(subset=["lx"]).select("key", "date", rnd(interval_score(x, lx - 0.5, lx + 0.5, 0.1)).alias("score"))


@query("sc_covered", L + "x >= lx - 0.5 AND x <= lx + 0.5 AS covered, x <= lx + 0.5 AS covered_hi, x >= lx - 0.5 AS covered_lo FROM l")
def sc_covered(t):
    x, lx = xl()
    hi, lo = x <= lx + 0.5, x >= lx - 0.5
    return lagged(t).select("key", "date", (lo & hi).alias("covered"), hi.alias("covered_hi"), lo.alias("covered_lo"))


@query("sc_raw_bounds", L + "r6(lx - 1.5 * qty) AS lo, r6(lx + 1.25 * qty) AS hi FROM l")
def sc_raw_bounds(t):
    from ..operators.steps import raw_bounds
    d = raw_bounds(lagged(t).withColumn("q_lo", F.lit(1.5)).withColumn("q_hi", F.lit(1.25)), "lx", "qty")
    return d.select("key", "date", rnd("lo").alias("lo"), rnd("hi").alias("hi"))


@query("sc_std_loss", L + "r6(-(x - lx) / exp(lx / 2.0)) AS z FROM l")
def sc_std_loss(t):
    x, lx = xl()
    return out(t, z=-(x - lx) / F.exp(lx / 2.0))


@query("sc_log_var", "SELECT event_id, r6(ln(nullif(value * value, 0))) AS log_var, r6(sqrt(exp(ln(nullif(value, 0))))) AS vol, r6(sqrt(value) * sqrt(252)) AS annual FROM events")
def sc_log_var(t):
    v = F.col("value")
    return t.events.select("event_id", rnd(F.log(v * v)).alias("log_var"), rnd(F.sqrt(F.exp(F.log(v)))).alias("vol"),
                           rnd(F.sqrt(v) * 252 ** 0.5).alias("annual"))


@query("sc_spread", L + "r6(x - lx) AS spread, r6(x / nullif(lx, 0)) AS rel FROM l")
def sc_spread(t):
    x, lx = xl()
    return out(t, spread=x - lx, rel=ratio("x", "lx"))


@query("sc_cqr", L + "r6(greatest((lx - 0.1 * qty) - x, x - (lx + 0.1 * qty)) / (0.1 * qty)) AS s FROM l WHERE 0.1 * qty > 1e-8 AND lx IS NOT NULL")
def sc_cqr(t):
    x, lx = xl()
    d = sc.cqr_score(lagged(t).dropna(subset=["lx"]), "x", lx - 0.1 * F.col("qty"), lx + 0.1 * F.col("qty"))
    return d.select("key", "date", rnd("s_cqr").alias("s"))


@query("sc_bin_cut", f"""WITH {PANEL_A} SELECT key, date, CASE WHEN n >= 1 AND n <= 3 THEN 'a' WHEN n > 3 AND n <= 5 THEN 'b' WHEN n > 5 AND n <= 8 THEN 'c' END AS bin FROM pa""")
def sc_bin_cut(t):
    return t.panel_a().select("key", "date", cut("n", [1, 3, 5, 8], ["a", "b", "c"]).alias("bin"))


@query("sc_searchsorted", f"WITH {PANEL_A} SELECT key, date, CASE WHEN n >= 8 THEN 3 WHEN n >= 5 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END AS bin FROM pa")
def sc_searchsorted(t):
    return t.panel_a().select("key", "date", bin_left("n", [3, 5, 8]).alias("bin"))


@query("sc_qcut", """WITH e AS (SELECT quantile_cont(value, [0, 0.25, 0.5, 0.75, 1]) AS q FROM events)
 SELECT event_id, CASE WHEN value <= q[2] THEN 0 WHEN value <= q[3] THEN 1 WHEN value <= q[4] THEN 2 ELSE 3 END AS quartile FROM events, e""")
def sc_qcut(t):
    return sc.qcut(t.events, "value", 4, "quartile").select("event_id", "quartile")


@query("sc_winsor", """WITH q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM events WHERE ts < TIMESTAMP '2024-01-15')
 SELECT event_id, r6(least(greatest(value, a), b)) AS v FROM events, q""")
def sc_winsor(t):
    e = t.events
    d = sc.winsorize(e, e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp")), "value", 0.02, 0.98)
    return d.select("event_id", rnd("value_w").alias("v"))


@query("sc_outlier_iqr", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
 SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS outlier FROM events, q""")
def sc_outlier_iqr(t):
    return sc.iqr_flag(t.events, "value").select("event_id", "outlier")


@query("sc_scale", """WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM events WHERE ts < TIMESTAMP '2024-01-15'),
 c AS (SELECT value AS v, count(*) AS c FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), f AS (SELECT v, sum(c) OVER (ORDER BY v) / sum(c) OVER () AS p FROM c)
 SELECT e.event_id AS event_id, r6((e.value - s.m) / s.sd) AS z, r6(coalesce(f.p, 0)) AS p FROM events e ASOF LEFT JOIN f ON e.value >= f.v CROSS JOIN s""")
def sc_scale(t):
    e = t.events.select("event_id", "value", "ts")
    train = e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
    z = sc.standardize(e, train, ["value"])
    p = sc.train_cdf(z, train, "value", "p")
    return p.select("event_id", rnd("value_z").alias("z"), rnd("p").alias("p"))


@query("sc_shrink", f"""{LAGGED_SQL}, m AS (SELECT avg(x) AS m FROM l), g(lam) AS (VALUES (0.0), (0.25), (0.5), (1.0))
 SELECT r6(lam) AS lam, r6(avg((x - (m + lam * (lx - m))) ** 2)) AS mse FROM l, m, g WHERE lx IS NOT NULL GROUP BY lam""")
def sc_shrink(t):
    x, lx = xl()
    d = lagged(t)
    d = fr.rows_of(fr.with_scalars(d, d.agg(F.avg("x").alias("m"))).dropna(subset=["lx"]), [0.0, 0.25, 0.5, 1.0], "lam")
    e = x - (F.col("_g.m") + F.col("lam") * (lx - F.col("_g.m")))
    return d.groupBy("lam").agg(rnd(F.avg(e * e)).alias("mse"))


@query("sc_calendar", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, CAST(month(o_orderdate) AS INTEGER) AS month,
 CAST(quarter(o_orderdate) AS INTEGER) AS quarter, isodow(o_orderdate) = 1 AS is_monday, isodow(o_orderdate) = 5 AS is_friday, quarter(o_orderdate) = 4 AS is_q4,
 last_day(CAST(o_orderdate AS DATE)) = CAST(o_orderdate AS DATE) AS month_end FROM orders""")
def sc_calendar(t):
    return sc.calendar_parts(t.orders.select(F.to_date("o_orderdate").alias("date")).distinct(), "date")


EFFECTIVE = """CASE WHEN hour(et) >= {c} THEN CAST(CASE isodow(et + INTERVAL 1 DAY) WHEN 6 THEN et + INTERVAL 3 DAY WHEN 7 THEN et + INTERVAL 2 DAY ELSE et + INTERVAL 1 DAY END AS DATE) ELSE CAST(et AS DATE) END"""
# The zone's offset as plain SQL: daylight saving from 2024-03-10 07:00 to 2024-11-03 06:00 UTC.
ET_SQL = """et AS (SELECT *, ts - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS et FROM events)"""


@query("sc_effective_date", f"WITH {ET_SQL} SELECT event_id, {EFFECTIVE.format(c=16)} AS effective_date, CAST(hour(et) AS INTEGER) AS hour_et FROM et")
def sc_effective_date(t):
    return t.events.select("event_id", tx.effective_date("ts").alias("effective_date"), F.hour(tx.eastern("ts")).alias("hour_et"))


def sql_text(s):
    return "'" + s.replace("'", "''") + "'"


def clean_sql(c):
    """The same cleaning as plain SQL, in the same order."""
    for p in tx.FOOTERS:
        c = f"regexp_replace({c}, {sql_text('(?is)' + p)}, '', 'g')"
    c = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    c = f"regexp_replace({c}, {sql_text(tx.TAG)}, '', 'g')"
    c = f"regexp_replace({c}, {sql_text(tx.LINK)}, '', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query("sc_text_clean", f"SELECT page_id, md5({clean_sql('html')}) AS digest, CAST(length({clean_sql('html')}) AS INTEGER) AS len FROM pages WHERE length({clean_sql('html')}) > 10")
def sc_text_clean(t):
    d = t.pages.select("page_id", tx.clean("html").alias("c")).filter(F.length("c") > tx.MIN_LENGTH)
    return d.select("page_id", F.md5("c").alias("digest"), F.length("c").alias("len"))


def shock_sql(c, high=tx.HIGH_SEVERITY, medium=tx.MEDIUM_SEVERITY):
    arr = lambda ws: "[" + ", ".join(sql_text(w) for w in ws) + "]"
    return f"least(3.0 * len(list_filter({arr(high)}, lambda w: contains(lower({c}), w))) + len(list_filter({arr(medium)}, lambda w: contains(lower({c}), w))), 5.0)"


# The invented prose holds none of the severity words, so the queries also score
# syllables that it does hold.
WORDS = (["thwh", "erbl", "eaux"], ["tion", "ouen", "leaux"])


@query("sc_shock_score", f"SELECT doc_id, CAST({shock_sql('text')} AS DOUBLE) AS shock, CAST({shock_sql('text', *WORDS)} AS DOUBLE) AS own FROM documents")
def sc_shock_score(t):
    return t.documents.select("doc_id", tx.shock("text").alias("shock"), tx.shock("text", *WORDS).alias("own"))


@query("sc_sentiment_map", """WITH a AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
 b AS (SELECT event_id, list_filter([CASE WHEN k % 3 = 0 THEN 1 WHEN k % 3 = 1 THEN -1 ELSE 0 END, CASE WHEN k % 5 = 0 THEN 1 WHEN k % 5 < 3 THEN 0 END], lambda v: v IS NOT NULL) AS s FROM a)
 SELECT event_id, r6(coalesce(list_sum(s) / len(s), 0)) AS sentiment FROM b""")
def sc_sentiment_map(t):
    k = F.get_json_object("props", "$.k").cast("int")
    word = lambda r, p, n: F.when(r.isin(p), "positive").when(r.isin(n), "negative")
    raw = F.to_json(F.struct(F.array(
        F.struct(word(k % 3, [0], [1]).alias("s0")), F.struct(F.when(k % 5 == 0, "positive").when(k % 5 < 3, "neutral").alias("s0"))).alias("insights")))
    parsed = F.from_json(raw, "insights array<struct<s0:string>>")["insights"]
    labels = F.transform(parsed, lambda s: s["s0"])
    first = F.coalesce(labels[0], F.lit("neutral"))
    return t.events.select("event_id", rnd(tx.sentiment(F.array(first, labels[1]))).alias("sentiment"))


@query("sc_cosine", """WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
 SELECT vec_id, r6(1 - list_cosine_similarity(a, b)) AS dist FROM p WHERE b IS NOT NULL""")
def sc_cosine(t):
    from ..operators.features import previous_vector
    d = previous_vector(t.embeddings, "label", "vec_id", "embedding", "prev").filter(F.col("prev").isNotNull())
    return d.select("vec_id", rnd(1 - cosine("embedding", "prev")).alias("dist"))


@query("sc_softmax", f"WITH {PANEL_A} SELECT key, date, r6(exp(x) / (exp(x) + exp(n / 2.0) + exp(1))) AS w0, r6(exp(1) / (exp(x) + exp(n / 2.0) + exp(1))) AS w2 FROM pa")
def sc_softmax(t):
    x, lx = xl()
    s = softmax(F.array(x, F.col("n") / 2.0, F.lit(1.0)))
    return t.panel_a().select("key", "date", rnd(s[0]).alias("w0"), rnd(s[2]).alias("w2"))


@query("sc_cdf")
def sc_cdf(t):
    s = t.panel_a().groupBy("key").agg((F.skewness("x") * F.sqrt(F.count("x") / 6.0)).alias("z"), F.count("x").alias("n"))
    z2 = F.col("z") * F.col("z")
    return s.select("key", "z", sp.p_two_sided(F.col("z")).alias("p_normal"), sp.p_chi2(z2, 1.0).alias("p_chi2"),
                    sp.p_t(F.col("z"), F.col("n") - 1).alias("p_t"), sp.p_f(z2, F.lit(1.0), F.col("n") - 1).alias("p_f"))



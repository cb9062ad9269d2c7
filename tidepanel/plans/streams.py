"""Streaming forms of the batch steps."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import qlike, rnd
from ..operators import forecast as FC
from ..operators import frames as fr
from ..operators import pooled as PO
from ..operators import regimes as R
from ..operators import steps as S
from ..operators.ranks import quantiles
from ..sources import sinks
from ..streaming import streams as ST
from .calibration import ACI, GROUPS_SQL, MON, MON_ISSUE, MON_RATES, RKR, RKR_ISSUE, TCP, TCP_CTX, WARM, recursion, soft, with_state
from .forecasts import BASE
from .panels import NEWS_SQL, EFF16
from .pooled import DAYS, ETAS, ISSUE3, by_date, fixed_states, member, std_rows
from .registry import PANEL_A, query
from .scalars import WORDS, shock_sql
from .windows import OVER


def tick_stream(t):
    return ST.read_table(t.spark, t.folder, "events").select(F.col("event_type").alias("key"), "ts", "event_id", F.col("value").alias("price"), "user_id")


@query("st_bars_tumbling", """WITH b AS (SELECT event_type AS key, time_bucket(INTERVAL 30 MINUTE, ts) AS bar, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2), d AS (SELECT key, CAST(bar AS DATE) AS date, ln(close / lag(close) OVER (PARTITION BY key, CAST(bar AS DATE) ORDER BY bar)) AS r FROM b)
 SELECT key, date, r6(coalesce(sum(r * r), 0)) AS rv, CAST(count(*) AS INTEGER) AS n_bars FROM d WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def st_bars_tumbling(t):
    d = ST.run_to_table(ST.daily_variance(tick_stream(t), "30 minutes", "10 minutes"))
    return d.select("key", "date", rnd("rv").alias("rv"), "n_bars")


@query("st_news_daily", f"WITH {NEWS_SQL.format(eff=EFF16)} SELECT key, date, r6(sum({shock_sql('text', *WORDS)})) AS shock, CAST(count(*) AS BIGINT) AS n FROM nw WHERE date + INTERVAL 1 DAY <= (SELECT max(date) FROM nw) - INTERVAL 2 DAY GROUP BY 1, 2")
def st_news_daily(t):
    """Events are the stream; their texts are looked up in a static table."""
    docs = t.documents.select(F.col("doc_id").alias("event_id"), F.col("lang").alias("key"), tx.shock("text", *WORDS).alias("shock"))
    news = tick_stream(t).drop("key").join(docs, "event_id").withColumn("effective", tx.effective_date("ts"))
    d = ST.run_to_table(ST.news_daily(news.select("key", "effective", "shock"), "2 days"))
    return d.select("key", "date", rnd("shock").alias("shock"), "n")


@query("st_dedup", "SELECT DISTINCT CAST(ts AS DATE) AS date, event_type AS key, user_id FROM events")
def st_dedup(t):
    d = tick_stream(t).withColumn("date", F.to_date("ts"))
    return ST.run_to_table(ST.dedup(d, ["date", "key", "user_id"], "ts", "1 day").select("date", "key", "user_id"))


@query("st_episodes", """WITH e AS (SELECT event_type AS key, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events WHERE value > 60), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts) AS sid FROM e)
 SELECT key, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", CAST(count(*) AS BIGINT) AS n FROM s GROUP BY key, sid HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def st_episodes(t):
    d = ST.run_to_table(ST.episodes(tick_stream(t), "30 minutes", "10 minutes", F.col("price") > 60))
    return d.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def landed(t, df, name):
    path = sinks.write_parquet(df, sinks.fresh_path(t.spark, name))
    return ST.read_landed(t.spark, path, df.schema)


LIVE = "key, date, r6(q_lo) AS q_lo, r6(q_hi) AS q_hi, s <= q_hi AND -s <= q_lo AS covered FROM iv WHERE NOT warmup"
_RULES = {
    "aci": recursion(ACI, "q", least=WARM),
    "tcp": recursion(TCP, "C_base + c", TCP_CTX, least=WARM),
    "rkr": recursion(RKR, RKR_ISSUE, src="sg", with_=GROUPS_SQL, least=WARM),
    "mondrian": recursion(MON, MON_ISSUE, src="sg", with_=GROUPS_SQL, least=WARM),
}


@query("st_entity_tracker", " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({v}SELECT {LIVE}) {k}_" for k, v in _RULES.items()))
def st_entity_tracker(t):
    """Rules without context, with a trailing statistic and with memberships of the rows."""
    d = soft(with_state(t, "level_pctl")).withColumn("groups", R.overlapping("level_pctl", [0.5, 0.8]))
    rows = landed(t, d.select("key", "date", "s", "pi", "groups"), "scores")
    arms = {"aci": (S.aci(0.05), None), "tcp": (S.tcp(0.05), ST.trackers.ORDER_STATISTIC), "rkr": (S.rkr(0.05), None), "mondrian": (S.mondrian(0.05, MON_RATES), None)}
    out = None
    for name, (rule, trailing) in arms.items():
        d = ST.run_to_table(ST.entity_tracker(rows, rule, 0.05, WARM, trailing=trailing))
        d = d.select(F.lit(name).alias("rule"), "key", "date", rnd("q_lo").alias("q_lo"), rnd("q_hi").alias("q_hi"), "covered")
        out = d if out is None else out.unionByName(d)
    return out


@query("st_panel_tracker", by_date({k: (s, u) for k, (s, u) in fixed_states(ETAS).items()}, ISSUE3) + "SELECT date, r4(q_lo) AS q_lo, r4(q_hi) AS q_hi FROM th WHERE NOT warmup AND date < (SELECT max(date) FROM th)")
def st_panel_tracker(t):
    """Started at the warm-up quantiles of the batch run; dates after the warm-up
    arrive as a stream."""
    rows = PO.written(std_rows(t).select("key", "date", "s_std", "sigma_hat"))
    cal = rows.select("date").distinct().withColumn("pos", F.row_number().over(fr.calendar()) - 1)
    warm = rows.join(cal.filter(F.col("pos") <= DAYS), "date", "left_semi")
    q = quantiles(warm, [], "s_std", [0.95, 0.05], ["hi", "lo"]).first()
    live = rows.join(cal.filter(F.col("pos") > DAYS), "date", "left_semi")
    tracker = ST.PanelTracker(t.spark, lambda: PO.FixedWalk(0.1, ETAS), member(t), 3, {"hi": q["hi"], "lo": -q["lo"]})
    d = ST.run_panel_tracker(landed(t, live, "live"), tracker)
    return d.select("date", rnd("q_lo", 4).alias("q_lo"), rnd("q_hi", 4).alias("q_hi"))


@query("st_hedge", f"""{BASE}, dl AS (SELECT date, least(avg(exp(y - rv_d) - (y - rv_d) - 1), 10) AS l1, least(avg(exp(y - rv_w) - (y - rv_w) - 1), 10) AS l2 FROM h WHERE y IS NOT NULL AND rv_w IS NOT NULL AND date + INTERVAL 1 DAY <= (SELECT max(date) FROM h WHERE y IS NOT NULL AND rv_w IS NOT NULL) - INTERVAL 1 DAY GROUP BY 1),
 dc AS (SELECT date, -2.0 * coalesce(sum(l1) OVER w, 0) AS c1, -2.0 * coalesce(sum(l2) OVER w, 0) AS c2 FROM dl WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT date, r6(1 / (1 + exp(c2 - c1))) AS w1 FROM dc""")
def st_hedge(t):
    """Daily losses come from the stream; the weights are their running softmax."""
    d = FC.design(t.table_a()).filter(F.col("y").isNotNull() & F.col("rv_w").isNotNull()).select("key", "date", "y", "rv_d", "rv_w")
    losses = {"l1": qlike("y", "rv_d"), "l2": qlike("y", "rv_w")}
    daily = ST.run_to_table(ST.expert_losses(landed(t, d, "experts"), losses, "1 day"))
    w = fr.calendar().rowsBetween(-(2 ** 31), -1)
    c = {k: -2.0 * F.coalesce(F.sum(F.least(F.col(k), F.lit(FC.LOSS_CAP))).over(w), F.lit(0.0)) for k in losses}
    return daily.select("date", c["l1"].alias("c1"), c["l2"].alias("c2")).select("date", rnd(1 / (1 + F.exp(F.col("c2") - F.col("c1")))).alias("w1"))


@query("st_run_length", f"""WITH {PANEL_A}, h AS (SELECT *, n >= 5 AS flag FROM pa), i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) {OVER} AS isl FROM h)
 SELECT key, date, CASE WHEN flag THEN CAST(sum(CAST(flag AS INTEGER)) OVER (PARTITION BY key, isl ORDER BY date) AS INTEGER) ELSE 0 END AS run FROM i""")
def st_run_length(t):
    rows = landed(t, t.panel_a().select("key", "date", (F.col("n") >= 5).alias("flag")), "flags")
    return ST.run_to_table(ST.run_length(rows))

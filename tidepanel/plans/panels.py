"""Panel construction and features."""


from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import corr, rnd
from ..operators import features as FT
from ..operators import frames as fr
from ..operators import panel as P
from ..operators.ranks import quantiles
from ..session import written
from .joins import FILINGS_SQL, filings
from .registry import PANEL_A, PANEL_B, query
from .rows import VALID_SQL, validity_spans
from .scalars import EFFECTIVE, ET_SQL, WORDS, shock_sql
from .windows import CLASSES_SQL, OVER, classes, rows

PIT_SQL = f"""WITH {CLASSES_SQL}, {VALID_SQL}, ok AS (SELECT cls.year + 1 AS year, company, cls.id AS id, cap FROM cls JOIN spans ON cls.id = spans.id JOIN customer ON c_custkey = cls.id
 WHERE a <= make_date(cls.year, 12, 31) AND b >= make_date(cls.year, 12, 1) AND c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')),
 comp AS (SELECT year, company, first(id ORDER BY cap DESC, id) AS id, round(sum(cap), 2) AS cap FROM ok GROUP BY 1, 2),
 uni AS (SELECT year, company, id, cap, CAST(row_number() OVER (PARTITION BY year ORDER BY cap DESC, company) AS INTEGER) AS rank FROM comp QUALIFY rank <= 10)"""


def pit(t):
    spans = validity_spans(t)
    seg = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).select(F.col("c_custkey").alias("id"))
    d = classes(t).join(spans, "id").join(seg, "id")
    ok = d.filter((F.col("a") <= F.make_date("year", F.lit(12), F.lit(31))) & (F.col("b") >= F.make_date("year", F.lit(12), F.lit(1))))
    return P.universe(ok.select((F.col("year") + 1).alias("year"), "company", "id", "cap"), 10)


@query("pn_universe_pit", f"{PIT_SQL} SELECT year, company, id, r2(cap) AS cap, rank FROM uni")
def pn_universe_pit(t):
    return pit(t).select("year", "company", "id", rnd("cap", 2).alias("cap"), "rank")


@query("pn_universe_summary", f"""{PIT_SQL}, n AS (SELECT u.year AS year, count_if(p.company IS NULL) AS n_new FROM uni u LEFT JOIN uni p ON p.company = u.company AND p.year = u.year - 1
 WHERE u.year > (SELECT min(year) FROM uni) GROUP BY 1)
 SELECT CAST((SELECT count(DISTINCT company) FROM uni) AS BIGINT) AS members, r6((SELECT avg(n_new) FROM n)) AS mean_turnover,
 CAST((SELECT count(DISTINCT company) FROM uni WHERE company NOT IN (SELECT company FROM uni WHERE year = (SELECT max(year) FROM uni))) AS BIGINT) AS dropped""")
def pn_universe_summary(t):
    u = written(pit(t))
    last = u.groupBy("company").agg(F.max("year").alias("last"))
    top = u.agg(F.max("year")).scalar()
    s = last.withColumn("_top", top).agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("last") < F.col("_top")).alias("dropped"))
    turn = P.turnover(u.select("year", "company")).agg(F.avg("n_new")).scalar()
    return s.select("members", rnd(turn).alias("mean_turnover"), "dropped")


@query("pn_identity_audit", """WITH a AS (SELECT p_name AS ticker, min(p_partkey) AS chosen, count(*) AS matches, count(DISTINCT p_brand) AS brands,
 string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS alternatives FROM part GROUP BY 1) SELECT ticker, chosen, CAST(matches AS BIGINT) AS matches, alternatives, brands > 1 AS flagged FROM a""")
def pn_identity_audit(t):
    """Copies of a name collapse to (name, brand) before anything is listed; the
    list holds distinct brands only."""
    d = t.part.groupBy(F.col("p_name").alias("ticker"), "p_brand").agg(F.min("p_partkey").alias("c"), F.count(F.lit(1)).alias("m"))
    return d.groupBy("ticker").agg(F.min("c").alias("chosen"), F.sum("m").alias("matches"),
                                   F.array_join(F.array_sort(F.collect_list("p_brand")), "|").alias("alternatives"),
                                   (F.count(F.lit(1)) > 1).alias("flagged"))


@query("pn_membership_filter", f"""{PIT_SQL}, {PANEL_B} SELECT key, date, r6(x) AS x FROM pb WHERE (CAST(key AS INTEGER), year(date)) IN (SELECT company, year FROM uni)""")
def pn_membership_filter(t):
    u = pit(t).select(F.col("company").cast("string").alias("key"), "year")
    return t.panel_b().withColumn("year", F.year("date")).join(u, ["key", "year"], "left_semi").select("key", "date", rnd("x").alias("x"))


BAR_SQL = """bar AS (SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS bar, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)"""


@query("pn_rv_bars", f"""WITH {BAR_SQL}, r AS (SELECT key, CAST(bar AS DATE) AS date, ln(close / lag(close) OVER (PARTITION BY key ORDER BY bar)) AS r FROM bar)
 SELECT key, date, r6(coalesce(sum(r * r), 0)) AS rv, CAST(count(r) AS BIGINT) AS n_returns, r6(sqrt(coalesce(sum(r * r), 0))) AS vol, r6(sqrt(coalesce(sum(r * r), 0)) * sqrt(252)) AS vol_annual FROM r GROUP BY 1, 2""")
def pn_rv_bars(t):
    return P.realized_from_bars(P.bars(t.ticks(), "1 hour")).select(
        "key", "date", rnd("rv").alias("rv"), "n_returns", rnd("vol").alias("vol"), rnd("vol_annual").alias("vol_annual"))


@query("pn_rv_ticks", """WITH tk AS (SELECT event_type AS key, ts, event_id, value AS price, time_bucket(INTERVAL 120 MINUTE, ts) AS w FROM events WHERE value > 0),
 med AS (SELECT key, w, median(price) AS m FROM tk GROUP BY 1, 2),
 cl AS (SELECT tk.* FROM tk JOIN med USING (key, w) WHERE abs(ln(price / m)) <= 1.5),
 days AS (SELECT DISTINCT key, CAST(ts AS DATE) AS date FROM cl),
 grid AS (SELECT key, date, o AS off, s AS slot, CAST(date AS TIMESTAMP) + INTERVAL 1 SECOND * (o + s * 3600) AS gt FROM days, (VALUES (0), (1200), (2400)) os(o), range(0, 24) rs(s) WHERE o + s * 3600 <= 82800),
 smp AS (SELECT grid.key AS key, grid.date AS date, off, slot, c.price AS price FROM grid ASOF JOIN (SELECT key, ts, last(price ORDER BY event_id) AS price FROM cl GROUP BY 1, 2) c ON grid.key = c.key AND grid.gt >= c.ts
 WHERE CAST(c.ts AS DATE) = grid.date),
 r AS (SELECT key, date, off, slot, ln(price / lag(price) OVER (PARTITION BY key, date, off ORDER BY slot)) AS r FROM smp),
 r2 AS (SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY key, date, off ORDER BY slot)) AS p FROM r),
 per AS (SELECT key, date, off, sum(r * r) AS rv, sum(p) AS bp, count(r) AS nr FROM r2 GROUP BY 1, 2, 3)
 SELECT key, date, r6(avg(coalesce(rv, 0))) AS rv, r6(avg(coalesce(bp, 0)) * pi() / 2) AS bpv, CAST(max(nr) AS BIGINT) AS n_returns FROM per GROUP BY 1, 2""")
def pn_rv_ticks(t):
    clean = P.clean_ticks(t.ticks(), "120 minutes", 1.5, session=False)
    m = P.realized_measures(clean, 3600, (0, 1200, 2400), 0, 23 * 3600)
    return m.select("key", "date", rnd("rv").alias("rv"), rnd("bpv").alias("bpv"), "n_returns")


@query("pn_macro", f"""WITH {PANEL_A}, m AS (SELECT date, max(CASE WHEN key = '0' THEN x END) AS idx, max(CASE WHEN key = '1' THEN qty END) AS fear FROM pa WHERE key IN ('0', '1') GROUP BY 1)
 SELECT key, pa.date AS date, r6(idx) AS idx, r6(fear) AS fear FROM pa LEFT JOIN m ON pa.date = m.date""")
def pn_macro(t):
    p = t.table_a()
    m = p.filter(F.col("key").isin("0", "1")).groupBy("date").agg(F.max(F.when(F.col("key") == "0", F.col("x"))).alias("idx"),
                                                                  F.max(F.when(F.col("key") == "1", F.col("qty"))).alias("fear"))
    return fr.attach(p, m, ["date"]).select("key", "date", rnd("idx").alias("idx"), rnd("fear").alias("fear"))


@query("pn_target", f"""WITH {BAR_SQL}, b AS (SELECT key, CAST(bar AS DATE) AS date, ln(close / lag(close) OVER (PARTITION BY key ORDER BY bar)) AS r FROM bar),
 d AS (SELECT key, date, coalesce(sum(r * r), 0) AS rv FROM b GROUP BY 1, 2)
 SELECT key, date, r6(ln(lead(rv) {OVER})) AS target_log_var, r6(lag(rv) {OVER}) AS prev_day_rv, r6(avg(rv) {rows(4, 0)}) AS rv_5d_mean, r6(avg(rv) {rows(19, 0)}) AS rv_20d_mean FROM d""")
def pn_target(t):
    d = P.log_variance_target(P.realized_from_bars(P.bars(t.ticks(), "1 hour")))
    return d.select("key", "date", *[rnd(c).alias(c) for c in ("target_log_var", "prev_day_rv", "rv_5d_mean", "rv_20d_mean")])


def pct(c, h):
    return f"CASE WHEN {c} IS NOT NULL AND len({h}) >= 20 THEN (len(list_filter({h}, lambda v: v < {c})) + (len(list_filter({h}, lambda v: v = {c})) + 1) / 2.0) / len({h}) END"


STATE_SQL = f"""m0 AS (SELECT date, avg(x) AS level, stddev_samp(x) AS sd FROM pb GROUP BY 1), m1 AS (SELECT date, level, lag(sd) OVER (ORDER BY date) AS dispersion FROM m0),
 m2 AS (SELECT *, list(level) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS hl, list_filter(list(dispersion) OVER (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), lambda v: v IS NOT NULL) AS hd FROM m1),
 st AS (SELECT date, level, dispersion, {pct('level', 'hl')} AS level_pctl, {pct('dispersion', 'hd')} AS disp_pctl FROM m2)"""


def state_b(t):
    return P.market_state(t.table_b(), "x", 60, 20)


@query("pn_state", f"WITH {PANEL_B}, {STATE_SQL} SELECT key, pb.date AS date, r6(level) AS level, r6(dispersion) AS dispersion, r6(level_pctl) AS level_pctl, r6(disp_pctl) AS disp_pctl FROM pb LEFT JOIN st ON pb.date = st.date")
def pn_state(t):
    d = fr.attach(t.table_b().select("key", "date"), state_b(t), ["date"])
    return d.select("key", "date", *[rnd(c).alias(c) for c in ("level", "dispersion", "level_pctl", "disp_pctl")])


@query("pn_stress_index", f"""WITH {PANEL_B}, {STATE_SQL} SELECT date, r6(CASE WHEN level_pctl IS NULL THEN disp_pctl WHEN disp_pctl IS NULL THEN level_pctl ELSE (level_pctl + disp_pctl) / 2 END) AS stress_index FROM st""")
def pn_stress_index(t):
    return P.stress_index(state_b(t), ["level_pctl", "disp_pctl", "absent"]).select("date", rnd("stress_index").alias("stress_index"))


HAR_SQL = f"""h AS (SELECT key, date, x, x AS rv_d, CASE WHEN count(x) {rows(4, 0)} = 5 THEN avg(x) {rows(4, 0)} END AS rv_w, CASE WHEN count(x) {rows(21, 0)} = 22 THEN avg(x) {rows(21, 0)} END AS rv_m, lead(x) {OVER} AS y, lead(date) {OVER} AS ydate FROM pa)"""


@query("ft_har", f"WITH {PANEL_A}, {HAR_SQL} SELECT key, date, r6(rv_d) AS rv_d, r6(rv_w) AS rv_w, r6(rv_m) AS rv_m FROM h")
def ft_har(t):
    return FT.har(t.panel_a()).select("key", "date", *[rnd(c).alias(c) for c in ("rv_d", "rv_w", "rv_m")])


@query("ft_har_x", f"""WITH {PANEL_A}, a AS (SELECT key, date, x, x - lag(x) {OVER} AS r, CASE WHEN qty > 80 THEN qty END AS s, row_number() {OVER} AS rn FROM pa),
 b AS (SELECT key, date, rn, lag(x) {OVER} AS lag_1, avg(x) {rows(5, 1)} AS mean_5, avg(x) {rows(22, 1)} AS mean_22, power(lag(r) {OVER}, 2) AS sq_ret, coalesce(last_value(s IGNORE NULLS) {rows('UNBOUNDED', 0)}, 50) AS signal FROM a)
 SELECT key, date, r6(lag_1) AS lag_1, r6(mean_5) AS mean_5, r6(mean_22) AS mean_22, r6(sq_ret) AS sq_ret, r6(signal) AS signal FROM b WHERE rn > 22""")
def ft_har_x(t):
    p = t.panel_a().withColumn("s", F.when(F.col("qty") > 80, F.col("qty")))
    return FT.har_extended(p, "x", "s", 50.0).select("key", "date", *[rnd(c).alias(c) for c in ("lag_1", "mean_5", "mean_22", "sq_ret", "signal")])


@query("ft_deseason", f"""WITH {PANEL_A}, s AS (SELECT key, isodow(date) AS dow, median(x) AS m FROM pa GROUP BY 1, 2)
 SELECT pa.key AS key, date, r6(m) AS seasonal, r6(x - m) AS excess, r6((x - m) * 0.9 + m) AS restored FROM pa JOIN s ON pa.key = s.key AND isodow(date) = dow""")
def ft_deseason(t):
    d = FT.deseasonalize(t.table_a(), "x", ["key"])
    return d.select("key", "date", rnd("seasonal").alias("seasonal"), rnd("excess").alias("excess"),
                    rnd(F.col("excess") * 0.9 + F.col("seasonal")).alias("restored"))


@query("ft_deseason_sector", f"""WITH {PANEL_B}, p AS (SELECT pb.*, CAST(n_regionkey AS VARCHAR) AS sector FROM pb JOIN nation ON CAST(n_nationkey AS VARCHAR) = key),
 s AS (SELECT sector, month(date) AS dow, median(n) AS m FROM p GROUP BY 1, 2)
 SELECT p.key AS key, date, r6(m) AS seasonal, r6(n - m) AS excess FROM p JOIN s ON p.sector = s.sector AND month(date) = dow""")
def ft_deseason_sector(t):
    """Weekly dates share one weekday, so the month stands in for it here. A
    sector's rows are counted per value first, whatever their number."""
    sec = t.nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").cast("string").alias("sector"))
    p = fr.attach(t.table_b(), sec, ["key"], "inner").withColumn("dow", F.month("date"))
    s = quantiles(p, ["sector", "dow"], "n", [0.5], ["m"])
    return fr.attach(p, s, ["sector", "dow"]).select("key", "date", rnd("m").alias("seasonal"), rnd(F.col("n") - F.col("m")).alias("excess"))


@query("ft_retail_global", f"""WITH {PANEL_A}, a AS (SELECT *, ln(x / lag(x) {OVER}) AS r FROM pa),
 b AS (SELECT key, date, CASE WHEN count(r) {rows(4, 0)} = 5 THEN stddev_samp(r) {rows(4, 0)} * sqrt(252) END AS vol5, x / lag(x, 5) {OVER} - 1 AS ret5, CASE WHEN count(qty) {rows(49, 0)} >= 10 THEN qty / avg(qty) {rows(49, 0)} END AS rv FROM a)
 SELECT date, r6(max(CASE WHEN key = '0' THEN vol5 END)) AS coin_vol5, r6(max(CASE WHEN key = '1' THEN rv END)) AS meme_rel_volume,
 r6(max(CASE WHEN key = '0' THEN ret5 END) - max(CASE WHEN key = '1' THEN ret5 END)) AS strength FROM b WHERE key IN ('0', '1') GROUP BY 1""")
def ft_retail_global(t):
    d = FT.retail_wide(FT.retail_signals(t.panel_a()), {"coin": "0", "meme": "1"})
    return d.select("date", *[rnd(c).alias(c) for c in ("coin_vol5", "meme_rel_volume", "strength")])


@query("ft_hype", f"""WITH {PANEL_A}, a AS (SELECT *, x - lag(x) {OVER} AS d1, coalesce(CASE WHEN count(qty) {rows(19, 0)} >= 5 THEN qty / avg(qty) {rows(19, 0)} END, 1) AS shock FROM pa),
 b AS (SELECT *, shock * abs(coalesce(d1 - lag(d1) {OVER}, 0)) AS hype FROM a)
 SELECT key, date, r6(hype) AS hype_signal, r6(avg(hype) {rows(2, 0)}) AS hype_roll3, r6(avg(hype) {rows(6, 0)}) AS hype_roll7,
 r6(least(greatest((hype - avg(hype) OVER (PARTITION BY key)) / greatest(stddev_samp(hype) OVER (PARTITION BY key), 0.001), -5), 5)) AS hype_zscore FROM b""")
def ft_hype(t):
    return FT.hype(t.panel_a()).select("key", "date", *[rnd(c).alias(c) for c in ("hype_signal", "hype_roll3", "hype_roll7", "hype_zscore")])


@query("ft_fundamental", f"""WITH {FILINGS_SQL}, j AS (SELECT l.key AS key, l.date AS date, r.v AS v FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.date >= r.date)
 SELECT key, date, r6(v / nullif(c_acctbal * 100 - v, 0)) AS debt_equity, r6(lag(v / nullif(c_acctbal * 100 - v, 0)) {OVER}) AS lagged FROM j JOIN customer ON c_custkey = key""")
def ft_fundamental(t):
    from ..operators.joins import asof
    left, right = filings(t)
    acc = t.customer.select(F.col("c_custkey").alias("key"), "c_acctbal")
    d = asof(left, right, "v", "v").join(acc, "key")
    d = d.withColumn("de", FT.debt_to_equity(F.col("v"), F.col("c_acctbal") * 100))
    return d.select("key", "date", rnd("de").alias("debt_equity"), rnd(F.lag("de").over(fr.by_key())).alias("lagged"))


@query("ft_momentum", f"WITH {PANEL_A} SELECT key, date, r6(avg(x) {rows(5, 1)}) AS mom_5, r6(avg(x) {rows(10, 1)}) AS mom_10, r6(coalesce(stddev_samp(x) {rows(5, 1)}, 0)) AS mom_std FROM pa")
def ft_momentum(t):
    return FT.momentum(t.panel_a(), "x").select("key", "date", *[rnd(c).alias(c) for c in ("mom_5", "mom_10", "mom_std")])


@query("ft_market_attention", f"WITH {PANEL_A} SELECT key, date, r6(avg(qty) OVER (PARTITION BY date)) AS mkt_qty, r6(avg(n) OVER (PARTITION BY date)) AS mkt_n FROM pa")
def ft_market_attention(t):
    return FT.date_means(t.table_a(), ["qty", "n"]).select("key", "date", rnd("mkt_qty").alias("mkt_qty"), rnd("mkt_n").alias("mkt_n"))


@query("ft_contagion", f"""WITH {PANEL_B}, p AS (SELECT pb.*, n_regionkey AS sector FROM pb JOIN nation ON CAST(n_nationkey AS VARCHAR) = key),
 c AS (SELECT key, date, x, sum(x) OVER (PARTITION BY date, sector) AS s, sum(x) OVER (PARTITION BY date) AS m FROM p)
 SELECT key, date, r4(s - x) AS sector_others, r4(x / (s + 1)) AS own_vs_sector, r4(x / (m + 1)) AS own_vs_market FROM c""")
def ft_contagion(t):
    sec = t.nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").alias("sector"))
    d = FT.contagion(fr.attach(t.table_b(), sec, ["key"], "inner"), "x", "sector")
    return d.select("key", "date", *[rnd(c, 4).alias(c) for c in ("sector_others", "own_vs_sector", "own_vs_market")])


def news_rows(t, words=WORDS):
    """Documents as news: the event of the same id gives the time, the label the
    polarity, the vector of the same id the embedding. Texts are scored before the
    joins and dropped."""
    ev = t.events.select(F.col("event_id").alias("doc_id"), "ts", "value")
    lb = t.labels.select("doc_id", (F.col("quality") * 2 - 1).cast("double").alias("polarity"))
    em = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    docs = t.documents.select("doc_id", F.col("lang").alias("key"), tx.shock("text", *words).alias("shock"))
    return docs.join(ev, "doc_id").join(lb, "doc_id", "left").join(em, "doc_id", "left")


def dims(t) -> int:
    """Entries of an embedding, from the data."""
    return t.embeddings.agg(F.max(F.size("embedding"))).first()[0] or 0


NEWS_SQL = f"""{ET_SQL}, nw AS (SELECT doc_id, lang AS key, et.ts AS ts, et.et AS et, text, quality * 2 - 1 AS polarity, CAST(embedding AS DOUBLE[]) AS vec, value, {{eff}} AS date
 FROM documents JOIN et ON event_id = doc_id LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id)"""
EFF16 = EFFECTIVE.format(c=16)


@query("ft_news_daily", f"""WITH {NEWS_SQL.format(eff=EFF16)} SELECT key, date, r6(sum({shock_sql('text', *WORDS)})) AS shock_index, r6(avg(polarity)) AS sentiment_avg, CAST(count(*) AS BIGINT) AS news_count,
 r6(median(hour(et))) AS median_hour, r6(avg(vec[1])) AS v0, r6(avg(vec[8])) AS v7, r6(avg(list_avg(vec))) AS vec_mean FROM nw GROUP BY 1, 2""")
def ft_news_daily(t):
    d = FT.news_daily(news_rows(t), dims(t))
    return d.select("key", "date", rnd("shock_index").alias("shock_index"), rnd("sentiment_avg").alias("sentiment_avg"), "news_count",
                    rnd("median_hour").alias("median_hour"), rnd(F.col("vec")[0]).alias("v0"), rnd(F.col("vec")[7]).alias("v7"),
                    rnd(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v) / F.size("vec")).alias("vec_mean"))


@query("ft_novelty", f"""WITH {NEWS_SQL.format(eff=EFF16)}, e AS (SELECT key, date, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM nw), a AS (SELECT key, date, i, avg(v) AS v FROM e GROUP BY 1, 2, 3),
 d AS (SELECT key, date, v FROM (SELECT DISTINCT key, date FROM nw) n LEFT JOIN (SELECT key, date, list(v ORDER BY i) AS v FROM a GROUP BY 1, 2) l USING (key, date)), p AS (SELECT key, date, v, lag(v) {OVER} AS pv FROM d)
 SELECT key, date, r6(CASE WHEN pv IS NOT NULL AND v IS NOT NULL THEN 1 - list_cosine_similarity(v, pv) END) AS novelty FROM p""")
def ft_novelty(t):
    return FT.novelty(FT.news_daily(news_rows(t), dims(t))).select("key", "date", rnd("novelty").alias("novelty"))


@query("ft_tfidf_svd")
def ft_tfidf_svd(t):
    from ..operators.textmodels import tfidf, truncated_svd
    d = truncated_svd(tfidf(t.documents.select("doc_id", "text"), "text").drop("text"), "tfidf", 5, "svd")
    return d.select("doc_id", *[rnd(F.col("svd")[i], 4).alias(f"c{i}") for i in range(5)])


@query("ft_pca_train_only")
def ft_pca_train_only(t):
    from ..operators.textmodels import pca_past
    cut = t.embeddings.agg(F.max("vec_id") * 0.7).scalar()
    e = t.embeddings.withColumn("_cut", cut)
    d = pca_past(e, "embedding", F.col("vec_id") < F.col("_cut"), 4, "pca")
    return d.select("vec_id", *[rnd(F.col("pca")[i], 5).alias(f"c{i}") for i in range(4)])


@query("ft_assemble", f"""WITH {PANEL_A}, {HAR_SQL}, m AS (SELECT key, date, avg(x) {rows(5, 1)} AS mom_5 FROM pa), b AS (SELECT key, date, qty AS busy FROM pa WHERE n >= 5)
 SELECT h.key AS key, h.date AS date, r6(rv_w) AS rv_w, r6(coalesce(mom_5, 0)) AS mom_5, r6(coalesce(busy, 20)) AS busy FROM h LEFT JOIN m USING (key, date) LEFT JOIN b USING (key, date)""")
def ft_assemble(t):
    p = t.table_a()
    base = FT.har(p).select("key", "date", "rv_w")
    mom = FT.momentum(p, "x").select("key", "date", "mom_5")
    busy = p.filter("n >= 5").select("key", "date", F.col("qty").alias("busy"))
    d = FT.assemble(base, [mom, busy, mom], {"mom_5": 0.0, "busy": 20.0})
    return d.select("key", "date", *[rnd(c).alias(c) for c in ("rv_w", "mom_5", "busy")])


@query("ft_extreme_label", f"""WITH {PANEL_A}, l AS (SELECT key, date, x - lag(x) {OVER} AS r FROM pa), q AS (SELECT quantile_cont(r, 0.8) AS q FROM l WHERE date < DATE '1999-01-01')
 SELECT key, date, CAST(coalesce(r > q, false) AS INTEGER) AS extreme FROM l, q""")
def ft_extreme_label(t):
    d = t.table_a().withColumn("r", F.col("x") - F.lag("x").over(fr.by_key()))
    q = quantiles(d.filter(F.col("date") < F.lit("1999-01-01").cast("date")), [], "r", [0.8], ["q"])
    d = fr.with_scalars(d, q)
    return d.select("key", "date", F.coalesce(F.col("r") > F.col("_g.q"), F.lit(False)).cast("int").alias("extreme"))


@query("ft_cutoff_sweep", "WITH " + ET_SQL + ", s AS (" + " UNION ALL ".join(
    f"SELECT {c} AS cutoff, lang AS key, {EFFECTIVE.format(c=c)} AS date, {shock_sql('text', *WORDS)} AS s, value FROM documents JOIN et ON event_id = doc_id" for c in (9, 12, 16)) +
    "), d AS (SELECT cutoff, key, date, sum(s) AS shock, count(*) AS n, avg(value) AS v FROM s GROUP BY 1, 2, 3) SELECT cutoff, r6(corr(n, v)) AS corr, CAST(count(*) AS BIGINT) AS days, r6(avg(n)) AS mean_n FROM d GROUP BY 1")
def ft_cutoff_sweep(t):
    news = news_rows(t).withColumn("polarity", F.col("value"))
    d = FT.cutoff_sweep(news, [9, 12, 16])
    return d.groupBy("cutoff").agg(rnd(corr("news_count", "sentiment_avg")).alias("corr"), F.count(F.lit(1)).alias("days"),
                                   rnd(F.avg("news_count")).alias("mean_n"))



"""Coverage, accuracy, association and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import corr, cut, interval_score, qlike, ratio
from .frames import attach, by_key, with_scalars
from .ranks import quantiles, value_counts, with_rank

STATE_EDGES = [0.0, 0.5, 0.8, 0.95, 1.0]
STATE_LABELS = ["calm", "normal", "elevated", "stress"]
DSE_BUCKETS = {"1": (1, 1), "2": (2, 2), "3": (3, 3), "4-5": (4, 5), "6-10": (6, 10), ">10": (11, 10 ** 9)}


def usable(df: DataFrame) -> DataFrame:
    """Rows outside the warm-up; a missing flag counts as usable."""
    if "warmup" not in df.columns:
        return df
    return df.filter(~F.coalesce("warmup", F.lit(False)))


def b2d(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def marginal_coverage(df: DataFrame, covered: str = "covered") -> DataFrame:
    return usable(df).agg(F.avg(b2d(covered)).alias("coverage"), F.count(covered).alias("n"))


def coverage_columns() -> list[Column]:
    return [F.avg(b2d("covered")).alias("coverage"), F.avg(b2d("covered_hi")).alias("upper_coverage"),
            F.avg(b2d("covered_lo")).alias("lower_coverage"), F.count(F.lit(1)).alias("n"),
            F.avg("width").alias("mean_width")]


def coverage_by_state(df: DataFrame, state: str, edges=STATE_EDGES, labels=STATE_LABELS) -> DataFrame:
    d = usable(df).withColumn("state_bin", cut(state, list(edges), list(labels)))
    return d.filter(F.col("state_bin").isNotNull()).groupBy("state_bin").agg(*coverage_columns())


def dse_bucket(run: str) -> Column:
    out = None
    for label, (a, b) in DSE_BUCKETS.items():
        c = F.col(run).between(a, b)
        out = F.when(c, label) if out is None else out.when(c, label)
    return out


def point_table(df: DataFrame, models: list[str], y: str = "target") -> DataFrame:
    """Mean QLIKE and root mean squared error of all models on the same rows."""
    rows = df.dropna(subset=[y, *models]).unpivot([y], models, "model", "p")
    e = F.col(y) - F.col("p")
    return rows.groupBy("model").agg(F.avg(qlike(y, "p")).alias("qlike"), F.sqrt(F.avg(e * e)).alias("rmse"),
                                     F.count(F.lit(1)).alias("n"))


def r2(y: str = "y", p: str = "p") -> Column:
    """1 - residual / total sum of squares, in one pass."""
    e = F.col(y) - F.col(p)
    tot = F.var_pop(y) * F.count(y)
    return F.lit(1.0) - F.try_divide(F.sum(e * e), tot)


def regression_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """RMSE, MAE, R2 per group; directional accuracy compares the signs of the
    successive differences inside each key."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    w = by_key()
    sy, sp = F.signum(F.col(y) - F.lag(y).over(w)), F.signum(F.col(p) - F.lag(p).over(w))
    d = d.withColumn("_same", (sy == sp).cast("double"))
    e = F.col(y) - F.col(p)
    return d.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2(y, p).alias("r2"),
                              (F.avg("_same") * 100).alias("direction"), F.count(F.lit(1)).alias("n"))


def correlation_scan(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson correlation of every feature with the target, in one pass."""
    wide = df.agg(*[corr(f, target).alias(f) for f in features],
                  *[F.count(F.when(F.col(f).isNotNull() & F.col(target).isNotNull(), 1)).cast("double").alias("n_" + f)
                    for f in features])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("corr"),
                               F.col("n_" + f).alias("n")) for f in features])
    d = wide.select(F.explode(pairs).alias("s")).select("s.*")
    t = F.col("corr") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("corr") * F.col("corr")))
    return d.withColumn("t", t).withColumn("significant", F.coalesce(F.abs("t") > 1.96, F.lit(False)))


def importance_table(scores: DataFrame) -> DataFrame:
    """Share of every feature in the total score (one row per feature)."""
    return scores.withColumn("pct", F.col("score") / F.sum("score").over(Window.partitionBy()) * 100) \
        .orderBy(F.desc("score"), "feature")


def auc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve by the rank-sum formula."""
    r = with_rank(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()), by, score)
    pos = F.sum(F.col(label).cast("double"))
    n = F.count(F.lit(1)).cast("double")
    rank_sum = F.sum(F.when(F.col(label) == 1, F.col("rank")))
    return r.groupBy(*by).agg(F.try_divide(rank_sum - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"),
                              pos.alias("n_pos"), n.alias("n"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Average precision: recall steps down the score times the precision."""
    all_ranks = value_counts(df, [], score).select(score, (F.col("n") - F.col("n_lt")).alias("at_or_above"))
    pos = value_counts(df.filter(F.col(label) == 1), [], score).select(
        F.col(score), F.col("n_eq").alias("tp_here"), (F.col("n") - F.col("n_lt")).alias("tp"), F.col("n").alias("n_pos"))
    d = pos.join(all_ranks, score)
    return d.agg(F.sum(F.col("tp_here") / F.col("n_pos") * F.col("tp") / F.col("at_or_above")).alias("pr_auc"))


def confusion(df: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
                            F.count_if(~y & ~p).alias("tn"))
    prec, rec = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    return c.select(*by, prec.alias("precision"), rec.alias("recall"), F.try_divide(2 * prec * rec, prec + rec).alias("f1"),
                    ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"))


def tail_metrics(df: DataFrame, y: str, p: str, level: float) -> DataFrame:
    """Flags at the level's quantile of the actual and predicted values, severe
    under-prediction inside the tail, fit inside and outside."""
    d = with_scalars(df, quantiles(df, [], y, [level], ["q"]), "_qy")
    d = with_scalars(d, quantiles(df, [], p, [level], ["q"]), "_qp")
    d = d.withColumn("_a", F.col(y) >= F.col("_qy.q")).withColumn("_b", F.col(p) >= F.col("_qp.q"))
    d = with_scalars(d, df.agg(F.stddev_samp(y).alias("sd")), "_s")
    severe = (F.col(y) - F.col(p)) > F.col("_s.sd")
    e2 = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))

    def fit(cond):
        return 1 - F.try_divide(F.sum(F.when(cond, e2)), F.var_pop(F.when(cond, F.col(y))) * F.count(F.when(cond, 1)))
    a, b = F.col("_a"), F.col("_b")
    return d.agg(F.count_if(a).alias("n_tail"), F.avg(F.when(a, b.cast("double"))).alias("hit_rate"),
                 F.avg(F.when(a, severe.cast("double"))).alias("severe_rate"), fit(a).alias("r2_tail"),
                 fit(~a).alias("r2_rest"), F.sqrt(F.avg(F.when(a, e2))).alias("rmse_tail"))


def mincer_zarnowitz(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Regress the outcome on the forecast; F statistic of alpha=0, beta=1."""
    d = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_intercept(y, p).alias("alpha"), F.regr_slope(y, p).alias("beta"),
                           F.regr_r2(y, p).alias("r2"), F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))).alias("_ss0"),
                           (F.var_pop(y) * F.count(F.lit(1))).alias("_tss"))
    ssr = (1 - F.col("r2")) * F.col("_tss")
    f = F.try_divide((F.col("_ss0") - ssr) / 2, ssr / (F.col("n") - 2))
    return s.select(*by, "alpha", "beta", "r2", f.alias("f_stat"), "n")


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = with_rank(with_rank(d, by, a, "_ra"), by, b, "_rb")
    return r.groupBy(*by).agg(corr("_ra", "_rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def partial_corr(df: DataFrame, x: str, y: str, control: str) -> DataFrame:
    """Correlation after removing a control from both sides, from the pairwise
    correlations."""
    c = df.dropna(subset=[x, y, control]).agg(corr(x, y).alias("xy"), corr(x, control).alias("xz"), corr(y, control).alias("yz"))
    num = F.col("xy") - F.col("xz") * F.col("yz")
    den = F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")))
    part = F.try_divide(num, den)
    return c.select(part.alias("partial_corr"), (part * part * (1 - F.col("yz") * F.col("yz"))).alias("r2_gain"))


def ks_shift(df: DataFrame, x: str, is_train: Column) -> DataFrame:
    """Mean shift in train standard deviations and the two-sample KS distance."""
    d = df.filter(F.col(x).isNotNull()).withColumn("_t", is_train.cast("bigint"))
    both = value_counts(d, [], x).select(x, (F.col("n_lt") + F.col("n_eq")).alias("le_all"), F.col("n").alias("n_all"))
    train = value_counts(d.filter("_t = 1"), [], x)
    # at every distinct value F1 = train share at or below, F2 = test share; values
    # absent from train carry the train count of the largest smaller value
    marks = both.join(train.select(x, (F.col("n_lt") + F.col("n_eq")).alias("le_tr")), x, "left")
    n_tr = train.agg(F.max("n").alias("v"))
    filled = _cumulative_max(marks, x, "le_tr")
    f1 = F.col("le_tr") / F.col("_n.v")
    f2 = (F.col("le_all") - F.col("le_tr")) / (F.col("n_all") - F.col("_n.v"))
    ks = with_scalars(filled, n_tr, "_n").agg(F.max(F.abs(f1 - f2)).alias("ks"))
    m = d.agg(F.avg(F.when(F.col("_t") == 1, F.col(x))).alias("m1"), F.avg(F.when(F.col("_t") == 0, F.col(x))).alias("m0"),
              F.stddev_samp(F.when(F.col("_t") == 1, F.col(x))).alias("s1"))
    return with_scalars(m, ks, "_k").select(ratio(F.col("m0") - F.col("m1"), "s1").alias("mean_shift"), F.col("_k.ks").alias("ks"))


def _cumulative_max(df: DataFrame, x: str, value: str, pieces: int = 64) -> DataFrame:
    """Fill missing counts with the last known one in value order, by ranges of
    the position, so that no task holds the whole list."""
    n = F.col("n_all")
    d = df.withColumn("_b", F.floor((F.col("le_all") - 1) * pieces / n).cast("int"))
    ends = d.groupBy("_b").agg(F.max(value).alias("_e"))
    w = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_b", F.max("_e").over(w).alias("_before"))
    local = Window.partitionBy("_b").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_l", F.max(value).over(local))
    return attach(d, before, ["_b"]).withColumn(value, F.coalesce("_l", "_before", F.lit(0))).drop("_b", "_l", "_before")


def interval_daily(bounds: DataFrame, alpha: float) -> DataFrame:
    """Method x date means of coverage, upper coverage, interval score, width."""
    y, lo, hi = F.col("target"), F.col("lo"), F.col("hi")
    return bounds.groupBy("method", "date").agg(
        F.avg(b2d((y >= lo) & (y <= hi))).alias("covered"), F.avg(b2d(y <= hi)).alias("covered_hi"),
        F.avg(interval_score(y, lo, hi, alpha)).alias("is_"), F.avg(hi - lo).alias("width"), F.count(F.lit(1)).alias("n"))

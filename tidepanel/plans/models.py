"""Estimators checked by properties, not by SQL."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import boosting as BO
from ..operators import forecast as FC
from ..operators import frames as fr
from ..operators import gram as G
from ..operators import ml
from ..operators.evaluate import auc, confusion, r2
from ..operators.ranks import quantiles, with_rank
from ..session import written
from .forecasts import F4, H3, START, design_a, test, train
from .registry import query


@query("fc_elastic")
def fc_elastic(t):
    d = design_a(t)
    out = G.elastic_net(train(d).dropna(subset=["y", "rv_m"]), test(d).dropna(subset=["y", "rv_m"]), F4, "y", "date")
    return out.groupBy("key").agg(rnd(r2("y", "enet"), 4).alias("r2"), F.count(F.lit(1)).alias("n"))


@query("fc_gbt_reg")
def fc_gbt_reg(t):
    """Walk-forward trees of every quarter, and their online pool with the linear forecasts."""
    d = design_a(t)
    trees = BO.walk_forward_trees(d, F4, START).select("key", "date", "y", "trees")
    har = FC.walk_forward(d, H3, START).select("key", "date", "har")
    both = trees.join(har, ["key", "date"]).filter(F.col("y").isNotNull())
    out = FC.hedge(written(both), ["har", "trees"], y="y").dropna(subset=["har", "trees"])
    return out.groupBy("key").agg(*[rnd(r2("y", c), 4).alias(f"r2_{c}") for c in ("har", "trees", "pool")], F.count(F.lit(1)).alias("n"))


def labelled(t):
    d = design_a(t).dropna(subset=["y", "rv_m"])
    d = fr.with_scalars(d, quantiles(train(d), [], "y", [0.8], ["q"]))
    return d.withColumn("label", (F.col("y") > F.col("_g.q")).cast("double")).drop("_g")


@query("fc_gbt_cls")
def fc_gbt_cls(t):
    d = labelled(t)
    out = BO.split_trees(train(d), test(d), F4, "label", BO.Boost(300, 0.03, 3, 20, 0.05, 0.05, labels=True), "proba")
    out = out.withColumn("hit", (F.col("proba") > 0.5).cast("int")).withColumn("grp", F.lit("all"))
    a = auc(out, ["grp"], "label", "proba")
    return confusion(out, ["grp"], "label", "hit").join(a, "grp").select(*[rnd(c, 4).alias(c) for c in ("precision", "recall", "f1", "accuracy", "auc")])


@query("fc_other_models")
def fc_other_models(t):
    d = design_a(t)
    te = test(d).dropna(subset=["y"])
    h = ml.huber(train(d), te, F4, "y").select("key", "date", "y", *F4, "huber")
    f = ml.forest(train(d), h, F4, "y", trees=10, depth=5)
    b = G.solve(G.sums(train(d), [], F4, "y"), 4, 0.05, lasso=True).select("beta").scalar()
    out = f.withColumn("beta", b).withColumn("lasso", G.predict(F4))
    lg = ml.logistic(train(labelled(t)), test(labelled(t)), F4, "label").withColumn("grp", F.lit("logistic_auc"))
    rows = out.unpivot(["y"], ["huber", "forest", "lasso"], "model", "p").groupBy("model").agg(rnd(r2("y", "p"), 4).alias("score"))
    return rows.unionByName(auc(lg, ["grp"], "label", "proba").select(F.col("grp").alias("model"), rnd("auc", 4).alias("score")))


@query("fc_rank_cls")
def fc_rank_cls(t):
    """Next period's cross-sectional quintile from this period's features."""
    p = t.table_b().withColumn("mom", F.col("x") - F.lag("x", 4).over(fr.by_key()))
    r = with_rank(p, ["date"], "x").withColumn("q", F.least(F.floor(F.col("rank") / F.col("rank_n") * 5 - 1e-9), F.lit(4)).cast("double"))
    d = r.withColumn("label", F.lead("q").over(fr.by_key())).dropna(subset=["label", "mom"])
    out = ml.forest_classifier(train(d), test(d), ["x", "qty", "mom", "q"], "label", trees=10, depth=4)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4).alias("accuracy"))

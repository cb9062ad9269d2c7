"""Tree and linear estimators find structure in seeded data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import evaluate as EV
from tidepanel.operators import ml


@pytest.fixture(scope="module")
def parts(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(1500, 3))
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + 0.5 * x[:, 1] + g.normal(0, 0.2, 1500)
    d = spark.createDataFrame(pd.DataFrame({"i": range(1500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "label": (y > 1.5).astype(float)}))
    return d.filter("i < 1000"), d.filter("i >= 1000")


def r2(d, p):
    return d.agg(EV.r2("y", p)).first()[0]


def test_regressors(parts):
    tr, te = parts
    f = ["a", "b", "c"]
    assert r2(ml.gbt(tr, te, f, "y", trees=15, depth=3, rate=0.2), "pred") > 0.9
    assert r2(ml.forest(tr, te, f, "y", trees=10, depth=5), "forest") > 0.85
    assert 0.5 < r2(ml.huber(tr, te, f, "y"), "huber") < 0.9


def test_classifiers(parts):
    tr, te = parts
    for fit, col in ((ml.gbt_classifier, "proba"), (ml.logistic, "proba")):
        kw = {"trees": 10, "depth": 3, "rate": 0.2} if fit is ml.gbt_classifier else {}
        out = fit(tr, te, ["a", "b", "c"], "label", **kw).withColumn("g", F.lit(0))
        assert EV.auc(out, ["g"], "label", col).first()["auc"] > 0.9


def test_class_weights_balance(parts):
    w = ml.balanced(parts[0], "label").groupBy("label").agg(F.sum("w")).toPandas()
    assert np.allclose(w["sum(w)"], 500)


def test_univariate_selection_keeps_the_signal(parts):
    assert set(ml.univariate(parts[0], ["a", "b", "c"], "y", 2)) == {"a", "b"}

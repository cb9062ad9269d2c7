"""Tree and linear estimators of Spark ML behind one fold-free interface.

Boosting and forests differ from the single-machine trainers in detail; parity is
on metric level (fit quality, rank quality), not tree by tree.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vectors(df: DataFrame, features: list[str]) -> DataFrame:
    d = df.dropna(subset=features)
    return VectorAssembler(inputCols=features, outputCol="features").transform(d)


def _fit(est, train: DataFrame, test: DataFrame, features: list[str], y: str, out: str, classifier: bool) -> DataFrame:
    tr = vectors(train.dropna(subset=[y]), features)
    model = est.setLabelCol(y).setFeaturesCol("features").fit(tr)
    res = model.transform(vectors(test, features))
    if classifier:
        return res.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
    return res.withColumnRenamed("prediction", out).drop("features")


def gbt(train, test, features, y, out="pred", trees=400, depth=5, rate=0.03, sample=0.8):
    return _fit(GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=7), train, test, features, y, out, False)


def balanced(train: DataFrame, y: str) -> DataFrame:
    """Class weights that give both classes the same total."""
    share = train.agg(F.avg(F.col(y).cast("double"))).scalar()
    return train.withColumn("_share", share).withColumn("w", F.when(F.col(y) == 1, 0.5 / F.col("_share")).otherwise(0.5 / (1 - F.col("_share")))).drop("_share")


def gbt_classifier(train, test, features, y, out="proba", trees=100, depth=4, rate=0.05):
    est = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=rate, seed=7, weightCol="w")
    return _fit(est, balanced(train.dropna(subset=[y]), y), test, features, y, out, True)


def logistic(train, test, features, y, out="proba"):
    return _fit(LogisticRegression(maxIter=50), train, test, features, y, out, True)


def huber(train, test, features, y, out="huber"):
    return _fit(LinearRegression(loss="huber", maxIter=50), train, test, features, y, out, False)


def forest(train, test, features, y, out="forest", trees=30, depth=6):
    return _fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=7), train, test, features, y, out, False)


def forest_classifier(train, test, features, y, out="prediction", trees=30, depth=6):
    tr = vectors(train.dropna(subset=[y]), features)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, labelCol=y).fit(tr)
    return model.transform(vectors(test, features)).drop("features", "rawPrediction", "probability")


def univariate(train: DataFrame, features: list[str], y: str, k: int) -> list[str]:
    sel = UnivariateFeatureSelector(featuresCol="features", labelCol=y, outputCol="sel", selectionMode="numTopFeatures")
    sel.setFeatureType("continuous").setLabelType("continuous").setSelectionThreshold(k)
    return [features[i] for i in sel.fit(vectors(train.dropna(subset=[y]), features)).selectedFeatures]

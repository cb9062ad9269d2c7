"""Extension points for callers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gram as G
from .frames import attach


class Forecaster(Protocol):
    """``fit`` turns training rows into a parameter frame, ``predict`` adds the
    forecast column; neither sees the driver."""

    def fit(self, train: DataFrame) -> DataFrame | None: ...

    def predict(self, rows: DataFrame, params: DataFrame | None, out: str) -> DataFrame: ...


class RidgeByKey:
    def __init__(self, features: list[str], y: str, lam: float):
        self.features, self.y, self.lam = features, y, lam

    def fit(self, train: DataFrame) -> DataFrame:
        return G.solve(G.sums(train, ["key"], self.features, self.y), len(self.features), self.lam).select("key", "beta")

    def predict(self, rows: DataFrame, params: DataFrame, out: str) -> DataFrame:
        return attach(rows, params, ["key"]).withColumn(out, G.predict(self.features)).drop("beta")


class Carry:
    """The forecast is a column of the row."""

    def __init__(self, column: str):
        self.column = column

    def fit(self, train: DataFrame) -> None:
        return None

    def predict(self, rows: DataFrame, params: None, out: str) -> DataFrame:
        return rows.withColumn(out, F.col(self.column))


def run_forecasters(df: DataFrame, models: dict[str, Forecaster], is_train: Column, is_test: Column) -> DataFrame:
    train, out = df.filter(is_train), df.filter(is_test)
    for name, model in models.items():
        out = model.predict(out, model.fit(train), name)
    return out


def per_entity(panel: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function per entity frame; an entity holds one row per date."""
    return panel.groupBy("key").applyInPandas(fn, schema)


def with_score(df: DataFrame, score: Column) -> DataFrame:
    return df.withColumn("s_std", score).withColumn("sigma_hat", F.lit(1.0))


def membership(rows: DataFrame, pi: Column) -> DataFrame:
    return rows.select("date").distinct().withColumn("pi", pi)


def vector(*values: float) -> np.ndarray:
    return np.array(values, dtype=float)


def geometric_mean(x: str) -> Column:
    return F.exp(F.avg(F.log(x)))


def root_mean_square(x: str) -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))

"""Tree models of a series from its lags and the season, with a split by time."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators.series import cyclical_month, lags

MODELS = {"boosted": GBTRegressor, "forest": RandomForestRegressor}


def lag_features(df: DataFrame, value: str, by: list[str], order: str, upto: int = 12) -> tuple[DataFrame, list[str]]:
    """``df`` with lags of ``value`` and the cyclical month, rows with a missing lag left out; and the features' names."""
    sine, cosine = cyclical_month(F.col(order))
    names = [*(f"{value}_lag{k}" for k in range(1, upto + 1)), "month_sin", "month_cos"]
    return lags(df, value, by, order, upto).withColumns({"month_sin": sine, "month_cos": cosine}).dropna(subset=[value, *names]), names


def forecast(df: DataFrame, value: str, by: list[str], order: str, first_test, model: str = "boosted", upto: int = 12, **parameters) -> DataFrame:
    """``by``, ``order``, ``value`` and ``predicted`` of the rows from ``first_test`` on; the model is fitted on the rows
    before it, so that no row of the test, and none after a row, is learned from."""
    frame, names = lag_features(df, value, by, order, upto)
    frame = VectorAssembler(inputCols=names, outputCol="features").transform(frame)
    fitted = MODELS[model](featuresCol="features", labelCol=value, predictionCol="predicted", seed=1, **parameters).fit(frame.filter(F.col(order) < first_test))
    return fitted.transform(frame.filter(F.col(order) >= first_test)).select(*by, order, value, "predicted")

"""Estimators with the usual settings, on plain columns: features are assembled, fitted by ``pyspark.ml``, and predicted."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame

KINDS = {
    "linear": lambda label, seed: LinearRegression(labelCol=label, regParam=0.0, solver="normal"),
    "ridge": lambda label, seed: LinearRegression(labelCol=label, regParam=1.0, elasticNetParam=0.0, solver="normal"),
    "forest": lambda label, seed: RandomForestRegressor(labelCol=label, numTrees=100, maxDepth=6, seed=seed),
    "boosting": lambda label, seed: GBTRegressor(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=6, seed=seed),
    "logistic": lambda label, seed: LogisticRegression(labelCol=label),
    "forest_classifier": lambda label, seed: RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=6, seed=seed),
    "boosting_classifier": lambda label, seed: GBTClassifier(labelCol=label, maxIter=100, stepSize=0.1, maxDepth=6, seed=seed),
}


def fit(df: DataFrame, features: list[str], label: str, kind: str = "linear", seed: int = 42, valid: str | None = None, **settings) -> PipelineModel:
    """A fitted pipeline. ``settings`` override the estimator's; boosting stops early on rows where ``valid`` holds."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}; one of {', '.join(KINDS)}")
    estimator = KINDS[kind](label, seed)
    if valid is not None:
        if not estimator.hasParam("validationIndicatorCol"):
            raise ValueError(f"{kind} has no early stopping")
        settings["validationIndicatorCol"] = valid
    estimator.setParams(**settings)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error"), estimator]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the prediction, without the columns made on the way."""
    return model.transform(df).drop("features", "rawPrediction", "probability")

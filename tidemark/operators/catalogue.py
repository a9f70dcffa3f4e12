"""The model catalogue: distributed learners by name, fitted to a table and scored on another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classifiers(seed: int = 1) -> dict:
    """Name -> estimator; features are non-negative for the multinomial model."""
    from pyspark.ml import classification as c

    return {
        "logistic": c.LogisticRegression(maxIter=50),
        "tree": c.DecisionTreeClassifier(maxDepth=3, seed=seed),
        "forest": c.RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
        "boosting": c.GBTClassifier(maxIter=5, maxDepth=3, seed=seed),
        "naive_bayes": c.NaiveBayes(modelType="gaussian"),
        "linear_svm": c.LinearSVC(maxIter=30),
        "network": c.MultilayerPerceptronClassifier(maxIter=30, seed=seed),
    }


def regressors(seed: int = 1) -> dict:
    from pyspark.ml import regression as r

    return {
        "linear": r.LinearRegression(),
        "ridge": r.LinearRegression(regParam=0.1),
        "lasso": r.LinearRegression(regParam=0.1, elasticNetParam=1.0),
        "tree": r.DecisionTreeRegressor(maxDepth=5, seed=seed),
        "forest": r.RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed),
        "boosting": r.GBTRegressor(maxIter=5, maxDepth=3, seed=seed),
        "glm": r.GeneralizedLinearRegression(family="gaussian"),
    }


def vectors(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """df with ``features`` (standardized columns as a vector) and ``label``; rows with a null in them are left out."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="skip").transform(df.withColumn("label", F.col(y).cast("double")).filter("label IS NOT NULL"))
    return StandardScaler(inputCol="__raw", outputCol="features", withMean=True).fit(rows).transform(rows).drop("__raw")


def score_class(df: DataFrame) -> Column:
    """One score for whatever a fitted classifier gives: the probability of class 1, else the margin, else the prediction."""
    from pyspark.ml.functions import vector_to_array

    for name in ("probability", "rawPrediction"):
        if name in df.columns:
            return F.get(vector_to_array(name), F.lit(1))
    return F.col("prediction")


def fitted_scores(train: DataFrame, test: DataFrame, features: Sequence[str], estimator) -> DataFrame:
    """test with ``score`` of the estimator, fitted to train; networks get one hidden layer."""
    if estimator.hasParam("layers"):
        estimator.setLayers([len(features), 4, 2])
    out = estimator.fit(train).transform(test)
    return out.withColumn("score", score_class(out))

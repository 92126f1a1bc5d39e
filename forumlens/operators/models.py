"""Estimators by name, for pipelines that come from configuration, and the grid that fits classifiers."""

from __future__ import annotations

from collections.abc import Sequence


def _stage(name: str, source: str, options: dict):
    from pyspark.ml import clustering, feature

    target = f"features_{name}"
    known = {
        "normalise": lambda: feature.Normalizer(inputCol=source, outputCol=target, **options),
        "standardise": lambda: feature.StandardScaler(inputCol=source, outputCol=target, **{"withMean": True, **options}),
        "reduce": lambda: feature.PCA(inputCol=source, outputCol=target, **{"k": 50, **options}),
        "kmeans": lambda: clustering.KMeans(featuresCol=source, predictionCol="label_found", **{"seed": 7, **options}),
        "bisecting": lambda: clustering.BisectingKMeans(featuresCol=source, predictionCol="label_found", **{"seed": 7, **options}),
    }
    if name not in known:
        raise ValueError(f"no stage is called {name!r}; there are {sorted(known)}")
    return known[name](), target


def pipeline(steps: Sequence[tuple[str, dict]], source: str = "features"):
    """A pipeline of named stages, each reading what the one before wrote."""
    from pyspark.ml import Pipeline

    stages = []
    for name, options in steps:
        stage, source = _stage(name, source, options)
        stages.append(stage)
    return Pipeline(stages=stages)


def classifier_grid(kind: str = "logistic", folds: int = 3, parallelism: int = 2):
    """A cross-validated classifier over a small grid: `logistic`, `forest` or `boosted`."""
    from pyspark.ml import classification as c
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    model, grid = {
        "logistic": lambda m=c.LogisticRegression(): (m, ParamGridBuilder().addGrid(m.regParam, [0.001, 0.01, 0.1])),
        "forest": lambda m=c.RandomForestClassifier(seed=7): (m, ParamGridBuilder().addGrid(m.maxDepth, [4, 8])),
        "boosted": lambda m=c.GBTClassifier(seed=7, maxIter=20): (m, ParamGridBuilder().addGrid(m.maxDepth, [3, 5])),
    }[kind]()
    return CrossValidator(estimator=model, estimatorParamMaps=grid.build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, parallelism=parallelism, seed=7)

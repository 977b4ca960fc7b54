"""Model families behind one trainer, early stopping and scoring, on MLlib."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import metric_of
from .features import Features

#: A missing number: far below all others, so that trees can part it from them.
MISSING = -1e30
#: Families that need a library of their own; they are not built in.
PLUGINS = ("xgboost", "lightgbm", "catboost")


@dataclass(frozen=True)
class ModelConfig:
    family: str = "gbt"
    learning_rate: float = 0.1
    max_depth: int = 6
    n_estimators: int = 100
    subsample: float = 1.0
    colsample: float | None = None
    early_stopping_rounds: int | None = 50
    model_kwargs: dict[str, Any] = field(default_factory=dict)


def make_estimator(cfg: ModelConfig, metric: str, seed: int = 0, label: str = "label", features: str = "features"):
    """The estimator of a family for the task of the metric; ``model_kwargs`` win over the typed fields."""
    if cfg.family in PLUGINS:
        raise ImportError(f"the family {cfg.family!r} needs its own library; built in: 'gbt', 'forest'")
    classifies = metric_of(metric).classifies
    common = {"featuresCol": features, "labelCol": label, "maxDepth": cfg.max_depth, "subsamplingRate": cfg.subsample, "seed": seed}
    if cfg.colsample is not None:
        common["featureSubsetStrategy"] = str(float(cfg.colsample))
    if cfg.family == "gbt":
        made = GBTClassifier if classifies else GBTRegressor
        return made(**common | {"stepSize": cfg.learning_rate, "maxIter": cfg.n_estimators} | cfg.model_kwargs)
    if cfg.family == "forest":
        made = RandomForestClassifier if classifies else RandomForestRegressor
        return made(**common | {"numTrees": cfg.n_estimators} | cfg.model_kwargs)
    raise ValueError(f"unknown family {cfg.family!r}; known: ['forest', 'gbt'] and plugins {PLUGINS}")


def assembled(df: DataFrame, columns: list[str], y: str, indexers: list | None = None) -> tuple[DataFrame, list]:
    """``df`` with ``features`` and ``label``; text columns become indices by frequency, unknown ones the last index."""
    texts = [c for c in columns if dict(df.dtypes)[c] == "string"]
    if indexers is None:
        indexers = [StringIndexer(inputCol=c, outputCol=f"{c}__index", handleInvalid="keep").fit(df) for c in texts]
    for m in indexers:
        df = m.transform(df)
    names = {m.getInputCol(): m.getOutputCol() for m in indexers}
    numbers = {f"{c}__number": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in columns if c not in names}
    inputs = [names.get(c, f"{c}__number") for c in columns]
    out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(df.withColumns(numbers))
    out = out.withColumn("label", F.col(y).cast("double")) if y in df.columns else out
    return out.drop(*numbers, *names.values()), indexers


@dataclass
class Trained:
    model: Any
    indexers: list
    columns: list[str]
    classifies: bool
    best_iteration: int | None = None

    def predict(self, df: DataFrame, y: str, name: str = "prediction") -> DataFrame:
        """``df`` with the prediction: the probability of class 1, or the value."""
        ready, _ = assembled(df, self.columns, y, self.indexers)
        out = self.model.transform(ready)
        value = vector_to_array("probability")[1] if self.classifies else F.col("prediction")
        return out.withColumn("_value", value).select(*(c for c in df.columns if c != name), F.col("_value").alias(name))


def best_of(losses: list[float], patience: int) -> int:
    """Index of the best loss at which ``patience`` rounds without a better one end the search."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best


def fit(train: DataFrame, features: Features | list[str], y: str, cfg: ModelConfig, metric: str, seed: int = 0, valid: DataFrame | None = None) -> Trained:
    """Fit on ``train``; with ``valid`` and early stopping, keep the trees up to its best iteration.

    Boosted trees of fewer iterations are a prefix at one seed, so the best iteration is refitted. Rows without a
    target do not count.
    """
    columns = features.columns if isinstance(features, Features) else list(features)
    ready, indexers = assembled(train.where(F.col(y).isNotNull()), columns, y)
    ready = ready.select("features", "label").persist()
    estimator = make_estimator(cfg, metric, seed)
    if indexers and hasattr(estimator, "setMaxBins"):
        estimator.setMaxBins(max(estimator.getMaxBins(), *(len(m.labels) + 1 for m in indexers)))
    model, best = estimator.fit(ready), None
    if valid is not None and cfg.early_stopping_rounds and cfg.family == "gbt":
        held, _ = assembled(valid.where(F.col(y).isNotNull()), columns, y, indexers)
        held = held.select("features", "label")
        losses = model.evaluateEachIteration(held) if metric_of(metric).classifies else model.evaluateEachIteration(held, "absolute" if metric == "mae" else "squared")
        best = best_of(list(losses), cfg.early_stopping_rounds)
        if best + 1 < cfg.n_estimators:
            model = estimator.copy({estimator.maxIter: best + 1}).fit(ready)
    ready.unpersist()
    return Trained(model, indexers, columns, metric_of(metric).classifies, best)

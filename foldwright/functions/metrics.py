"""Metrics of predictions and of trials, as aggregations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import running_sum

#: Fixed value: probabilities are kept so far from 0 and 1.
EPS = 2.220446049250313e-16


@dataclass(frozen=True)
class Metric:
    name: str
    maximize: bool
    classifies: bool


METRICS = {m.name: m for m in (Metric("auc", True, True), Metric("logloss", False, True), Metric("rmse", False, False), Metric("mae", False, False))}


def metric_of(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[name]


def rmse(y: str, p: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(y) - F.col(p), 2)))


def mae(y: str, p: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(p)))


def logloss(y: str, p: str) -> Column:
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row, ``auc``: the exact area by mid-ranks; null if a class is missing or there are no rows.

    Rows are summed by score first; the ranks are running sums over ranges of the scores, so no task sees them all.
    """
    by = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("score")).agg(F.count(F.when(F.col(y) == 1, 1)).alias("pos"), F.count(F.when(F.col(y) != 1, 1)).alias("neg"))
    by = running_sum(by, [F.col("score")], "neg", "below")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return by.agg((wins / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def score(df: DataFrame, name: str, y: str, p: str) -> float | None:
    """The metric of a frame of predictions."""
    metric_of(name)
    out = auc(df, y, p) if name == "auc" else df.agg({"rmse": rmse, "mae": mae, "logloss": logloss}[name](y, p).alias(name))
    return out.first()[0]


def fold_summary(folds: DataFrame, value: str = "score", *by: str) -> DataFrame:
    """Mean, population standard deviation (0 of a single fold) and number of the scores of folds, for each ``by``."""
    return folds.groupBy(*by).agg(F.avg(value).alias("metric_mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("metric_std"), F.count(value).alias("n_folds"))


def holdout_stats(df: DataFrame, time: str | None = None) -> DataFrame:
    """Rows, and the first and last time as text."""
    at = F.col(time) if time else F.lit(None)
    return df.agg(F.count("*").alias("n_rows"), F.min(at).cast("string").alias("first_time"), F.max(at).cast("string").alias("last_time"))


def state_counts(trials: DataFrame) -> DataFrame:
    return trials.groupBy("state").agg(F.count("*").alias("trials"))


def best_trial(trials: DataFrame, maximize: bool) -> DataFrame:
    """The best completed trial of each study; of equals the first. Pruned trials never count, as theirs are partial means."""
    done = trials.where((F.col("state") == "COMPLETE") & F.col("value").isNotNull())
    rank = F.struct((F.col("value") if maximize else -F.col("value")).alias("v"), (-F.col("trial_number")).alias("t"))
    return done.groupBy("study_name").agg(F.max_by("trial_number", rank).alias("trial_number"), F.max_by("value", rank).alias("value"))

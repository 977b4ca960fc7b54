"""Feature selection, cardinality routing and (out-of-fold) target encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cv import SplitPlan, k_fold, stratified_k_fold
from ..plans.order import sized

#: Fixed values of the smoothing: rows at which a category's mean counts half, and the slope around it.
MIN_SAMPLES = 20
SMOOTHING = 10.0


@dataclass(frozen=True)
class Features:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


def select_features(df: DataFrame, features: Features, *keep: str) -> DataFrame:
    """Numeric, then categorical columns (as text), and the columns to keep; KeyError for missing ones."""
    missing = [c for c in (*features.columns, *keep) if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")
    extra = [c for c in keep if c not in features.columns]
    return df.select(*features.numeric, *(F.col(c).cast("string").alias(c) for c in features.categorical), *extra)


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: distinct values, null being a value. All columns in one pass and one shuffle."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    rows = df.select(F.explode(cells).alias("cell")).select("cell.column", "cell.value").distinct()
    return rows.groupBy("column").agg(F.count("*").alias("cardinality"))


def route(counts: dict[str, int], columns: list[str], threshold: int | None) -> dict[str, str]:
    """'passthrough' for columns of ``threshold`` values at most, else 'encode'. There is no default on purpose."""
    if threshold is None:
        raise ValueError("the cardinality threshold has no default")
    return {c: "passthrough" if counts.get(c, 0) <= threshold else "encode" for c in columns}


def routes(df: DataFrame, columns: list[str], threshold: int | None) -> DataFrame:
    """(column, route): the rule of ``route`` over the counted values of a frame's columns."""
    if threshold is None:
        raise ValueError("the cardinality threshold has no default")
    return cardinalities(df, columns).select("column", F.when(F.col("cardinality") <= threshold, "passthrough").otherwise("encode").alias("route"))


def smoothed(total: Column, n: Column, prior: Column) -> Column:
    """The mean of a category drawn to the prior by 1 / (1 + exp(-(n - MIN_SAMPLES) / SMOOTHING))."""
    weight = 1 / (1 + F.exp(-(n - F.lit(MIN_SAMPLES)) / F.lit(SMOOTHING)))
    return weight * total / n + (1 - weight) * prior


def category_stats(df: DataFrame, columns: list[str], y: str, fold: str | None = None) -> DataFrame:
    """(column, value[, fold], s, n): sum and count of ``y``, all columns in one pass and one shuffle."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    keys = [F.col("cell.column").alias("column"), F.col("cell.value").alias("value"), *([F.col(fold).alias("fold")] if fold else [])]
    rows = df.where(F.col(y).isNotNull()).select(F.explode(cells).alias("cell"), F.col(y).cast("double").alias("y"), *([fold] if fold else []))
    return rows.groupBy(*keys).agg(F.sum("y").alias("s"), F.count("*").alias("n"))


def _joined(df: DataFrame, enc: DataFrame, column: str, to: Column, on_fold: str | None = None) -> DataFrame:
    """``df`` with ``column`` replaced by its encoding, or by ``to`` where there is none."""
    mine = enc.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("enc").alias("_enc"), *([F.col("fold").alias("_fold")] if on_fold else []))
    cond = F.col(column).cast("string").eqNullSafe(F.col("_value"))
    if on_fold:
        cond = cond & (F.col(on_fold) == F.col("_fold"))
    out = df.join(sized(mine), cond, "left").withColumn(column, F.coalesce("_enc", to))
    return out.drop("_value", "_enc", "_fold")


@dataclass
class TargetEncoder:
    """Smoothed category means; an unknown category gets the prior."""

    columns: list[str]
    y: str
    encodings: DataFrame | None = None
    prior: float = 0.0

    def fit(self, df: DataFrame) -> TargetEncoder:
        row = df.agg(F.avg(F.col(self.y).cast("double")).alias("p")).first()
        self.prior = row.p if row.p is not None else 0.0
        stats = category_stats(df, self.columns, self.y)
        self.encodings = stats.select("column", "value", smoothed(F.col("s"), F.col("n"), F.lit(self.prior)).alias("enc")).persist()
        return self

    def release(self) -> None:
        """Let go of the kept encodings; they are computed anew where they are still needed."""
        if self.encodings is not None:
            self.encodings.unpersist()

    def transform(self, df: DataFrame) -> DataFrame:
        if self.encodings is None:
            raise ValueError("the encoder is not fitted")
        for c in self.columns:
            df = _joined(df, self.encodings, c, F.lit(self.prior))
        return df


def out_of_fold(df: DataFrame, columns: list[str], y: str, plan: SplitPlan | None = None, fold: str = "fold") -> DataFrame:
    """``df`` (or the plan's frame) with each column encoded from the other folds only.

    One aggregate by (column, value, fold) serves all folds: the statistics of the other folds are the total less the
    own fold's. A category seen in no other fold gets the prior of the other folds.
    """
    df = plan.frame if plan else df
    by_fold = category_stats(df, columns, y, fold)
    total = by_fold.groupBy("column", "value").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    first = by_fold.where(F.col("column") == columns[0])
    all_ = first.agg(F.sum("s").alias("gs"), F.sum("n").alias("gn"))
    priors = first.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn")).join(F.broadcast(all_))
    priors = priors.select("fold", ((F.col("gs") - F.col("fs")) / F.nullif(F.col("gn") - F.col("fn"), F.lit(0))).alias("prior"))  # a row a fold
    total = total.select(F.col("column").alias("tc"), F.col("value").alias("tv"), "ts", "tn")
    other = by_fold.join(total, F.col("value").eqNullSafe(F.col("tv")) & (F.col("column") == F.col("tc")))
    other = other.select("column", "value", "fold", (F.col("ts") - F.col("s")).alias("s"), (F.col("tn") - F.col("n")).alias("n"))
    other = other.join(F.broadcast(priors), "fold").where("n > 0")
    enc = other.select("column", "value", "fold", smoothed(F.col("s"), F.col("n"), F.col("prior")).alias("enc"))
    df = df.join(F.broadcast(priors.select(F.col("fold").alias("_pf"), F.col("prior").alias("_prior"))), F.col(fold) == F.col("_pf"), "left")
    for c in columns:
        df = _joined(df, enc, c, F.col("_prior"), fold)
    return df.drop("_pf", "_prior")


@dataclass
class FeatureRouter:
    """Numeric columns as they are, categorical ones of few values as they are, the others target-encoded."""

    features: Features
    y: str
    threshold: int | None = None
    classifies: bool = True
    n_splits: int = 5
    seed: int = 0
    routes: dict[str, str] | None = None
    encoder: TargetEncoder | None = None

    def fit(self, df: DataFrame) -> FeatureRouter:
        cats = list(self.features.categorical)
        self.routes = {}
        if cats:
            self.routes = {r["column"]: r.route for r in routes(df, cats, self.threshold).collect()}  # a row a column
            self.routes = {c: self.routes.get(c, "passthrough") for c in cats}  # a frame without rows has no counts
        encoded = [c for c in cats if self.routes[c] == "encode"]
        self.encoder = TargetEncoder(encoded, self.y).fit(df) if encoded else None
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.encoder.transform(df) if self.encoder else df

    def release(self) -> None:
        if self.encoder:
            self.encoder.release()

    def fit_transform(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """Training rows, encoded out of fold, so that no row's own target is in its features."""
        self.fit(df)
        if not self.encoder:
            return df
        plan = stratified_k_fold(df, self.y, keys, self.n_splits, seed=self.seed) if self.classifies else k_fold(df, keys, self.n_splits, seed=self.seed)
        return out_of_fold(df, self.encoder.columns, self.y, plan).drop("pos", "fold")

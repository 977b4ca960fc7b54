"""Artifacts of finished trials: flat metrics and one record a fold, as partitioned tables."""

from __future__ import annotations

from statistics import fmean, pstdev

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runs import Trials

#: What every fold's record must have.
FOLD_KEYS = ("fold_idx", "row_count", "fit_seconds", "timestamp")
METRICS_SCHEMA = "trial_number int, upload string, metrics map<string,double>, study_name string"
FOLDS_SCHEMA = "trial_number int, upload string, fold_idx int, row_count long, fit_seconds double, timestamp string, study_name string"


def metrics_dict(metric: str, scores: list[float], **extra: float) -> dict[str, float]:
    """fold_{i}_{metric} of each fold, metric_mean, metric_std (of the population, 0 of one fold), n_folds and what is given."""
    out = {f"fold_{i}_{metric}": float(s) for i, s in enumerate(scores)}
    out["metric_mean"] = fmean(scores) if scores else 0.0
    out["metric_std"] = pstdev(scores) if len(scores) > 1 else 0.0
    return out | {"n_folds": float(len(scores))} | {k: float(v) for k, v in extra.items()}


class Artifacts:
    """Tables ``metrics`` and ``folds`` under a path, a folder a study: a study's artifacts can be dropped as one folder.

    An upload is first written as folds, then as metrics; metrics without folds are never seen, and an upload that broke
    off in between is not listed. Of several uploads of a trial the last one counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def upload(self, trial: dict, metrics: dict[str, float], folds: list[dict]) -> str:
        """Store the metrics and folds of a trial; returns the upload's name. ValueError if a fold lacks a key."""
        for fold in folds:
            missing = sorted(set(FOLD_KEYS) - set(fold))
            if missing:
                raise ValueError(f"a fold's record lacks {missing}; it has {sorted(fold)}")
        name = self._next(trial["study_name"], trial["trial_number"])
        rows = [(trial["trial_number"], name, int(f["fold_idx"]), int(f["row_count"]), float(f["fit_seconds"]), str(f["timestamp"]), trial["study_name"]) for f in folds]
        for table, schema, data in (("folds", FOLDS_SCHEMA, rows), ("metrics", METRICS_SCHEMA, [(trial["trial_number"], name, {k: float(v) for k, v in metrics.items()}, trial["study_name"])])):
            self.spark.createDataFrame(data, schema).coalesce(1).write.mode("append").partitionBy("study_name").parquet(f"{self.path}/{table}")
        return name

    def _next(self, study: str, number: int) -> str:
        return f"{number:06d}-{self._read('metrics', METRICS_SCHEMA).where((F.col('study_name') == study) & (F.col('trial_number') == number)).count():06d}"

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def metrics(self) -> DataFrame:
        """(study_name, trial_number, upload, metrics): the last upload of each trial."""
        last = F.row_number().over(Window.partitionBy("study_name", "trial_number").orderBy(F.desc("upload")))
        return self._read("metrics", METRICS_SCHEMA).withColumn("_last", last).where("_last = 1").select("study_name", "trial_number", "upload", "metrics")

    def folds(self) -> DataFrame:
        """The records of the folds of each trial's last upload."""
        return self._read("folds", FOLDS_SCHEMA).join(self.metrics().select("study_name", "trial_number", "upload"), ["study_name", "trial_number", "upload"]).select("study_name", "trial_number", *FOLD_KEYS)

    def of_trial(self, trials: Trials, study: str, number: int) -> list[dict]:
        """The artifacts of a trial, none: an empty list. KeyError if the log has no such trial."""
        trials.load(study, number)
        found = self.metrics().where((F.col("study_name") == study) & (F.col("trial_number") == number)).collect()
        return [{"artifact_id": f"{r.upload}/{kind}", "filename": f"{kind}.parquet"} for r in found for kind in ("metrics", "folds")]

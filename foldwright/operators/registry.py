"""Model registry: promote a trial, roll back, load the champion and score it on the rows that no search saw."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import UTC, datetime
from itertools import count

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import columns_hash, settings_hash
from ..functions.metrics import holdout_stats, metric_of, score
from ..sources.files import Files
from .features import FeatureRouter, Features, TargetEncoder
from .runs import provenance_gaps
from .samplers import seeds_from_hex
from .training import ModelConfig, Trained, fit
from .tuning import Task, with_params

KEPT_VERSIONS = 10
MANIFEST_FIELDS = ("problem", "version", "created_at", "model", "task", "study", "trial", "family", "metric", "best_iteration", "routes", "prior", "features_hash", "value", "entropy_hex", "attrs")
_MODELS = {"gbt": (GBTRegressionModel, GBTClassificationModel), "forest": (RandomForestRegressionModel, RandomForestClassificationModel)}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="microseconds")


class RegistryError(ValueError):
    """A manifest that does not fit its schema."""


class Registry:
    """Bundles under ``root``/problem/versions: features and model apart, and a manifest that names them.

    A bundle is written before its manifest and never again, so every manifest names a whole bundle; manifests, receipts
    and the champion are files that are written in one step.
    """

    def __init__(self, spark: SparkSession, root: str, version_format: str = "v_{date}_{short_hash}"):
        self.spark, self.root, self.version_format, self.files = spark, root, version_format, Files(spark)

    def _read(self, path: str) -> dict:
        value = json.loads(self.files.read(f"{self.root}/{path}"))
        if not isinstance(value, dict):
            raise TypeError(f"{path} holds no object")
        return value

    def _manifest(self, problem: str, version: str) -> dict:
        """The manifest of a version; FileNotFoundError if there is none, RegistryError unless it has MANIFEST_FIELDS."""
        try:
            value = self._read(f"{problem}/manifests/{version}.json")
        except json.JSONDecodeError as e:
            raise RegistryError(f"{problem} {version}: {e}") from e
        if set(value) != set(MANIFEST_FIELDS):
            raise RegistryError(f"{problem} {version}: fields missing {sorted(set(MANIFEST_FIELDS) - set(value))}, unknown {sorted(set(value) - set(MANIFEST_FIELDS))}")
        return value

    def promote(self, problem: str, trial: dict, train: DataFrame, valid: DataFrame, task: Task, base: ModelConfig | None = None, today: str | None = None) -> str:
        """Fit the trial's parameters again on ``train``, with ``valid`` for early stopping; its bundle is the champion.

        ValueError if the trial is not complete or lacks provenance. The version is v_{date}_{hash of what was fitted}.
        """
        gaps = provenance_gaps(trial)
        if trial["state"] != "COMPLETE" or gaps:
            raise ValueError(f"trial {trial['trial_number']} is {trial['state']} and lacks {gaps}")
        cfg = with_params(base or ModelConfig(), trial["params"])
        router = FeatureRouter(task.features, task.y, task.threshold, metric_of(task.metric).classifies)
        x = router.fit_transform(train, list(task.keys)) if task.oof and task.features.categorical else router.fit(train).transform(train)
        trained = fit(x, task.features, task.y, cfg, task.metric, seeds_from_hex(trial["attrs"]["entropy_hex"]).model_seed, router.transform(valid))
        settings = {"model": asdict(cfg), "task": asdict(task), "study": trial["study_name"], "trial": trial["trial_number"]}
        version = self._fresh(problem, self.version_format.format(date=today or datetime.now(UTC).strftime("%Y_%m_%d"), short_hash=settings_hash(settings)[:6]))
        base_path = f"{self.root}/{problem}/versions/{version}"
        trained.model.write().save(f"{base_path}/model")
        PipelineModel(trained.indexers).write().save(f"{base_path}/indexers")
        prior = None
        if router.encoder:
            router.encoder.encodings.write.parquet(f"{base_path}/encodings")
            prior = router.encoder.prior
        manifest = settings | {"problem": problem, "version": version, "created_at": _now(), "family": cfg.family, "metric": task.metric, "best_iteration": trained.best_iteration, "routes": router.routes, "prior": prior, "features_hash": columns_hash(task.features.columns), "value": trial["value"], "entropy_hex": trial["attrs"]["entropy_hex"], "attrs": dict(trial["attrs"])}
        self.files.write(f"{self.root}/{problem}/manifests/{version}.json", json.dumps(manifest, sort_keys=True))
        self._crown(problem, manifest)
        return version

    def _fresh(self, problem: str, version: str) -> str:
        """``version``, with a number behind it if a bundle or a manifest of that name is there: none is written over."""
        taken = set(self.files.names(f"{self.root}/{problem}/versions", True)) | {n.removesuffix(".json") for n in self.files.names(f"{self.root}/{problem}/manifests", False)}
        names = (f"{version}_{i}" if i else version for i in count())
        return next(n for n in names if n not in taken)

    def _crown(self, problem: str, manifest: dict) -> None:
        """Make a version the champion in one step: a crash leaves the champion before."""
        value = {"version": manifest["version"], "promoted_at": _now(), "study": manifest["study"], "trial": manifest["trial"], "value": manifest["value"], "metric": manifest["metric"]}
        self.files.write(f"{self.root}/{problem}/champion.json", json.dumps(value, sort_keys=True))

    def champion(self, problem: str) -> str:
        """The version crowned last; FileNotFoundError if there is none."""
        return self.champion_record(problem)["version"]

    def champion_record(self, problem: str) -> dict:
        """The champion's version, when it was crowned, and the study, trial and value it comes from."""
        return self._read(f"{problem}/champion.json")

    def rollback(self, problem: str, version: str) -> None:
        """Make an earlier version the champion; FileNotFoundError if it has no manifest."""
        self._crown(problem, self._manifest(problem, version))

    def problems(self) -> list[str]:
        return self.files.names(self.root, True)

    def versions(self, problem: str) -> list[str]:
        """The last versions, newest first."""
        try:
            rows = self.spark.read.schema("version string, created_at string").json(f"{self.root}/{problem}/manifests")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return [r.version for r in rows.orderBy(F.desc("created_at"), F.desc("version")).limit(KEPT_VERSIONS).collect()]

    def load(self, problem: str, version: str | None = None) -> tuple[FeatureRouter, Trained, dict]:
        """Features, model and manifest of a version, of the champion by default."""
        version = version or self.champion(problem)
        manifest = self._manifest(problem, version)
        base = f"{self.root}/{problem}/versions/{version}"
        task = manifest["task"]
        features = Features(tuple(task["features"]["numeric"]), tuple(task["features"]["categorical"]))
        classifies = metric_of(manifest["metric"]).classifies
        router = FeatureRouter(features, task["y"], task["threshold"], classifies, routes=manifest["routes"])
        if manifest["prior"] is not None:
            encoded = [c for c, r in manifest["routes"].items() if r == "encode"]
            router.encoder = TargetEncoder(encoded, task["y"], self.spark.read.parquet(f"{base}/encodings"), manifest["prior"])
        model = _MODELS[manifest["family"]][classifies].load(f"{base}/model")
        return router, Trained(model, PipelineModel.load(f"{base}/indexers").stages, features.columns, classifies, manifest["best_iteration"]), manifest

    def score_holdout(self, problem: str, test: DataFrame, time: str | None = None, version: str | None = None, output: str | None = None) -> dict:
        """Predict the test rows, write (time, y_true, y_pred) beside a receipt, and return the receipt."""
        router, trained, manifest = self.load(problem, version)
        y = manifest["task"]["y"]
        pred = trained.predict(router.transform(test), y).select(*([time] if time else []), F.col(y).alias("y_true"), F.col("prediction").alias("y_pred"))
        out = f"{output or f'{self.root}/{problem}/holdout'}/{manifest['version']}"
        pred.write.mode("overwrite").parquet(f"{out}/predictions")
        pred = self.spark.read.parquet(f"{out}/predictions")
        stats = holdout_stats(pred, time).first().asDict()
        if not stats["n_rows"]:
            raise ValueError("there are no test rows")
        receipt = {"problem": problem, "version": manifest["version"], "study": manifest["study"], "trial": manifest["trial"], "metric": manifest["metric"], "score": score(pred, manifest["metric"], "y_true", "y_pred"), "scored_at": _now(), "predictions": f"{out}/predictions"} | stats
        self.files.write(f"{out}/receipt", json.dumps(receipt, sort_keys=True))
        return receipt

"""What a user does with settings: train, tune, promote and score, over the dataset that they name."""

from __future__ import annotations

import time
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .functions.hashing import dataset_hashes, logical_hash
from .functions.metrics import best_trial, metric_of, score, state_counts
from .operators.artifacts import Artifacts, metrics_dict
from .operators.features import FeatureRouter, Features
from .operators.provenance import Provenance, ProvenanceError, static_attrs, study_name
from .operators.registry import Registry
from .operators.runs import Trials
from .operators.samplers import Choice, Range, Space, trial_seeds
from .operators.training import ModelConfig, fit
from .operators.tuning import Task, search
from .plans import cv, splits
from .settings import ChoiceSpec, IntSpec, Settings, SettingsError, layer_hash, to_tree, with_overrides
from .sources.parquet import load_parquet


def source(spark: SparkSession, cfg: Settings) -> DataFrame:
    """The rows of data.source_path; SettingsError without it or the target."""
    for name in ("source_path", "target_column"):
        if getattr(cfg.data, name) is None:
            raise SettingsError(f"data.{name}: required")
    df = load_parquet(spark, cfg.data.source_path)
    if cfg.data.target_column not in df.columns:
        raise SettingsError(f"data.target_column: no column {cfg.data.target_column!r}")
    return df


def keys_of(cfg: Settings, df: DataFrame) -> list[str]:
    """Columns that identify a row; by default all, as rows that are equal in all of them can take each other's place."""
    return list(cfg.data.key_columns) or sorted(df.columns)


def split_rows(cfg: Settings, df: DataFrame, seed: int) -> DataFrame:
    """The rows with their role in ``split``."""
    if "split" in df.columns:
        raise SettingsError("data.source_path: a column called 'split' is in the way")
    return splits.split(df, cfg.data.split_kind, keys_of(cfg, df), seed, cfg.data.time_column, dict(cfg.data.split_ratios)).drop("pos")


def task_of(cfg: Settings, keys: list[str]) -> Task:
    features = Features(cfg.features.numeric_columns, cfg.features.categorical_columns)
    if not features.columns:
        raise SettingsError("features: neither numeric nor categorical columns")
    return Task(features, cfg.data.target_column, cfg.training.metric, tuple(keys), cfg.features.threshold, cfg.features.out_of_fold)


def model_of(cfg: Settings) -> ModelConfig:
    own = {k: v for k, v in to_tree(cfg)["training"].items() if k not in ("kind", "metric")}
    return ModelConfig(family=cfg.training.kind, **own)


def space_of(cfg: Settings) -> Space:
    if not cfg.search_space:
        raise SettingsError("search_space: empty")
    return {k: Choice(s.choices) if isinstance(s, ChoiceSpec) else Range(s.low, s.high, s.log, isinstance(s, IntSpec)) for k, s in cfg.search_space.items()}


def plan_of(cfg: Settings, df: DataFrame, seed: int) -> cv.SplitPlan:
    """The cross-validation plan of the settings over some rows."""
    options = {k: v for k, v in to_tree(cfg)["cv"].items() if k not in ("kind", "group_column", "asset_column")}
    return cv.make_plan(df, cfg.cv.kind, keys_of(cfg, df), seed=seed, y=cfg.data.target_column, group=getattr(cfg.cv, "group_column", None), time=cfg.data.time_column, asset=getattr(cfg.cv, "asset_column", None), **options)


def train(spark: SparkSession, cfg: Settings, problem: str | None = None, study: str | None = None) -> dict[str, Any]:
    """Fit on the train rows, score on the validation rows; the run is a trial of its own with provenance and artifacts.

    The split and the seeds come from the trial's entropy, so a promotion of the trial fits the same rows again.
    """
    df = source(spark, cfg)
    shared = static_attrs(spark, cfg, dataset_hashes(spark, cfg.data.source_path))
    trials, name = Trials(spark, cfg.runs.log_root), study_name(cfg.runs.study_name_template, problem, study)
    with trials.one_off(name, {"metric": cfg.training.metric, **shared}) as trial:
        seeds = trial_seeds(cfg.tuning.entropy, trial["trial_number"])
        trial["attrs"] |= {"entropy_hex": seeds.entropy_hex, "split_seed": seeds.split_seed}
        task = task_of(cfg, keys_of(cfg, df))
        rows = split_rows(cfg, df, seeds.split_seed).persist()
        try:
            sides, began = splits.parts(rows), time.monotonic()
            router = FeatureRouter(task.features, task.y, task.threshold, metric_of(task.metric).classifies)
            x = router.fit_transform(sides["train"], list(task.keys)) if task.oof and task.features.categorical else router.fit(sides["train"]).transform(sides["train"])
            held = router.transform(sides["val"])
            trained = fit(x, task.features, task.y, model_of(cfg), task.metric, seeds.model_seed, held)
            trial["value"] = score(trained.predict(held, task.y), task.metric, task.y, "prediction")
            trial["scores"] = [trial["value"]]
            fold = {"fold_idx": 0, "row_count": sides["train"].count(), "fit_seconds": time.monotonic() - began, "timestamp": datetime.now(UTC).isoformat(timespec="seconds")}
            router.release()
        finally:
            rows.unpersist()
        if trained.best_iteration is not None:
            trial["attrs"]["best_iteration"] = trained.best_iteration
    Artifacts(spark, cfg.runs.artifacts_root).upload(trial, metrics_dict(task.metric, trial["scores"]), [fold])
    return trial


def tune(spark: SparkSession, cfg: Settings, name: str, n_more: int | None = None) -> DataFrame:
    """Create or load a study and run ``n_more`` trials (tuning.n_trials by default), the waiting ones first.

    The search sees the train and validation rows alone. The split and the plan have the seeds of the study's first
    trial, which every trial records. Each trial's parameters are settings by path, laid over the given ones and checked with them.
    """
    df, seeds = source(spark, cfg), trial_seeds(cfg.tuning.entropy, 0)
    keys, trials = keys_of(cfg, df), Trials(spark, cfg.runs.log_root)
    known = trials.of_study(name)
    first = known[0]["attrs"] if known else {}
    same = {"split_seed": int(first.get("split_seed", seeds.split_seed)), "cv_seed": int(first.get("cv_seed", seeds.cv_seed))}
    rows = splits.tuning_rows(split_rows(cfg, df, same["split_seed"])).drop("split")
    plan = plan_of(cfg, rows, same["cv_seed"])

    def resolve(params: dict) -> tuple[Task, ModelConfig]:
        own = with_overrides(cfg, params)
        return task_of(own, keys), model_of(own)

    waiting = sum(t["state"] == "WAITING" for t in known)
    more = cfg.tuning.n_trials if n_more is None else n_more
    return search(
        plan, task_of(cfg, keys), space_of(cfg), trials, name, len(known) + max(0, more - waiting), model_of(cfg), cfg.tuning.sampler, cfg.tuning.pruner, cfg.tuning.entropy, cfg.tuning.n_startup_trials,
        timeout=cfg.tuning.trial_timeout_s, folds_at_once=cfg.tuning.folds_at_once, provenance=static_attrs(spark, cfg) | same, artifacts=Artifacts(spark, cfg.runs.artifacts_root), resolve=resolve,
    )


def existing(trials: Trials, name: str) -> list[dict]:
    """The trials of a study; KeyError if the log has none."""
    found = trials.of_study(name)
    if not found:
        raise KeyError(f"no study {name!r}")
    return found


def retry(spark: SparkSession, cfg: Settings, name: str, number: int) -> int:
    """Run a trial's parameters again at once, as a new trial of the study; returns its number."""
    trials = Trials(spark, cfg.runs.log_root)
    existing(trials, name)
    new = trials.retry(name, number)
    tune(spark, cfg, name, 1)
    return new


def status(spark: SparkSession, cfg: Settings, name: str) -> dict[str, Any]:
    """Numbers of a study's trials by state, and its best trial; KeyError if there is no such study."""
    trials = Trials(spark, cfg.runs.log_root)
    existing(trials, name)
    frame = trials.frame(name)
    best = best_trial(frame, metric_of(cfg.training.metric).maximize).first()
    return {"study": name, "states": {r.state: r.trials for r in state_counts(frame).collect()}, "best": trials.load(name, best.trial_number) if best else None}


def settings_of_trial(cfg: Settings, trial: dict) -> Settings:
    return with_overrides(cfg, trial["params"])


#: Layers that decide what a promotion fits.
FITTED_LAYERS = ("data", "features", "training")


def promote(spark: SparkSession, cfg: Settings, problem: str, study: str, number: int, today: str | None = None) -> str:
    """Fit a trial's parameters again and make the bundle the champion; returns its version.

    KeyError without the trial; ProvenanceError unless its attributes are whole, fit the settings and data it is promoted
    with, and its data is what is there now.
    """
    trial = Trials(spark, cfg.runs.log_root).load(study, number)
    known = Provenance.read(trial["attrs"])
    own = settings_of_trial(cfg, trial)
    df = source(spark, own)
    changed = [layer for layer in FITTED_LAYERS if getattr(known, f"{layer}_cfg_hash") != layer_hash(cfg, layer)]
    if changed:
        raise ProvenanceError(f"the settings of {changed} are not those of trial {number} of {study!r}")
    if known.data_logical_hash != logical_hash(df).first().logical_hash:
        raise ProvenanceError(f"the data of trial {number} of {study!r} has changed since")
    sides = splits.parts(split_rows(own, df, known.split_seed))
    registry = Registry(spark, cfg.registry.root, cfg.registry.version_format)
    return registry.promote(problem, trial | {"params": {}}, sides["train"], sides["val"], task_of(own, keys_of(own, df)), model_of(own), today)


def score_holdout(spark: SparkSession, cfg: Settings, problem: str, version: str | None = None, output: str | None = None) -> dict:
    """Score a version, by default the champion, on the test rows that its search and fit never saw."""
    registry = Registry(spark, cfg.registry.root, cfg.registry.version_format)
    _, _, manifest = registry.load(problem, version)
    df = source(spark, cfg)
    rows = split_rows(cfg, df, Provenance.read(manifest["attrs"]).split_seed)
    return registry.score_holdout(problem, splits.parts(rows)["test"], cfg.data.time_column, manifest["version"], output)

"""Seeded hyperparameter searches over a split plan: the fold-mean objective, its trials and their log."""

from __future__ import annotations

import time
from collections.abc import Callable, Generator
from dataclasses import dataclass, replace
from datetime import UTC, datetime
from functools import partial
from statistics import fmean
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..functions.metrics import metric_of, score
from ..plans.cv import SplitPlan
from .artifacts import Artifacts, metrics_dict
from .features import FeatureRouter, Features
from .jobs import FoldRun, TrialTimeout
from .pruners import PRUNERS, prunes, signed_rank_p
from .runs import Trials
from .samplers import SAMPLERS, Choice, Range, SeedBag, Space, draw, seeds_from_hex, trial_seeds
from .training import ModelConfig, fit

__all__ = ["PRUNERS", "SAMPLERS", "Choice", "FoldScore", "Range", "SeedBag", "Space", "Task", "draw", "fold_score", "prunes", "search", "seeds_from_hex", "signed_rank_p", "trial_seeds"]


@dataclass(frozen=True)
class Task:
    """What a search fits: features, target, metric and the columns that identify a row."""

    features: Features
    y: str
    metric: str
    keys: tuple[str, ...]
    threshold: int | None = None
    oof: bool = True


class FoldScore(NamedTuple):
    score: float
    best_iteration: int | None = None
    row_count: int = 0


def fold_score(plan: SplitPlan, i: int, task: Task, cfg: ModelConfig, seed: int) -> FoldScore:
    """Score of split i: features are fitted on its train side alone; the test side ends the boosting early."""
    drop = [c for c in ("pos", "fold") if c in plan.frame.columns]
    train, test = plan.side(i, "train").drop(*drop), plan.side(i, "test").drop(*drop)
    router = FeatureRouter(task.features, task.y, task.threshold, metric_of(task.metric).classifies)
    x = router.fit_transform(train, list(task.keys)) if task.oof and task.features.categorical else router.fit(train).transform(train)
    held = router.transform(test)
    try:
        trained = fit(x, task.features, task.y, cfg, task.metric, seed, held)
        return FoldScore(score(trained.predict(held, task.y), task.metric, task.y, "prediction"), trained.best_iteration, train.count())
    finally:
        router.release()


def with_params(base: ModelConfig, params: dict) -> ModelConfig:
    """The model settings with a trial's parameters; names may be paths below ``training``, others go to ``model_kwargs``."""
    names = {k.removeprefix("training."): v for k, v in params.items()}
    known = {k: v for k, v in names.items() if k in ModelConfig.__dataclass_fields__}
    extra = {k.removeprefix("model_kwargs."): v for k, v in names.items() if k not in known}
    return replace(base, **known, **({"model_kwargs": base.model_kwargs | extra} if extra else {}))


def _timed(objective: Callable, plan: SplitPlan, task: Task, cfg: ModelConfig, seed: int, i: int) -> tuple[FoldScore, float]:
    began = time.monotonic()
    return FoldScore(*objective(plan, i, task, cfg, seed)), time.monotonic() - began


def search(plan: SplitPlan, task: Task, space: Space, trials: Trials, study: str, n_trials: int, base: ModelConfig | None = None, sampler: str = "tpe", pruner: str = "median", master: int | None = 0, n_startup: int = 20, objective: Callable = fold_score, timeout: float | None = None, folds_at_once: int = 1, provenance: dict | None = None, artifacts: Artifacts | None = None, resolve: Callable[[dict], tuple[Task, ModelConfig]] | None = None) -> DataFrame:
    """Run waiting trials, then new ones until the study has ``n_trials``; every step is a row of the log.

    A trial is RUNNING from its start to its last row, so what an earlier driver left running is FAIL when a search of
    the study begins again; the search then goes on where that one ended. Waiting trials keep their parameters. The jobs
    of a trial are a group named by its study and number: after ``timeout`` seconds they are cancelled, the trial is FAIL
    and the next one starts. A trial that raises or is interrupted is FAIL, too, and the error goes on. Up to
    ``folds_at_once`` folds run at a time over one kept frame; scores and pruning do not depend on it, as folds are judged
    in order. ``provenance`` goes to every trial's attributes; finished trials leave their metrics and folds in
    ``artifacts``. ``resolve`` makes task and model of a trial's parameters, if they are not those of the model alone.
    """
    maximize = metric_of(task.metric).maximize
    sign, spark = -1 if maximize else 1, plan.frame.sparkSession
    plan = SplitPlan(plan.frame.persist(), plan.n_splits, plan.train, plan.test)
    try:
        trials.fail_running(study)
        known = {t["trial_number"]: t for t in trials.of_study(study)}
        while True:
            waiting = min((n for n, t in known.items() if t["state"] == "WAITING"), default=None)
            if waiting is None and len(known) >= n_trials:
                return trials.frame(study)
            number = max(known, default=-1) + 1 if waiting is None else waiting
            seeds = trial_seeds(master, number)
            complete = [t for t in known.values() if t["state"] == "COMPLETE"]
            if waiting is None:
                params = draw(sampler, space, [(t["params"], sign * t["value"]) for t in complete], seeds.sampler_seed, n_startup)
            else:
                params = known[number]["params"]
            attrs = {"metric": task.metric, "entropy_hex": seeds.entropy_hex, **(provenance or {}), **(known[number]["attrs"] if waiting is not None else {})}
            trial = {"study_name": study, "trial_number": number, "state": "RUNNING", "value": None, "scores": [], "params": params, "attrs": attrs}
            trials.append(trial)
            trial = trial | {"state": "FAIL", "scores": [], "attrs": dict(attrs)}
            folds, results = [], iter(())
            try:
                own, cfg = resolve(params) if resolve else (task, with_params(base or ModelConfig(), params))
                run = partial(_timed, objective, plan, own, cfg, seeds.model_seed)
                results = iter(FoldRun(spark, f"{study}/{number}", plan.n_splits, run, folds_at_once, timeout))
                for i, (found, seconds) in enumerate(results):
                    trial["scores"].append(found.score)
                    folds.append({"fold_idx": i, "row_count": found.row_count, "fit_seconds": seconds, "timestamp": datetime.now(UTC).isoformat(timespec="seconds")})
                    if found.best_iteration is not None:
                        trial["attrs"]["best_iteration"] = found.best_iteration
                    peers = {n: t["scores"] for n, t in known.items() if n < number}
                    if i + 1 < plan.n_splits and prunes(pruner, trial["scores"], [t["scores"] for t in complete], maximize, number=number, n_folds=plan.n_splits, peers=peers):
                        trial["state"] = "PRUNED"
                        break
                else:
                    trial["state"] = "COMPLETE"
            except TrialTimeout:
                trial["attrs"]["error"] = f"stopped after {timeout:g} seconds"
            except BaseException as e:
                trial["attrs"]["error"] = f"{type(e).__name__}: {e}"[:500]
                raise
            finally:
                if isinstance(results, Generator):
                    results.close()
                trial["value"] = fmean(trial["scores"]) if trial["scores"] else None
                trials.append(trial)
                known[number] = trial
            if artifacts is not None and trial["state"] == "COMPLETE":
                artifacts.upload(trial, metrics_dict(task.metric, trial["scores"]), folds)
    finally:
        plan.frame.unpersist()

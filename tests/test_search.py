"""Samplers, pruners, folds at once, timeouts, the log of trials and their artifacts."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwright.operators import jobs, pruners, samplers
from foldwright.operators.artifacts import Artifacts, metrics_dict
from foldwright.operators.features import Features
from foldwright.operators.jobs import FoldRun, TrialTimeout
from foldwright.operators.runs import Trials, compare_runs
from foldwright.operators.samplers import Choice, Range, draw
from foldwright.operators.training import ModelConfig
from foldwright.operators.tuning import Task, fold_score, search, with_params
from foldwright.plans import cv

TASK = Task(Features(("x",), ()), "y", "auc", ("id",))
SPACE = {"max_depth": Range(2, 6, whole=True), "learning_rate": Range(0.01, 0.5, log=True)}


@pytest.fixture(scope="module")
def plan(spark):
    df = spark.range(60).select("id", (F.col("id") % 11).cast("double").alias("x"), (F.col("id") % 11 > 5).cast("int").alias("y"))
    return cv.k_fold(df, ["id"], 4, seed=1)


# samplers


def branin(p):
    x, y = 15 * p["x"] - 5, 15 * p["y"]
    return (y - 5.1 / (4 * np.pi**2) * x * x + 5 / np.pi * x - 6) ** 2 + 10 * (1 - 1 / (8 * np.pi)) * np.cos(x) + 10 + 3 * (p["c"] == "b")


def best_after(sampler, master, n=30):
    space, seen = {"x": Range(0.0, 1.0), "y": Range(0.0, 1.0), "c": Choice(("a", "b"))}, []
    for i in range(n):
        p = draw(sampler, space, seen, samplers.trial_seeds(master, i).sampler_seed, n_startup=8)
        seen.append((p, float(branin(p))))
    return min(v for _, v in seen), seen


def test_gaussian_process_beats_random_search():
    gp, random = ([best_after(s, m)[0] for m in range(4)] for s in ("gp", "random"))
    assert np.median(gp) < 0.7 < np.median(random)
    assert sum(g < r for g, r in zip(gp, random, strict=True)) == 4


def test_gaussian_process_draws_are_fixed_by_the_seed():
    assert best_after("gp", 3, 14)[1] == best_after("gp", 3, 14)[1] != best_after("gp", 4, 14)[1]


def test_gaussian_process_interpolates_and_is_unsure_far_away():
    x = np.linspace(0, 1, 9)[:, None]
    model = samplers.GaussianProcess(x, np.sin(5 * x[:, 0]))
    mean, sd = model.predict(np.array([[0.31], [0.5], [3.0]]))
    assert abs(mean[0] - np.sin(1.55)) < 0.01 and sd[1] < 0.01 < sd[2]
    assert np.isfinite(samplers.GaussianProcess(np.zeros((4, 1)), np.ones(4)).predict(np.zeros((1, 1)))[0]).all()


def test_expected_improvement_of_a_certain_and_an_unsure_point():
    ei = samplers.expected_improvement(np.array([0.0, 2.0, 1.0]), np.array([1e-9, 1e-9, 1.0]), 1.0)
    assert ei[0] == pytest.approx(1.0) and ei[1] == pytest.approx(0.0) and ei[2] == pytest.approx(1 / np.sqrt(2 * np.pi))


def test_logarithmic_and_whole_parameters_stay_in_range():
    space = {"n": Range(1, 300, log=True, whole=True), "r": Range(1e-4, 1.0, log=True)}
    seen = []
    for i in range(16):
        p = draw("gp", space, seen, i, n_startup=4)
        assert isinstance(p["n"], int) and 1 <= p["n"] <= 300 and 1e-4 <= p["r"] <= 1.0
        seen.append((p, abs(p["n"] - 40) + p["r"]))


def test_samplers_by_name():
    assert draw("gp", SPACE, [], 1, 5) == draw("random", SPACE, [], 1)
    with pytest.raises(ImportError):
        draw("hebo", SPACE, [], 0)
    with pytest.raises(ValueError):
        draw("nope", SPACE, [], 0)


# pruners


def test_brackets_equal_hand_made_tables():
    assert pruners.brackets(81, 3) == [
        [(81, 1), (27, 3), (9, 9), (3, 27), (1, 81)],
        [(34, 3), (11, 9), (3, 27), (1, 81)],
        [(15, 9), (5, 27), (1, 81)],
        [(8, 27), (2, 81)],
        [(5, 81)],
    ]
    assert pruners.brackets(5, 3) == [[(3, 1), (1, 5)], [(2, 5)]]
    assert pruners.brackets(10, 3) == [[(9, 1), (3, 3), (1, 10)], [(5, 3), (1, 10)], [(3, 10)]]
    assert pruners.brackets(1, 3) == [[(1, 1)]]
    with pytest.raises(ValueError):
        pruners.brackets(0)


def test_trials_fill_brackets_by_number():
    own = [pruners.bracket_of(i, 10) for i in range(34)]
    assert own == [0] * 9 + [1] * 5 + [2] * 3 + [0] * 9 + [1] * 5 + [2] * 3


def test_hyperband_keeps_the_best_third_of_its_bracket_at_each_rung():
    peers = {i: [float(v)] for i, v in enumerate([5, 4, 6, 3, 7])}
    ask = lambda number, scores, peers=peers: pruners.prunes("hyperband", scores, [], False, number=number, n_folds=10, peers=peers)
    assert [ask(5, [v]) for v in (2.0, 3.5, 4.5, 9.0)] == [False, False, True, True]  # two of six stay
    assert not ask(5, [9.0, 9.0])  # no rung
    assert ask(5, [9.0] * 3, {0: [1.0] * 3, 1: [2.0] * 3})  # the second rung
    assert not ask(9, [9.0])  # another bracket begins at three folds
    assert not ask(14, [9.0] * 3)  # the last bracket runs in full
    assert pruners.prunes("hyperband", [0.1], [], True, number=5, n_folds=10, peers=peers)


def test_first_of_a_rung_stays():
    assert pruners.stays(5.0, []) and pruners.stays(5.0, [6.0]) and not pruners.stays(5.0, [4.0])


def test_other_pruners():
    past = [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0], [4.0, 4.0]]
    assert pruners.prunes("successive_halving", [3.5], past, False) and not pruners.prunes("successive_halving", [2.5], past, False)
    with pytest.raises(ValueError):
        pruners.prunes("nope", [1.0], [], False)


# folds at once


def test_folds_come_in_order_and_overlap(spark):
    both = threading.Barrier(2, timeout=20)

    def work(i):
        if i < 2:
            both.wait()
        time.sleep(0.2 * (3 - i))
        return spark.range(10).count() + i

    assert list(FoldRun(spark, "overlap", 4, work, 2)) == [10, 11, 12, 13]


def test_jobs_of_folds_overlap_in_spark(spark):
    def slow(i):
        return spark.range(1, numPartitions=1).rdd.map(lambda x: time.sleep(2) or i).collect()[0]

    most, tracker, run = 0, spark.sparkContext.statusTracker(), iter(FoldRun(spark, "two-jobs", 2, slow, 2))
    got = []
    reader = threading.Thread(target=lambda: got.extend(run))
    reader.start()
    while reader.is_alive():
        most = max(most, len(set(tracker.getJobIdsForGroup("two-jobs")) & set(tracker.getActiveJobsIds())))
        time.sleep(0.05)
    assert got == [0, 1] and most == 2


def test_no_fold_begins_before_the_last_is_judged(spark):
    begun = []
    for at_once, seen in ((1, [0, 1]), (3, [0, 1, 2, 3])):
        begun.clear()
        for i, _ in enumerate(FoldRun(spark, "judged", 8, begun.append, at_once)):
            time.sleep(0.3)
            if i == 1:
                break
        assert sorted(begun) == seen


def test_errors_of_a_fold_reach_the_caller(spark):
    def work(i):
        if i == 1:
            raise KeyError("fold")
        return i

    run = iter(FoldRun(spark, "broken", 3, work, 2))
    assert next(run) == 0
    with pytest.raises(KeyError):
        next(run)
    with pytest.raises(ValueError):
        FoldRun(spark, "none", 3, work, 0)


def test_timeout_cancels_spark_jobs(spark):
    began = time.monotonic()
    with pytest.raises(TrialTimeout):
        list(FoldRun(spark, "late", 2, lambda i: spark.range(1, numPartitions=1).rdd.map(lambda x: time.sleep(60)).count(), 1, timeout=1.5))
    assert time.monotonic() - began < 15 and not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_scores_do_not_depend_on_folds_at_once(spark, plan, tmp_path):
    base = ModelConfig(n_estimators=2, early_stopping_rounds=None)
    found = []
    for at_once in (1, 4):
        trials = Trials(spark, f"{tmp_path}/log{at_once}")
        search(plan, TASK, SPACE, trials, "s", 1, base, sampler="random", folds_at_once=at_once)
        found.append([(t["params"], t["scores"], t["state"]) for t in trials.of_study("s")])
    assert found[0] == found[1] and len(found[0][0][1]) == 4


# the log


def constant(value):
    return lambda plan, i, task, cfg, seed: (value + i / 100, None, 45)


def test_a_stopped_trial_is_logged_and_the_next_one_runs(spark, plan, tmp_path):
    trials = Trials(spark, f"{tmp_path}/log")
    calls = []

    def objective(plan, i, task, cfg, seed):
        calls.append(i)
        if len(calls) == 1:
            spark.range(1, numPartitions=1).rdd.map(lambda x: time.sleep(60)).count()
        return 0.5, None

    search(plan, TASK, SPACE, trials, "s", 2, sampler="random", objective=objective, timeout=5)
    first, second = trials.of_study("s")
    assert (first["state"], first["value"], first["attrs"]["error"]) == ("FAIL", None, "stopped after 5 seconds")
    assert second["state"] == "COMPLETE" and second["scores"] == [0.5] * 4
    states = [r.state for r in spark.read.parquet(trials.path).orderBy("at").collect()]
    assert states == ["RUNNING", "FAIL", "RUNNING", "COMPLETE"]


def test_a_driver_that_sleeps_is_left_behind(spark, plan, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "GRACE", 0.5)
    trials = Trials(spark, f"{tmp_path}/log")
    slow = threading.Event()
    search(plan, TASK, SPACE, trials, "s", 1, sampler="random", objective=lambda *_: slow.wait(30) and (0.1, None), timeout=1)
    slow.set()
    assert trials.load("s", 0)["state"] == "FAIL"


def test_search_goes_on_after_a_lost_driver(spark, plan, tmp_path):
    trials = Trials(spark, f"{tmp_path}/log")
    search(plan, TASK, SPACE, trials, "s", 1, sampler="random", objective=constant(0.5))
    trials.append(trials.load("s", 0) | {"trial_number": 1, "state": "RUNNING", "value": None})
    search(plan, TASK, SPACE, trials, "s", 3, sampler="random", objective=constant(0.6))
    assert [t["state"] for t in trials.of_study("s")] == ["COMPLETE", "FAIL", "COMPLETE"]
    assert trials.load("s", 1)["attrs"]["error"] == "left running"


def test_a_retried_trial_keeps_its_parameters_and_gets_a_new_number(spark, plan, tmp_path):
    trials = Trials(spark, f"{tmp_path}/log")

    def broken(*_):
        raise RuntimeError("no memory")

    with pytest.raises(RuntimeError):
        search(plan, TASK, SPACE, trials, "s", 1, sampler="random", objective=broken)
    assert trials.load("s", 0)["attrs"]["error"] == "RuntimeError: no memory"
    assert trials.retry("s", 0) == 1 and trials.load("s", 1)["state"] == "WAITING"
    assert trials.enqueue("s", {"max_depth": 3, "learning_rate": 0.2}) == 2
    search(plan, TASK, SPACE, trials, "s", 0, sampler="random", objective=constant(0.7))
    first, again, own = trials.of_study("s")
    assert again["state"] == "COMPLETE" and again["params"] == first["params"] and again["attrs"]["retry_of"] == "0"
    assert own["state"] == "COMPLETE" and own["params"]["max_depth"] == 3
    with pytest.raises(KeyError):
        trials.retry("s", 9)


def test_pruned_trials_stop_in_order_of_folds(spark, plan, tmp_path):
    trials = Trials(spark, f"{tmp_path}/log")
    search(plan, TASK, SPACE, trials, "s", 5, sampler="random", objective=constant(0.8), pruner="none")
    for at_once in (1, 3):
        search(plan, TASK, SPACE, trials, "s", 5 + (at_once == 1) + 2 * (at_once == 3), sampler="random", objective=constant(0.2), pruner="median", folds_at_once=at_once)
    assert [(t["state"], len(t["scores"])) for t in trials.of_study("s")][5:] == [("PRUNED", 1), ("PRUNED", 1)]


def test_parameters_by_path():
    cfg = with_params(ModelConfig(model_kwargs={"maxBins": 8}), {"training.max_depth": 3, "learning_rate": 0.5, "minInfoGain": 0.1})
    assert (cfg.max_depth, cfg.learning_rate, cfg.model_kwargs) == (3, 0.5, {"maxBins": 8, "minInfoGain": 0.1})


def test_fold_score_counts_its_training_rows(plan):
    found = fold_score(plan, 0, TASK, ModelConfig(n_estimators=2), 1)
    assert found.row_count == 45 and found.score > 0.9


# artifacts


def test_artifacts_of_trials(spark, plan, tmp_path):
    trials, artifacts = Trials(spark, f"{tmp_path}/log"), Artifacts(spark, f"{tmp_path}/artifacts")
    search(plan, TASK, SPACE, trials, "s", 1, sampler="random", objective=constant(0.5), artifacts=artifacts)
    trials.append(trials.load("s", 0) | {"trial_number": 1, "state": "PRUNED"})
    assert artifacts.of_trial(trials, "s", 1) == []
    assert [a["filename"] for a in artifacts.of_trial(trials, "s", 0)] == ["metrics.parquet", "folds.parquet"]
    row = artifacts.metrics().first()
    assert row.metrics["fold_2_auc"] == 0.52 and row.metrics["n_folds"] == 4.0 and row.metrics["metric_mean"] == pytest.approx(0.515)
    assert [(r.fold_idx, r.row_count) for r in artifacts.folds().orderBy("fold_idx").collect()] == [(i, 45) for i in range(4)]
    with pytest.raises(KeyError):
        artifacts.of_trial(trials, "s", 7)
    with pytest.raises(ValueError, match="row_count"):
        artifacts.upload(trials.load("s", 0), {}, [{"fold_idx": 0, "fit_seconds": 1.0, "timestamp": "now"}])
    artifacts.upload(trials.load("s", 0), {"metric_mean": 0.9}, [])
    assert artifacts.metrics().first().metrics == {"metric_mean": 0.9} and artifacts.folds().count() == 0


def test_flat_metrics():
    assert metrics_dict("rmse", [2.0], peak_rss_mb=5) == {"fold_0_rmse": 2.0, "metric_mean": 2.0, "metric_std": 0.0, "n_folds": 1.0, "peak_rss_mb": 5.0}
    assert metrics_dict("rmse", [1.0, 3.0])["metric_std"] == 1.0 and metrics_dict("auc", [])["n_folds"] == 0.0


def test_compared_runs_show_layer_hashes(spark, tmp_path):
    trials = Trials(spark, f"{tmp_path}/log")
    trials.append({"study_name": "s", "trial_number": 0, "state": "COMPLETE", "value": 1.0, "scores": [1.0], "params": {"a": 1}, "attrs": {"cv_cfg_hash": "x", "data_hash": "d"}})
    row = compare_runs(trials.frame("s"), layers=("cv", "data")).first()
    assert (row.attrs_cv_cfg_hash, row.attrs_data_cfg_hash, row.attrs_data_hash, row.params_a) == ("x", None, "d", "1")

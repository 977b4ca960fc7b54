"""Verbs of the command line over settings: data, train, tune, runs and registry; provenance behind them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foldwright import cli, workflow
from foldwright.operators.artifacts import Artifacts
from foldwright.operators.provenance import UNKNOWN, Provenance, ProvenanceError, head_sha, study_name
from foldwright.operators.registry import Registry, RegistryError
from foldwright.operators.runs import Trials
from foldwright.settings import LAYERS, SettingsError, load, with_overrides
from foldwright.sources.files import Files

PROBLEM = """
[data]
source_path = "{at}/rows"
target_column = "y"
key_columns = ["id"]
store_root = "{at}/store"
[features]
numeric_columns = ["x1", "x2"]
[training]
n_estimators = 3
max_depth = 2
early_stopping_rounds = 2
[tuning]
sampler = "random"
pruner = "none"
n_trials = 2
entropy = 7
[cv]
kind = "kfold"
n_splits = 2
[runs]
log_root = "{at}/log"
artifacts_root = "{at}/artifacts"
[registry]
root = "{at}/registry"
[search_space."training.max_depth"]
type = "int"
low = 2
high = 3
[search_space."training.learning_rate"]
type = "float"
low = 0.05
high = 0.5
log = true
"""


@pytest.fixture
def at(spark, tmp_path):
    noise = F.rand(3) - 0.5
    rows = spark.range(0, 200, 1, 2).select("id", (F.col("id") % 23).cast("double").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"), (F.timestamp_seconds(F.col("id") * 3600)).alias("ts"))
    rows.withColumn("y", (F.col("x1") + 14 * noise > 11).cast("int")).write.parquet(f"{tmp_path}/rows")
    (tmp_path / "base.toml").write_text(PROBLEM.format(at=tmp_path))
    return tmp_path


@pytest.fixture
def run(spark, at, capsys, monkeypatch):
    monkeypatch.chdir(at)

    def call(*argv, code=0):
        assert cli.main(["--config", f"{at}/base.toml", *argv], spark) == code
        out = capsys.readouterr()
        return out.err if code else out.out

    return call


def test_train_records_a_whole_trial(run, spark, at):
    said = run("train")
    name = said.splitlines()[0].removeprefix("study: ")
    assert name.startswith("default_oneoff_") and "value (auc): 0." in said
    trials = Trials(spark, f"{at}/log")
    trial = trials.load(name, 0)
    known = Provenance.read(trial["attrs"])
    assert trial["state"] == "COMPLETE" and known.metric == "auc" and known.spark_version == spark.version
    cfg = load(f"{at}/base.toml", variables={})
    assert known.data_hash == f"{known.data_bytes_hash}|{known.data_logical_hash}"
    assert all(len(getattr(known, f"{layer}_cfg_hash")) == 64 for layer in LAYERS)
    folds = Artifacts(spark, f"{at}/artifacts").folds().collect()
    assert [(r.study_name, r.row_count) for r in folds] == [(name, 140)]
    again = workflow.train(spark, cfg)
    assert again["value"] == trial["value"] and again["attrs"]["entropy_hex"] == known.entropy_hex


def test_train_needs_source_and_target(run, at):
    assert "data.target_column: required" in run("--set", "data.target_column=null", "train", code=2)
    assert "data.source_path: required" in run("--set", "data.source_path=null", "train", code=2)
    assert "no column 'nope'" in run("--set", "data.target_column=nope", "train", code=2)
    assert "features" in run("--set", "features.numeric_columns=[]", "train", code=2)
    assert "data.time_column" in run("--set", "data.split_kind=time_ordered", "train", code=2)
    assert "data.split_kind" in run("--set", "cv.kind=time_series", "train", code=2)


def test_train_in_order_of_time(run):
    assert "value (rmse)" in run("--set", "data.split_kind=time_ordered", "--set", "data.time_column=ts", "--set", "training.metric=rmse", "train")


def test_a_failed_run_is_logged(run, spark, at):
    with pytest.raises(Exception, match="x9"):
        run("--set", 'features.numeric_columns=["x9"]', "train")
    assert [r.state for r in Trials(spark, f"{at}/log").frame().collect()] == ["FAIL"]


def test_tune_promote_score_and_roll_back(run, spark, at):
    said = run("tune", "start", "churn_a")
    assert "trials: 2  complete: 2" in said and "best value (auc)" in said
    assert "trials: 3  complete: 3" in run("tune", "resume", "churn_a", "-n", "1")
    said = run("tune", "status", "churn_a")
    assert "root_cfg_hash" in said and "study: churn_a" in said
    assert run("tune", "retry-trial", "churn_a", "1") == "retried trial 1 as trial 3\n"
    trials = Trials(spark, f"{at}/log")
    assert trials.load("churn_a", 3)["params"] == trials.load("churn_a", 1)["params"] and trials.load("churn_a", 3)["state"] == "COMPLETE"
    assert set(trials.load("churn_a", 0)["params"]) == {"training.max_depth", "training.learning_rate"}
    assert {trials.load("churn_a", i)["attrs"]["split_seed"] for i in range(4)} == {trials.load("churn_a", 0)["attrs"]["split_seed"]}

    listed = run("runs", "list", "--problem", "churn")
    assert len(listed.splitlines()) == 5 and run("runs", "list", "--study", "none") == "no trials\n"
    shown = run("runs", "show", "0", "--study", "churn_a")
    assert "entropy_hex" in shown and "metrics.parquet" in shown and "training.max_depth" in shown
    wide = run("runs", "compare", "0", "2", "--study", "churn_a")
    assert "attrs_cv_cfg_hash" in wide and "params_training.max_depth" in wide and len(wide.splitlines()) == 3

    assert "promoted p v_" in run("registry", "promote", "--problem", "p", "--study", "churn_a", "--trial", "0")
    assert "_1\n" in run("registry", "promote", "--problem", "p", "--study", "churn_a", "--trial", "0")
    kept = Registry(spark, f"{at}/registry")
    second, first = kept.versions("p")
    assert second == f"{first}_1" == kept.champion("p")
    listed = run("registry", "list")
    assert f"champion: {second} (trial 0 of churn_a" in listed and f"  {first}" in listed.splitlines()
    receipt = json.loads(run("registry", "score", "--problem", "p", "--output", f"{at}/receipts"))
    assert receipt["version"] == second and receipt["n_rows"] == 30 and receipt["score"] > 0.6
    assert spark.read.parquet(receipt["predictions"]).columns == ["y_true", "y_pred"] and os.path.isfile(f"{at}/receipts/{second}/receipt")
    assert json.loads(run("registry", "score", "--problem", "p", "--version", first))["score"] == receipt["score"]
    assert run("registry", "rollback", "--problem", "p", "--version", first) == f"champion of p: {first}\n" and kept.champion("p") == first
    assert kept.champion_record("p")["value"] == trials.load("churn_a", 0)["value"]
    # the withheld rows are those that the search never saw
    cfg = load(f"{at}/base.toml", variables={})
    seed = int(trials.load("churn_a", 0)["attrs"]["split_seed"])
    roles = workflow.split_rows(cfg, workflow.source(spark, cfg), seed)
    assert roles.where("split = 'test'").count() == 30

    assert "none" in run("registry", "rollback", "--problem", "p", "--version", "none", code=2)
    assert "champion" in run("registry", "score", "--problem", "q", code=2)
    assert "no trial 9" in run("registry", "promote", "--problem", "p", "--study", "churn_a", "--trial", "9", code=2)
    assert "settings of ['training']" in run("--set", "training.subsample=0.5", "registry", "promote", "--problem", "p", "--study", "churn_a", "--trial", "0", code=2)
    trials.append(trials.load("churn_a", 0) | {"trial_number": 7, "attrs": {k: v for k, v in trials.load("churn_a", 0)["attrs"].items() if k != "git_sha"}})
    assert "['git_sha']" in run("registry", "promote", "--problem", "p", "--study", "churn_a", "--trial", "7", code=2)
    assert "not whole" in run("runs", "show", "7", "--study", "churn_a")
    spark.range(3).select("id", F.lit(1.0).alias("x1"), F.lit(1.0).alias("x2"), F.current_timestamp().alias("ts"), F.lit(1).alias("y")).write.mode("append").parquet(f"{at}/rows")
    assert "data of trial 0" in run("registry", "promote", "--problem", "p", "--study", "churn_a", "--trial", "0", code=2)


def test_missing_studies_and_trials(run):
    for argv in (["tune", "status", "none"], ["tune", "resume", "none"], ["tune", "retry-trial", "none", "0"], ["runs", "show", "0", "--study", "none"], ["runs", "compare", "0", "--study", "none"]):
        assert "none" in run(*argv, code=2)
    assert run("registry", "list") == "no problems\n"


def test_data_verbs(run, at):
    hashes = json.loads(run("data", "hash", f"{at}/rows"))
    assert hashes["row_count"] == 200 and set(hashes) == {"bytes_hash", "logical_hash", "row_count", "schema", "version_id"}
    assert run("data", "list") == "no datasets\n"
    assert f"stored d as {hashes['version_id']}" in run("data", "version", "d", f"{at}/rows")
    assert hashes["bytes_hash"] in run("data", "list", "--name", "d") and run("data", "list", "--name", "e") == "no datasets\n"


def test_global_options(run, at, capsys):
    assert json.loads(run("--set", "training.max_depth=5", "--dry-run", "train"))["training"]["max_depth"] == 5
    assert "expected path=value" in run("--set", "training.max_depth", "train", code=2)
    assert "training.nope" in run("--set", "training.nope=1", "train", code=2)
    assert "p.toml" in run("--problem", "p", "train", code=2)
    assert cli.main(["--version"]) == 0 and "0." in capsys.readouterr().out
    assert cli.main([]) == 2 and cli.main(["tune", "start", "-n", "0"]) == 2
    assert all(v in run("--help") for v in ("data", "train", "tune", "runs", "registry"))


def test_searched_settings_outside_training(spark, at):
    cfg = with_overrides(load(f"{at}/base.toml", variables={}), {"tuning.n_trials": 2, "tuning.sampler": "tpe", "features.categorical_columns": ["c"], "features.threshold": 5, "search_space": {"features.threshold": {"type": "categorical", "choices": [1, 30]}}})
    spark.read.parquet(f"{at}/rows").withColumn("c", F.concat(F.lit("g"), F.col("id") % 9)).write.parquet(f"{at}/more")
    cfg = with_overrides(cfg, {"data.source_path": f"{at}/more"})
    workflow.tune(spark, cfg, "s")
    assert {t["state"] for t in Trials(spark, f"{at}/log").of_study("s")} == {"COMPLETE"}
    with pytest.raises(SettingsError):
        workflow.space_of(load(dotenv=None, variables={}))


def test_study_names():
    from datetime import UTC, datetime

    now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert study_name("{problem}_{study}_{stamp}", "p", "s", now) == "p_s_20260102T030405Z"
    assert study_name("{problem}_{study}", now=now) == "default_oneoff"


def test_head_is_read_from_git_files(tmp_path):
    git = tmp_path / ".git"
    assert head_sha(tmp_path) == UNKNOWN
    git.mkdir()
    assert head_sha(tmp_path) == UNKNOWN
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    assert head_sha(tmp_path) == UNKNOWN
    (git / "packed-refs").write_text("# pack-refs with: peeled\n" + "a" * 40 + " refs/heads/main\n")
    (tmp_path / "sub").mkdir()
    assert head_sha(tmp_path / "sub") == "a" * 40
    (git / "refs/heads").mkdir(parents=True)
    (git / "refs/heads/main").write_text("b" * 40 + "\n")
    assert head_sha(tmp_path) == "b" * 40
    (git / "HEAD").write_text("c" * 40)
    assert head_sha(tmp_path) == "c" * 40
    own = git / "worktrees/w"
    own.mkdir(parents=True)
    (own / "HEAD").write_text("ref: refs/heads/main")
    (own / "commondir").write_text("../..\n")
    (tmp_path / "w").mkdir()
    (tmp_path / "w/.git").write_text(f"gitdir: {own}\n")
    assert head_sha(tmp_path / "w") == "b" * 40


def test_provenance_is_strict_on_what_it_needs():
    attrs = {f: "1" for f in Provenance.__dataclass_fields__} | {"more": "x"}
    known = Provenance.read(attrs)
    assert known.default_parallelism == 1 and known.peak_rss_mb == 1.0 and known.best_iteration == 1
    assert Provenance.read(known.attrs()) == known
    assert "best_iteration" not in Provenance.read({k: v for k, v in attrs.items() if k != "best_iteration"}).attrs()
    for name in ("cv_cfg_hash", "entropy_hex", "peak_rss_mb"):
        with pytest.raises(ProvenanceError, match=name):
            Provenance.read({k: v for k, v in attrs.items() if k != name})
    with pytest.raises(ProvenanceError):
        Provenance.read(attrs | {"split_seed": "many"})


def test_registry_files_fit_their_schema(spark, tmp_path):
    kept, files = Registry(spark, str(tmp_path)), Files(spark)
    assert kept.problems() == [] and kept.versions("p") == []
    for text, error in (("[]", TypeError), ("{", RegistryError), ('{"version": "v"}', RegistryError)):
        files.write(f"{tmp_path}/p/manifests/v.json", text)
        with pytest.raises(error):
            kept.rollback("p", "v")
    files.write(f"{tmp_path}/p/champion.json", "[]")
    with pytest.raises(TypeError):
        kept.champion("p")
    assert kept.problems() == ["p"] and kept._fresh("p", "v") == "v_1"

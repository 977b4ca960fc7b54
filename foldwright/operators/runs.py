"""The experiment log: an append-only Parquet table of the states of trials, and the queries over it."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.metrics import fold_summary

SCHEMA = "study_name string, trial_number int, state string, value double, scores array<double>, params map<string,string>, attrs map<string,string>"
#: ``at``: nanoseconds of the driver's clock, rising within a log; of a trial's rows the last one counts.
LOG_SCHEMA = f"{SCHEMA}, at long"
#: A trial waits to be run with given parameters, runs, and ends in one of the other states.
STATES = ("WAITING", "RUNNING", "COMPLETE", "PRUNED", "FAIL")
#: Attributes without which a trial cannot be promoted.
REQUIRED = ("metric", "entropy_hex")


class Trials:
    """Trials under a path that Spark can write; values of params are JSON texts.

    A row is never changed: a trial's new state is a new row, and the last row of a trial is what it is. One driver
    writes a study at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._at = spark, path, 0

    def append(self, trial: dict) -> None:
        if trial["state"] not in STATES:
            raise ValueError(f"unknown state {trial['state']!r}; known: {STATES}")
        self._at = max(self._at + 1, time.time_ns())
        row = (trial["study_name"], trial["trial_number"], trial["state"], trial["value"], trial["scores"], {k: json.dumps(v) for k, v in trial["params"].items()}, {k: str(v) for k, v in trial["attrs"].items() if v is not None}, self._at)
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def frame(self, study: str | None = None, problem: str | None = None) -> DataFrame:
        """All trials, those of one study, or of the studies named '{problem}_...'; no log yet: no rows."""
        try:
            out = self.spark.read.schema(LOG_SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out = self.spark.createDataFrame([], LOG_SCHEMA)
        if study is not None:
            out = out.where(F.col("study_name") == study)
        if problem is not None:
            out = out.where(F.col("study_name").startswith(f"{problem}_"))
        return latest(out)

    def enqueue(self, study: str, params: dict, attrs: dict | None = None) -> int:
        """Let a trial of these parameters wait for the next search of the study; returns its number."""
        number = max((t["trial_number"] for t in self.of_study(study)), default=-1) + 1
        self.append({"study_name": study, "trial_number": number, "state": "WAITING", "value": None, "scores": [], "params": params, "attrs": attrs or {}})
        return number

    def retry(self, study: str, number: int) -> int:
        """Let the parameters of a trial wait to be run again, under a new number; KeyError if there is no such trial."""
        return self.enqueue(study, self.load(study, number)["params"], {"retry_of": number})

    def fail_running(self, study: str) -> list[int]:
        """Mark as FAIL what a driver left running, or a stopped trial; returns the numbers."""
        left = [t for t in self.of_study(study) if t["state"] == "RUNNING"]
        for t in left:
            self.append(t | {"state": "FAIL", "attrs": t["attrs"] | {"error": "left running"}})
        return [t["trial_number"] for t in left]

    def of_study(self, study: str) -> list[dict]:
        """The trials of a study in order, as the samplers and pruners read them (a study has few)."""
        rows = self.frame(study).orderBy("trial_number").collect()
        return [r.asDict() | {"params": {k: json.loads(v) for k, v in r.params.items()}} for r in rows]

    def load(self, study: str, number: int) -> dict:
        found = [t for t in self.of_study(study) if t["trial_number"] == number]
        if not found:
            raise KeyError(f"no trial {number} in study {study!r}")
        return found[0]

    @contextmanager
    def one_off(self, study: str, attrs: dict | None = None) -> Iterator[dict]:
        """One trial, usually a study of its own: set ``value`` in the yielded dict; without it, or on an error, it is FAIL."""
        number = max((t["trial_number"] for t in self.of_study(study)), default=-1) + 1
        trial = {"study_name": study, "trial_number": number, "state": "FAIL", "value": None, "scores": [], "params": {}, "attrs": attrs or {}}
        try:
            yield trial
            if trial["value"] is not None:
                trial["state"] = "COMPLETE"
        finally:
            self.append(trial)


def latest(log: DataFrame) -> DataFrame:
    """The last row of each trial by ``at``, without it: what the trials of a log are now."""
    last = F.row_number().over(Window.partitionBy("study_name", "trial_number").orderBy(F.col("at").desc_nulls_last()))
    return log.withColumn("_last", last).where("_last = 1").drop("_last", "at")


def list_runs(frames: list[DataFrame]) -> DataFrame:
    """Union of trial tables by column name; columns that a table lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    first = [c for c in ("study_name", "trial_number", "state", "value") if c in out.columns]
    return out.select(*first, *(c for c in out.columns if c not in first))


def compare_runs(trials: DataFrame, names: list[str] | None = None, layers: tuple[str, ...] = ()) -> DataFrame:
    """One row a trial, one column a parameter (``params_*``), and the attributes of hashes and of the best iteration;
    ``layers`` adds the hashes of these layers of the settings."""
    long = trials.select("study_name", "trial_number", "state", "value", F.col("attrs"), F.explode_outer("params").alias("name", "setting"))
    names = names or sorted(r.name for r in long.select("name").where("name IS NOT NULL").distinct().collect())  # one a parameter
    wide = [F.max(F.when(F.col("name") == n, F.col("setting"))).alias(f"params_{n}") for n in names]
    attrs = [F.max(F.col("attrs")[a]).alias(f"attrs_{a}") for a in ("metric", "best_iteration", "data_hash", "root_cfg_hash", *(f"{layer}_cfg_hash" for layer in layers))]
    return long.groupBy("study_name", "trial_number", "state", "value").agg(*wide, *attrs)


def provenance_gaps(trial: dict) -> list[str]:
    """Required attributes that a trial lacks."""
    return [a for a in REQUIRED if not trial["attrs"].get(a)]


def fold_artifact(trials: DataFrame) -> DataFrame:
    """(study_name, trial_number, fold, score) of all trials."""
    return trials.select("study_name", "trial_number", F.posexplode("scores").alias("fold", "score"))


def trial_summary(trials: DataFrame, study: str, number: int) -> DataFrame:
    return fold_summary(fold_artifact(trials).where((F.col("study_name") == study) & (F.col("trial_number") == number)))

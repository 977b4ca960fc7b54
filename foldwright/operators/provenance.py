"""Where a trial comes from: hashes of its settings and data, versions, and the commit of the code."""

from __future__ import annotations

import platform
import resource
from dataclasses import MISSING, dataclass, fields
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from ..functions.hashing import data_hash, dataset_hashes
from ..settings import LAYERS, Settings, layer_hash, root_hash

UNKNOWN = "unknown"


def head_sha(path: str | Path = ".") -> str:
    """The commit that is checked out at or above a path, read from git's own files; UNKNOWN where there is none."""
    here = Path(path).resolve()
    for folder in (here, *here.parents):
        git = folder / ".git"
        if not git.exists():
            continue
        if git.is_file():  # a worktree or submodule names its folder
            git = (folder / git.read_text().removeprefix("gitdir:").strip()).resolve()
        try:
            head = (git / "HEAD").read_text().strip()
        except OSError:
            return UNKNOWN
        if not head.startswith("ref:"):
            return head or UNKNOWN
        name = head.removeprefix("ref:").strip()
        common = git / (git / "commondir").read_text().strip() if (git / "commondir").is_file() else git
        for place in (git, common):
            if (place / name).is_file():
                return (place / name).read_text().strip() or UNKNOWN
        packed = common / "packed-refs"
        for line in packed.read_text().splitlines() if packed.is_file() else []:
            sha, _, ref = line.partition(" ")
            if ref.strip() == name:
                return sha
        return UNKNOWN
    return UNKNOWN


def study_name(template: str, problem: str | None = None, study: str | None = None, now: datetime | None = None) -> str:
    """``template`` with {problem} ('default' if none), {study} ('oneoff' if none) and {stamp}, the time in UTC."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    return template.format(problem=problem or "default", study=study or "oneoff", stamp=stamp)


class ProvenanceError(ValueError):
    """A trial's attributes do not say where it comes from."""


@dataclass(frozen=True)
class Provenance:
    """What a trial must record to be promoted; fields with a default may be missing."""

    data_cfg_hash: str
    features_cfg_hash: str
    training_cfg_hash: str
    tuning_cfg_hash: str
    runs_cfg_hash: str
    registry_cfg_hash: str
    cv_cfg_hash: str
    spark_cfg_hash: str
    root_cfg_hash: str
    git_sha: str
    data_hash: str
    data_bytes_hash: str
    data_logical_hash: str
    metric: str
    entropy_hex: str
    spark_version: str
    java_version: str
    python_version: str
    default_parallelism: int
    peak_rss_mb: float
    split_seed: int
    best_iteration: int | None = None

    def attrs(self) -> dict[str, str]:
        """What is known, as the log keeps it."""
        return {f.name: str(v) for f in fields(self) if (v := getattr(self, f.name)) is not None}

    @classmethod
    def read(cls, attrs: dict[str, str]) -> Provenance:
        """From a trial's attributes; others are passed over. ProvenanceError names what is missing or no number."""
        missing = [f.name for f in fields(cls) if f.default is MISSING and not attrs.get(f.name)]
        if missing:
            raise ProvenanceError(f"missing attributes: {missing}")
        kinds = {"int": int, "float": float, "int | None": int}
        try:
            return cls(**{f.name: kinds.get(f.type, str)(attrs[f.name]) for f in fields(cls) if attrs.get(f.name) is not None})
        except ValueError as e:
            raise ProvenanceError(str(e)) from e


def data_attrs(hashes: dict) -> dict[str, str]:
    return {"data_hash": data_hash(hashes), "data_bytes_hash": hashes["bytes_hash"], "data_logical_hash": hashes["logical_hash"]}


def static_attrs(spark: SparkSession, cfg: Settings, hashes: dict | None = None) -> dict[str, str]:
    """The attributes that all trials of a run share: everything but the metric and the trial's own entropy."""
    hashes = hashes or dataset_hashes(spark, cfg.data.source_path)
    return {f"{layer}_cfg_hash": layer_hash(cfg, layer) for layer in LAYERS} | data_attrs(hashes) | {
        "root_cfg_hash": root_hash(cfg),
        "git_sha": head_sha(),
        "spark_version": spark.version,
        "java_version": spark.sparkContext._jvm.System.getProperty("java.version"),
        "python_version": platform.python_version(),
        "default_parallelism": str(spark.sparkContext.defaultParallelism),
        "peak_rss_mb": f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.1f}",
    }

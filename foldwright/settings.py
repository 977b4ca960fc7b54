"""Layered settings with a closed schema: defaults, TOML layers, environment and overrides by dot path, checked as a whole."""

from __future__ import annotations

import json
import os
import tomllib
import types
import typing
from collections.abc import Mapping
from dataclasses import MISSING, asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, Literal

from .functions.hashing import canonical_json, settings_hash, sha256_text
from .plans.splits import DEFAULT_RATIOS, check_ratios

#: Environment variables are PREFIX, then the path with NESTED between its parts, in any case.
PREFIX = "FOLDWRIGHT_"
NESTED = "__"


class SettingsError(ValueError):
    """A setting that does not fit the schema; the message begins with its path."""


@dataclass(frozen=True)
class DataSettings:
    source_path: str | None = None
    target_column: str | None = None
    #: Columns that identify a row; none: all columns do, so that equal rows are interchangeable.
    key_columns: tuple[str, ...] = ()
    time_column: str | None = None
    split_kind: Literal["random", "time_ordered"] = "random"
    split_ratios: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_RATIOS))
    store_root: str = "data/store"


@dataclass(frozen=True)
class FeatureSettings:
    numeric_columns: tuple[str, ...] = ()
    categorical_columns: tuple[str, ...] = ()
    #: Has no default on purpose: columns of more values are target-encoded.
    threshold: int | None = None
    out_of_fold: bool = True


@dataclass(frozen=True)
class _Training:
    metric: Literal["auc", "logloss", "rmse", "mae"] = "auc"
    max_depth: int = 6
    n_estimators: int = 100
    subsample: float = 1.0
    colsample: float | None = None
    model_kwargs: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class BoostedTraining(_Training):
    kind: Literal["gbt"] = "gbt"
    learning_rate: float = 0.1
    early_stopping_rounds: int | None = 50


@dataclass(frozen=True)
class ForestTraining(_Training):
    kind: Literal["forest"] = "forest"


@dataclass(frozen=True)
class TuningSettings:
    sampler: Literal["random", "tpe", "gp", "hebo"] = "tpe"
    pruner: Literal["none", "median", "wilcoxon", "successive_halving", "hyperband"] = "wilcoxon"
    n_trials: int = 50
    n_startup_trials: int = 20
    trial_timeout_s: float | None = None
    folds_at_once: int = 1
    entropy: int | None = None


@dataclass(frozen=True)
class RunSettings:
    log_root: str = "studies/log"
    artifacts_root: str = "studies/artifacts"
    study_name_template: str = "{problem}_{study}_{stamp}"


@dataclass(frozen=True)
class RegistrySettings:
    root: str = "registry"
    version_format: str = "v_{date}_{short_hash}"


@dataclass(frozen=True)
class KFoldSettings:
    kind: Literal["kfold"] = "kfold"
    n_splits: int = 5
    shuffle: bool = True


@dataclass(frozen=True)
class StratifiedSettings:
    kind: Literal["stratified"] = "stratified"
    n_splits: int = 5
    shuffle: bool = True


@dataclass(frozen=True)
class GroupSettings:
    group_column: str
    kind: Literal["group"] = "group"
    n_splits: int = 5


@dataclass(frozen=True)
class WalkForwardSettings:
    kind: Literal["time_series"] = "time_series"
    n_splits: int = 5
    gap: int = 0
    max_train_size: int | None = None
    embargo: int | str | None = None
    unit: Literal["ns", "us", "ms", "s"] | None = None


@dataclass(frozen=True)
class CombinatorialSettings:
    kind: Literal["cpcv"] = "cpcv"
    n_folds: int = 10
    n_test_folds: int = 2
    purge: int = 0
    embargo: int = 0
    target_horizon_bars: int = 0
    embargo_pct: float = 0.0


@dataclass(frozen=True)
class PanelSettings:
    asset_column: str
    kind: Literal["panel_cpcv"] = "panel_cpcv"
    n_folds: int = 10
    n_test_folds: int = 2
    target_horizon_bars: int = 0
    embargo_pct: float = 0.0


@dataclass(frozen=True)
class FloatSpec:
    low: float
    high: float
    type: Literal["float"] = "float"
    log: bool = False


@dataclass(frozen=True)
class IntSpec:
    low: int
    high: int
    type: Literal["int"] = "int"
    log: bool = False


@dataclass(frozen=True)
class ChoiceSpec:
    choices: tuple[str | int | float, ...]
    type: Literal["categorical"] = "categorical"


Training = BoostedTraining | ForestTraining
CrossValidation = KFoldSettings | StratifiedSettings | GroupSettings | WalkForwardSettings | CombinatorialSettings | PanelSettings
Spec = FloatSpec | IntSpec | ChoiceSpec

#: Plans that need rows in order of time.
TEMPORAL = ("time_series", "cpcv", "panel_cpcv")


@dataclass(frozen=True)
class Settings:
    data: DataSettings = field(default_factory=DataSettings)
    features: FeatureSettings = field(default_factory=FeatureSettings)
    training: Training = field(default_factory=BoostedTraining)
    tuning: TuningSettings = field(default_factory=TuningSettings)
    runs: RunSettings = field(default_factory=RunSettings)
    registry: RegistrySettings = field(default_factory=RegistrySettings)
    cv: CrossValidation = field(default_factory=KFoldSettings)
    #: Spark settings of the session that the command line opens.
    spark: dict[str, str] = field(default_factory=dict)
    #: Searched settings by their path, such as "training.max_depth".
    search_space: dict[str, Spec] = field(default_factory=dict)


LAYERS = ("data", "features", "training", "tuning", "runs", "registry", "cv", "spark")
#: Settings that say where things are, not what they are; no hash depends on them.
PLACES = ("data.source_path", "data.store_root", "runs.log_root", "runs.artifacts_root", "registry.root")


# trees of plain values


def unflatten(flat: Mapping[str, Any]) -> dict:
    """A tree of values by dot paths; ValueError where a path leads through a value or a value stands where others lie."""
    out: dict = {}
    for path, value in flat.items():
        *above, last = path.split(".")
        at = out
        for part in above:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise SettingsError(f"{path}: conflicts with a value at {part!r}")
        if isinstance(at.get(last), dict) and at[last]:
            raise SettingsError(f"{path}: conflicts with settings below it")
        at[last] = value
    return out


def merged(low: dict, high: Mapping) -> dict:
    """``low`` with ``high`` over it: tables merge, all other values and lists replace."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


class _Text(str):
    """A value from the environment: the schema says what it is meant to be."""


# schema


def _fits(kind: Any, value: Any, path: str) -> Any:
    """``value`` as the type ``kind``; SettingsError with its path if it is none."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    either = origin in (types.UnionType, typing.Union)
    if isinstance(value, _Text) and kind is not str and (not either or value == "null") and not (origin is Literal and value in args):
        try:
            value = json.loads(value)
        except json.JSONDecodeError:
            value = str(value)
    if kind is Any:
        return value
    if either:
        if all(is_dataclass(a) for a in args):
            return _variant(args, value, path)
        for a in args:
            try:
                return _fits(a, value, path)
            except SettingsError:
                continue
        raise SettingsError(f"{path}: {value!r} is none of {', '.join(getattr(a, '__name__', str(a)) for a in args)}")
    if origin is Literal:
        if value not in args:
            raise SettingsError(f"{path}: {value!r} is none of {list(args)}")
        return value
    if origin is tuple and isinstance(value, list | tuple):
        return tuple(_fits(args[0], v, f"{path}.{i}") for i, v in enumerate(value))
    if origin is dict and isinstance(value, Mapping):
        return {str(k): _fits(args[1], v, f"{path}.{k}") for k, v in value.items()}
    if is_dataclass(kind):
        return _built(kind, value, path)
    if kind is types.NoneType and value is None:
        return None
    if kind is float and isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    if kind in (str, int, bool) and isinstance(value, kind) and (kind is bool or not isinstance(value, bool)):
        return str(value) if kind is str else value
    raise SettingsError(f"{path}: {value!r} is no {getattr(kind, '__name__', kind)}")


def _variant(kinds: tuple, value: Any, path: str) -> Any:
    """The one of several classes that the value's ``kind`` or ``type`` names; without it, the first."""
    tag = "kind" if "kind" in {f.name for f in fields(kinds[0])} else "type"
    known = {typing.get_args(typing.get_type_hints(k)[tag])[0]: k for k in kinds}
    if not isinstance(value, Mapping):
        raise SettingsError(f"{path}: {value!r} is no table")
    name = value.get(tag, next(iter(known)))
    if name not in known:
        raise SettingsError(f"{path}.{tag}: {name!r} is none of {sorted(known)}")
    return _built(known[name], value, path)


def _built(kind: type, value: Any, path: str) -> Any:
    if not isinstance(value, Mapping):
        raise SettingsError(f"{path}: {value!r} is no table")
    hints, known = typing.get_type_hints(kind), {f.name: f for f in fields(kind)}
    below = lambda name: f"{path}.{name}" if path else name
    if unknown := sorted(set(value) - set(known)):
        raise SettingsError(f"{below(unknown[0])}: unknown; known: {sorted(known)}")
    for name, f in known.items():
        if name not in value and f.default is MISSING and f.default_factory is MISSING:
            raise SettingsError(f"{below(name)}: required")
    return kind(**{name: _fits(hints[name], v, below(name)) for name, v in value.items()})


def _check(cfg: Settings) -> Settings:
    """What no single setting shows."""
    if cfg.data.split_kind == "time_ordered" and cfg.data.time_column is None:
        raise SettingsError("data.time_column: needed for data.split_kind 'time_ordered'")
    if cfg.cv.kind in TEMPORAL and cfg.data.split_kind != "time_ordered":
        raise SettingsError(f"data.split_kind: cv.kind {cfg.cv.kind!r} needs 'time_ordered'; a random split would mix times that the folds keep apart")
    try:
        check_ratios(cfg.data.split_ratios)
    except ValueError as e:
        raise SettingsError(f"data.split_ratios: {e}") from e
    for path, spec in cfg.search_space.items():
        if isinstance(spec, ChoiceSpec):
            if not spec.choices:
                raise SettingsError(f"search_space.{path}: no choices")
        elif spec.low > spec.high or (spec.log and spec.low <= 0):
            raise SettingsError(f"search_space.{path}: no range from {spec.low} to {spec.high}")
    return cfg


def from_tree(tree: Mapping) -> Settings:
    """Settings from a tree of plain values, checked as a whole, with every searched path tried at its first value."""
    cfg = _check(_built(Settings, tree, ""))
    plain = to_tree(cfg) | {"search_space": {}}
    for path, spec in cfg.search_space.items():
        try:
            first = spec.choices[0] if isinstance(spec, ChoiceSpec) else spec.low
            _built(Settings, merged(plain, unflatten({path: first})), "")
        except SettingsError as e:
            raise SettingsError(f"search_space.{path}: {e}") from e
    return cfg


def to_tree(cfg: Settings) -> dict:
    return json.loads(canonical_json(asdict(cfg)))


def with_overrides(cfg: Settings, flat: Mapping[str, Any]) -> Settings:
    """The settings with values by dot path over them, all checked anew."""
    return from_tree(merged(to_tree(cfg), unflatten(flat)))


# layers


def environment_tree(variables: Mapping[str, str]) -> dict:
    """The tree of the variables that begin with PREFIX."""
    own = {k.upper().removeprefix(PREFIX).lower(): _Text(v) for k, v in variables.items() if k.upper().startswith(PREFIX)}
    return unflatten({k.replace(NESTED, "."): v for k, v in own.items()})


def env_file(path: str | Path) -> dict[str, str]:
    """Variables of a file of NAME=value lines; blank lines, comments and quotes around values are dropped."""
    out = {}
    for line in Path(path).read_text().splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def load(base: str | Path | None = None, problem: str | None = None, study: str | None = None, overrides: Mapping[str, Any] | None = None, problems_dir: str | Path = "configs/problems", studies_dir: str | Path = "configs/studies", dotenv: str | Path | None = ".env", variables: Mapping[str, str] | None = None) -> Settings:
    """Settings of all layers, each over the one before: defaults, base, problem and study file, ``dotenv`` if it is
    there, environment, overrides by dot path. FileNotFoundError for a missing layer, SettingsError for what does not fit."""
    files = [base, problem and Path(problems_dir) / f"{problem}.toml", study and Path(studies_dir) / f"{study}.toml"]
    tree: dict = {}
    for path in filter(None, files):
        try:
            tree = merged(tree, tomllib.loads(Path(path).read_text()))
        except tomllib.TOMLDecodeError as e:
            raise SettingsError(f"{path}: {e}") from e
    if dotenv and Path(dotenv).is_file():
        tree = merged(tree, environment_tree(env_file(dotenv)))
    tree = merged(tree, environment_tree(os.environ if variables is None else variables))
    return from_tree(merged(tree, unflatten(overrides or {})))


def parse_overrides(items: list[str]) -> dict[str, Any]:
    """Overrides written as 'path=value'; a value is JSON if it can be, else text."""
    out: dict[str, Any] = {}
    for item in items:
        path, eq, value = item.partition("=")
        if not eq or not path.strip():
            raise SettingsError(f"{item!r}: expected path=value")
        try:
            out[path.strip()] = json.loads(value)
        except json.JSONDecodeError:
            out[path.strip()] = value
    return out


# hashes


def root_hash(cfg: Settings) -> str:
    """Hash of all settings but PLACES."""
    return settings_hash(to_tree(cfg), PLACES)


def layer_hash(cfg: Settings, layer: str) -> str:
    """Hash of one layer but its PLACES."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}; known: {LAYERS}")
    return sha256_text(canonical_json({k: v for k, v in to_tree(cfg)[layer].items() if f"{layer}.{k}" not in PLACES}))

"""Layers, overrides, schema, checks and hashes of settings."""

import pytest

from foldwright import settings
from foldwright.settings import SettingsError, load, with_overrides

BASE = """
[data]
target_column = "y"
[training]
kind = "gbt"
learning_rate = 0.1
max_depth = 6
[features]
numeric_columns = ["a", "b"]
"""


@pytest.fixture
def layers(tmp_path):
    (tmp_path / "base.toml").write_text(BASE)
    for name, text in (("problems", '[data]\ntarget_column = "label"\n[training]\nmax_depth = 7\n'), ("studies", '[training]\nlearning_rate = 0.05\n[features]\nnumeric_columns = ["c"]\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.toml").write_text(text)
    return {"base": tmp_path / "base.toml", "problems_dir": tmp_path / "problems", "studies_dir": tmp_path / "studies", "dotenv": tmp_path / ".env", "variables": {}}


def test_layers_lie_over_each_other(layers, tmp_path):
    at = lambda **more: load(**layers | more)
    assert (at().training.max_depth, at().data.target_column, at().features.numeric_columns) == (6, "y", ("a", "b"))
    assert (at(problem="p").training.max_depth, at(problem="p").training.learning_rate) == (7, 0.1)
    both = at(problem="p", study="p")
    assert (both.data.target_column, both.training.learning_rate, both.training.max_depth) == ("label", 0.05, 7)
    assert both.features.numeric_columns == ("c",)  # lists replace
    (tmp_path / ".env").write_text("# comment\nFOLDWRIGHT_TRAINING__MAX_DEPTH='8'\nOTHER=1\n\n")
    assert at(study="p").training.max_depth == 8
    env = {"FOLDWRIGHT_TRAINING__MAX_DEPTH": "9", "foldwright_tuning__entropy": "null", "FOLDWRIGHT_DATA__TARGET_COLUMN": "12"}
    found = at(problem="p", variables=env)
    assert (found.training.max_depth, found.tuning.entropy, found.data.target_column) == (9, None, "12")
    assert at(variables=env, overrides={"training.max_depth": 11}).training.max_depth == 11
    assert at(variables={"FOLDWRIGHT_FEATURES__NUMERIC_COLUMNS": '["z"]'}).features.numeric_columns == ("z",)
    assert load(dotenv=None, variables={}) == settings.Settings()


def test_missing_and_broken_files(layers, tmp_path):
    with pytest.raises(FileNotFoundError):
        load(**layers | {"problem": "none"})
    layers["base"].write_text("[data")
    with pytest.raises(SettingsError):
        load(**layers)


@pytest.mark.parametrize(
    ("overrides", "path"),
    [
        ({"training.nope": 1}, "training.nope"),
        ({"nope.x": 1}, "nope"),
        ({"training.max_depth": "deep"}, "training.max_depth"),
        ({"training.max_depth": 1.5}, "training.max_depth"),
        ({"training.max_depth": True}, "training.max_depth"),
        ({"training.metric": "f1"}, "training.metric"),
        ({"training.kind": "svm"}, "training.kind"),
        ({"training.kind": "forest"}, "training.learning_rate"),
        ({"cv.kind": "group"}, "cv.group_column"),
        ({"cv": 5}, "cv"),
        ({"data.split_ratios": {"train": 0.9, "val": 0.2, "test": 0.1}}, "data.split_ratios"),
        ({"data.split_kind": "time_ordered"}, "data.time_column"),
        ({"cv.kind": "cpcv"}, "data.split_kind"),
        ({"search_space": {"training.nope": {"type": "int", "low": 1, "high": 2}}}, "search_space.training.nope"),
        ({"search_space": {"training.max_depth": {"type": "int", "low": 3, "high": 2}}}, "search_space.training.max_depth"),
        ({"search_space": {"training.max_depth": {"type": "bool", "low": 3}}}, "search_space.training.max_depth.type"),
        ({"search_space": {"training.learning_rate": {"low": 0.0, "high": 1.0, "log": True}}}, "search_space.training.learning_rate"),
        ({"search_space": {"training.kind": {"type": "categorical", "choices": []}}}, "search_space.training.kind"),
    ],
)
def test_what_does_not_fit_is_named(layers, overrides, path):
    with pytest.raises(SettingsError) as e:
        load(**layers, overrides=overrides)
    assert str(e.value).startswith(f"{path}:")


def test_every_plan_loads(layers):
    time = {"data.split_kind": "time_ordered", "data.time_column": "ts"}
    for kind, more in {"kfold": {}, "stratified": {}, "group": {"cv.group_column": "g"}, "time_series": time | {"cv.embargo": "24h"}, "cpcv": time, "panel_cpcv": time | {"cv.asset_column": "a"}}.items():
        assert load(**layers, overrides={"cv.kind": kind} | more).cv.kind == kind


def test_overrides_by_path(layers):
    cfg = load(**layers)
    new = with_overrides(cfg, {"training.learning_rate": 0.5, "features.threshold": 3, "training.model_kwargs.maxBins": 64})
    assert (new.training.learning_rate, new.features.threshold, new.training.model_kwargs) == (0.5, 3, {"maxBins": 64})
    assert cfg.training.learning_rate == 0.1 and new.data == cfg.data
    assert with_overrides(cfg, {}) == cfg
    for flat in ({"training": 1, "training.max_depth": 2}, {"training.max_depth": 2, "training": 1}, {"training.max_depth.x": 1}):
        with pytest.raises(SettingsError):
            with_overrides(cfg, flat)
    assert with_overrides(cfg, {"cv.n_splits": 7}).cv.n_splits == 7


def test_trees_merge_and_stay_untouched():
    low = {"a": {"x": 1, "y": [1, 2]}, "b": 1}
    assert settings.merged(low, {"a": {"y": [3]}, "b": {"c": 1}}) == {"a": {"x": 1, "y": [3]}, "b": {"c": 1}}
    assert low == {"a": {"x": 1, "y": [1, 2]}, "b": 1}


def test_written_overrides():
    assert settings.parse_overrides(["a.b=0.5", "c=true", "d=text=x", 'e=["f"]', "g= h"]) == {"a.b": 0.5, "c": True, "d": "text=x", "e": ["f"], "g": " h"}
    for bad in ("a", "=1", " =1"):
        with pytest.raises(SettingsError):
            settings.parse_overrides([bad])


def test_hashes(layers):
    cfg = load(**layers)
    assert settings.root_hash(cfg) == settings.root_hash(load(**layers)) and len(settings.root_hash(cfg)) == 64
    deep = with_overrides(cfg, {"training.max_depth": 3})
    assert settings.root_hash(deep) != settings.root_hash(cfg)
    changed = [layer for layer in settings.LAYERS if settings.layer_hash(cfg, layer) != settings.layer_hash(deep, layer)]
    assert changed == ["training"]
    moved = with_overrides(cfg, {"data.store_root": "/x", "data.source_path": "/y", "runs.log_root": "/z", "runs.artifacts_root": "/a", "registry.root": "/r"})
    assert settings.root_hash(moved) == settings.root_hash(cfg)
    assert all(settings.layer_hash(moved, layer) == settings.layer_hash(cfg, layer) for layer in settings.LAYERS)
    with pytest.raises(ValueError):
        settings.layer_hash(cfg, "nope")


def test_settings_survive_their_tree(layers):
    cfg = load(**layers, overrides={"search_space": {"training.max_depth": {"type": "int", "low": 2, "high": 4}, "training.metric": {"type": "categorical", "choices": ["auc"]}}})
    assert settings.from_tree(settings.to_tree(cfg)) == cfg

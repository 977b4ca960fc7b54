"""Command line: data, train, tune, runs and registry verbs over layered settings.

    python -m foldwright --config configs/base.toml --problem churn --set training.max_depth=4 tune start -n 20
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

from . import __version__, workflow
from .functions.hashing import canonical_json, dataset_hashes
from .operators.artifacts import Artifacts
from .operators.provenance import Provenance, ProvenanceError, study_name
from .operators.registry import Registry
from .operators.runs import Trials, compare_runs, list_runs
from .settings import LAYERS, Settings, load, parse_overrides, to_tree
from .sources.parquet import list_manifests, snapshot

USAGE = 2


def session(cfg: Settings) -> SparkSession:
    builder = SparkSession.builder.appName("foldwright").config("spark.sql.session.timeZone", "UTC")
    for k, v in cfg.spark.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(rows: Iterable[dict], columns: list[str]) -> str:
    """Text columns, wide enough for every value, so that none is cut short."""
    cells = [columns, *([("" if r.get(c) is None else str(r[c])) for c in columns] for r in rows)]
    widths = [max(len(row[i]) for row in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(row, widths, strict=True)).rstrip() for row in cells)


# data


def data_hash(spark: SparkSession, cfg: Settings, args) -> str:
    return json.dumps(dataset_hashes(spark, args.path), indent=2, sort_keys=True)


def data_version(spark: SparkSession, cfg: Settings, args) -> str:
    made = snapshot(spark, args.path, args.name, cfg.data.store_root)
    return "\n".join([f"stored {made['name']} as {made['version_id']}", *(f"  {k}: {made[k]}" for k in ("bytes_hash", "logical_hash", "row_count"))])


def data_list(spark: SparkSession, cfg: Settings, args) -> str:
    rows = [r.asDict() for r in list_manifests(spark, cfg.data.store_root, args.name).collect()]
    return table(rows, ["name", "version_id", "row_count", "bytes_hash", "created_at"]) if rows else "no datasets"


# training and search


def shown(trial: dict, metric: str) -> list[str]:
    value = "none" if trial["value"] is None else f"{trial['value']:.6f}"
    return [f"value ({metric}): {value}", f"trial: {trial['trial_number']}", f"params: {canonical_json(trial['params'])}"]


def train(spark: SparkSession, cfg: Settings, args) -> str:
    made = workflow.train(spark, cfg, args.problem, args.study)
    return "\n".join([f"study: {made['study_name']}", f"log: {cfg.runs.log_root}", *shown(made, cfg.training.metric), f"entropy_hex: {made['attrs']['entropy_hex']}"])


def tune_start(spark: SparkSession, cfg: Settings, args) -> str:
    name = args.name or study_name(cfg.runs.study_name_template, args.problem, args.study)
    workflow.tune(spark, cfg, name, args.n_trials)
    return tune_report(spark, cfg, name)


def tune_resume(spark: SparkSession, cfg: Settings, args) -> str:
    workflow.existing(Trials(spark, cfg.runs.log_root), args.name)
    workflow.tune(spark, cfg, args.name, args.n_trials)
    return tune_report(spark, cfg, args.name)


def tune_report(spark: SparkSession, cfg: Settings, name: str, attrs: bool = False) -> str:
    found = workflow.status(spark, cfg, name)
    states = found["states"]
    lines = [f"study: {name}", f"trials: {sum(states.values())}  " + "  ".join(f"{k.lower()}: {v}" for k, v in sorted(states.items()))]
    if found["best"]:
        lines += ["best " + line if i == 0 else line for i, line in enumerate(shown(found["best"], cfg.training.metric))]
        lines += [f"  {k}: {v}" for k, v in sorted(found["best"]["attrs"].items())] if attrs else []
    return "\n".join(lines)


def tune_status(spark: SparkSession, cfg: Settings, args) -> str:
    return tune_report(spark, cfg, args.name, True)


def tune_retry(spark: SparkSession, cfg: Settings, args) -> str:
    new = workflow.retry(spark, cfg, args.name, args.number)
    return f"retried trial {args.number} as trial {new}"


# runs


def runs_list(spark: SparkSession, cfg: Settings, args) -> str:
    rows = list_runs([Trials(spark, cfg.runs.log_root).frame(args.of_study, args.of_problem)]).orderBy("study_name", "trial_number").collect()
    return table([r.asDict() for r in rows], ["study_name", "trial_number", "state", "value"]) if rows else "no trials"


def runs_show(spark: SparkSession, cfg: Settings, args) -> str:
    trials = Trials(spark, cfg.runs.log_root)
    trial = trials.load(args.of_study, args.number)
    lines = [f"study: {trial['study_name']}", f"trial: {trial['trial_number']}", f"state: {trial['state']}", f"value: {trial['value']}", "params:", *(f"  {k}: {v}" for k, v in sorted(trial["params"].items()))]
    try:
        lines += ["provenance:", *(f"  {k}: {v}" for k, v in sorted(Provenance.read(trial["attrs"]).attrs().items()))]
    except ProvenanceError as e:
        lines += [f"provenance: not whole ({e})"]
    found = Artifacts(spark, cfg.runs.artifacts_root).of_trial(trials, args.of_study, args.number)
    return "\n".join(lines + (["artifacts:", *(f"  {a['filename']} ({a['artifact_id']})" for a in found)] if found else []))


def runs_compare(spark: SparkSession, cfg: Settings, args) -> str:
    trials = Trials(spark, cfg.runs.log_root)
    for n in args.numbers:
        trials.load(args.of_study, n)
    wide = compare_runs(trials.frame(args.of_study).where(f"trial_number IN ({', '.join(map(str, args.numbers))})"), layers=LAYERS)
    return table([r.asDict() for r in wide.orderBy("trial_number").collect()], wide.columns)


# registry


def registry(spark: SparkSession, cfg: Settings) -> Registry:
    return Registry(spark, cfg.registry.root, cfg.registry.version_format)


def registry_promote(spark: SparkSession, cfg: Settings, args) -> str:
    version = workflow.promote(spark, cfg, args.of_problem, args.of_study, args.trial)
    return f"promoted {args.of_problem} {version}\n  from: study {args.of_study}, trial {args.trial}"


def registry_list(spark: SparkSession, cfg: Settings, args) -> str:
    kept, lines = registry(spark, cfg), []
    for problem in kept.problems():
        try:
            champion = kept.champion_record(problem)
            crowned = f"{champion['version']} (trial {champion['trial']} of {champion['study']}, {champion['promoted_at']})"
        except FileNotFoundError:
            crowned = "none"
        lines += [problem, f"  champion: {crowned}", *(f"  {v}" for v in kept.versions(problem))]
    return "\n".join(lines) or "no problems"


def registry_score(spark: SparkSession, cfg: Settings, args) -> str:
    return json.dumps(workflow.score_holdout(spark, cfg, args.of_problem, args.of_version, args.output), indent=2, sort_keys=True)


def registry_rollback(spark: SparkSession, cfg: Settings, args) -> str:
    registry(spark, cfg).rollback(args.of_problem, args.of_version)
    return f"champion of {args.of_problem}: {args.of_version}"


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foldwright", description="Tabular machine-learning workflows on Spark.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--config", help="base settings file (TOML)")
    top.add_argument("--problem", help="problem layer: a file below --problems-dir")
    top.add_argument("--study", help="study layer: a file below --studies-dir")
    top.add_argument("--problems-dir", default="configs/problems")
    top.add_argument("--studies-dir", default="configs/studies")
    top.add_argument("--set", action="append", default=[], metavar="PATH=VALUE", help="a setting over all layers; may be repeated")
    top.add_argument("--dry-run", action="store_true", help="print the settings and stop")
    groups = top.add_subparsers(required=True, metavar="VERB")

    def verb(of, name: str, run: Callable, said: str, *arguments: tuple) -> None:
        made = of.add_parser(name, help=said, description=said)
        for names, options in arguments:
            made.add_argument(*names, **options)
        made.set_defaults(run=run)

    def group(name: str, said: str):
        return groups.add_parser(name, help=said, description=said).add_subparsers(required=True, metavar="VERB")

    def arg(*names: str, **options) -> tuple:
        return names, options

    of_study, of_problem = arg("--study", dest="of_study", required=True), arg("--problem", dest="of_problem", required=True)
    n_trials = arg("-n", "--n-trials", type=positive, help="by default tuning.n_trials")
    data = group("data", "Hash, store and list datasets.")
    verb(data, "hash", data_hash, "Print the hashes of a Parquet dataset.", arg("path"))
    verb(data, "version", data_version, "Store a dataset by its content, with a manifest.", arg("name"), arg("path"))
    verb(data, "list", data_list, "List stored datasets.", arg("--name"))
    verb(groups, "train", train, "Fit once, score on the validation rows and record the run.")
    tune = group("tune", "Search hyperparameters.")
    verb(tune, "start", tune_start, "Create or load a study and run trials.", arg("name", nargs="?"), n_trials)
    verb(tune, "resume", tune_resume, "Run more trials of a study.", arg("name"), n_trials)
    verb(tune, "status", tune_status, "Show a study's trials by state and its best trial.", arg("name"))
    verb(tune, "retry-trial", tune_retry, "Run a trial's parameters again.", arg("name"), arg("number", type=int))
    runs = group("runs", "Look at recorded trials.")
    verb(runs, "list", runs_list, "List trials.", arg("--study", dest="of_study"), arg("--problem", dest="of_problem"))
    verb(runs, "show", runs_show, "Show a trial.", arg("number", type=int), of_study)
    verb(runs, "compare", runs_compare, "Compare trials.", arg("numbers", type=int, nargs="+"), of_study)
    kept = group("registry", "Promote, list, score and roll back models.")
    verb(kept, "promote", registry_promote, "Fit a trial again and make it the champion.", of_problem, of_study, arg("--trial", type=int, required=True))
    verb(kept, "list", registry_list, "List problems, champions and versions.")
    verb(kept, "score", registry_score, "Score a version on the withheld rows.", of_problem, arg("--version", dest="of_version"), arg("--output"))
    verb(kept, "rollback", registry_rollback, "Make an earlier version the champion.", of_problem, arg("--version", dest="of_version", required=True))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a verb; 0 if it ended well, USAGE if the settings or names it was given do not fit."""
    try:
        args = parser().parse_args(argv)
        cfg = load(args.config, args.problem, args.study, parse_overrides(args.set), args.problems_dir, args.studies_dir)
        if args.dry_run:
            print(json.dumps(to_tree(cfg), indent=2, sort_keys=True))
            return 0
        print(args.run(spark or session(cfg), cfg, args))
    except SystemExit as e:
        return int(e.code or 0)
    except (FileNotFoundError, KeyError, ValueError) as e:
        print(f"foldwright: {e.args[0] if isinstance(e, KeyError) and e.args else e}", file=sys.stderr)
        return USAGE
    return 0

import json
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from foldwright import queries
from foldwright.functions import hashing, metrics
from foldwright.operators.features import FeatureRouter, Features, out_of_fold, route
from foldwright.operators.registry import Registry
from foldwright.operators.runs import Trials
from foldwright.operators.training import ModelConfig, best_of, make_estimator
from foldwright.operators.tuning import Choice, Range, Task, draw, prunes, search, signed_rank_p, trial_seeds
from foldwright.plans import cv, order, splits
from foldwright.sources import parquet

SF = "/root/testdata/sf0.001"


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["kfold_shuffled", "stratified_assign", "walkforward_rolling", "group_kfold_assign", "cpcv_roles", "panel_cpcv_roles", "target_encode_oof", "logical_hash", "auc_midrank", "runs_compare", "best_trial"])
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(queries.ORACLE_SQL[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == cols
    want = sorted(tuple(norm(r[have.index(c)]) for c in cols) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_positions_in_ranges_equal_one_window(spark, monkeypatch):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 13).alias("k"))
    df = df.withColumn("k", F.when(F.col("id") % 50 != 0, F.col("k")))
    monkeypatch.setattr(order.ranged, "__defaults__", (90,))
    out, n = order.with_pos(df, [F.col("k"), F.col("id")])
    rows = sorted(out.collect(), key=lambda r: r.pos)
    assert n == 1000 and [r.pos for r in rows] == list(range(1000))
    keys = [(r.k is not None, r.k or 0, r.id) for r in rows]
    assert keys == sorted(keys)
    assert order.exact_median(df, "id") == 499.5


def test_panel_fixture(spark):
    rows = [(t, f"A{a}") for t in range(9) for a in range(3)]
    plan = cv.panel_combinatorial_purged(spark.createDataFrame(rows, "ts int, asset string"), "ts", "asset", 3, 2)
    sides = [{r.ts for r in plan.side(i, "train").select("ts").distinct().collect()} for i in range(plan.n_splits)]
    assert sides == [{6, 7, 8}, {3, 4, 5}, {0, 1, 2}]


def test_purge_and_embargo_zones(spark):
    plan = cv.combinatorial_purged(spark.range(100), ["id"], 5, 1, purge=3, embargo=4)
    train = {r.id for r in plan.side(2, "train").collect()}
    assert train == set(range(0, 37)) | set(range(67, 100))
    with pytest.raises(ValueError):
        cv.combinatorial_purged(spark.range(100), ["id"], 5, 1, purge=15, embargo=5)


def test_walk_forward_gap_and_errors(spark):
    plan = cv.walk_forward(spark.range(60), ["id"], 5, gap=2, max_train_size=6)
    assert [r.id for r in plan.side(0, "test").orderBy("id").collect()] == list(range(10, 20))
    assert [r.id for r in plan.side(1, "train").orderBy("id").collect()] == list(range(12, 18))
    with pytest.raises(ValueError):
        cv.walk_forward(spark.range(4), ["id"], 5)
    with pytest.raises(ValueError):
        plan.side(5, "test")


def test_embargo_units(spark):
    df = spark.range(50).select((F.col("id") * 3600).alias("ts"))
    assert cv.embargo_rows(df, "ts", "2h", unit="s") == 2
    assert cv.embargo_rows(df, "ts", 5) == 5 and cv.embargo_rows(df, "ts", None, 3) == 3
    with pytest.raises(ValueError):
        cv.embargo_rows(df, "ts", "2h")


def test_group_folds_never_part_a_group(spark):
    plan = cv.group_k_fold(spark.range(100).select((F.col("id") % 7).alias("g")), "g", 3)
    assert plan.frame.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        cv.group_k_fold(plan.frame, None)


def test_split_sizes_and_ratios(spark):
    out = splits.random_split(spark.range(101), ["id"], 3)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 15, "test": 16}
    assert splits.random_split(spark.range(0), ["id"], 3).count() == 0
    with pytest.raises(ValueError):
        splits.check_ratios({"train": 0.9, "val": 0.2, "test": 0.0})


def test_out_of_fold_does_not_leak(spark):
    # each category occurs twice with one target: a full fit would give it away
    df = spark.range(100).select("id", F.floor(F.col("id") / 2).cast("string").alias("c"), (F.floor(F.col("id") / 2) % 2).alias("y"))
    plan = cv.k_fold(df, ["id"], 5, seed=1)
    out = out_of_fold(df, ["c"], "y", plan)
    assert out.count() == 100 and out.where(F.abs(F.col("c") - F.col("y")) < 1e-6).count() == 0


def test_routing(spark):
    assert route({"a": 3, "b": 4}, ["a", "b"], 3) == {"a": "passthrough", "b": "encode"}
    with pytest.raises(ValueError):
        route({}, ["a"], None)
    df = spark.createDataFrame([(1, "x", 1.0), (2, None, 0.0)], "n int, c string, y double")
    assert FeatureRouter(Features(("n",), ("c",)), "y", 2).fit(df).routes == {"c": "passthrough"}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.score(df, "auc", "y", "p") == 0.875
    assert metrics.auc(df.where("y = 1"), "y", "p").first().auc is None
    assert metrics.fold_summary(spark.createDataFrame([(2.0,)], "score double")).first().metric_std == 0.0
    with pytest.raises(ValueError):
        metrics.metric_of("nope")


def test_logical_hash_ignores_layout_but_not_repeats(spark):
    df = spark.range(50).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("s"))
    h = lambda x: hashing.logical_hash(x).first().logical_hash
    assert h(df) == h(df.repartition(7).orderBy(F.desc("id")).select("s", "id"))
    assert h(df) != h(df.unionAll(df.limit(1)))


def test_snapshot_and_manifests(spark, tmp_path):
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/d")
    made = parquet.snapshot(spark, f"{tmp_path}/d", "tiny", f"{tmp_path}/store")
    again = parquet.snapshot(spark, f"{tmp_path}/d", "tiny", f"{tmp_path}/store")
    assert made["version_id"] == again["version_id"] and made["row_count"] == 10
    assert [r.version_id for r in parquet.list_manifests(spark, f"{tmp_path}/store", "tiny").collect()] == [made["version_id"]]
    assert len(parquet.parquet_files(spark, f"{tmp_path}/d")) == 2
    assert sum(x.count() for x, _ in parquet.file_batches(spark, f"{tmp_path}/d", "id")) == 10
    assert parquet.list_manifests(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(FileNotFoundError):
        parquet.parquet_files(spark, f"{tmp_path}/none")


def test_seeds_samplers_and_pruners():
    assert trial_seeds(42, 0).entropy_hex == "4323988864d84a1fdff6ed7da001c6a4"
    assert trial_seeds(42, 0) != trial_seeds(42, 1)
    space = {"x": Range(0.0, 1.0), "n": Range(1, 64, log=True, whole=True), "c": Choice(("a", "b"))}
    seen = []
    for i in range(60):
        p = draw("tpe", space, seen, i, n_startup=10)
        seen.append((p, (p["x"] - 0.3) ** 2 + (p["c"] == "b")))
    assert sum(v for _, v in seen[-15:]) < sum(v for _, v in seen[:15])
    assert signed_rank_p([1.0, 2.0, 3.0, 4.0]) == 1 / 16
    assert prunes("median", [9.0], [[1.0]] * 5, maximize=False) and not prunes("none", [9.0], [[1.0]] * 5, maximize=False)
    with pytest.raises(ValueError):
        draw("nope", space, [], 0)
    assert best_of([3, 2, 2.5, 2.6, 1], 2) == 1
    with pytest.raises(ImportError):
        make_estimator(ModelConfig("lightgbm"), "auc")


def test_search_promote_score_and_rollback(spark, tmp_path):
    df = spark.range(240).select("id", (F.col("id") % 17).cast("double").alias("x"), F.concat(F.lit("g"), F.col("id") % 6).alias("g"))
    df = df.withColumn("y", (F.col("x") > 8).cast("int"))
    rows = splits.random_split(df, ["id"], 1).drop("pos")
    sides = splits.parts(rows)
    task = Task(Features(("x",), ("g",)), "y", "auc", ("id",), threshold=4)
    plan = cv.k_fold(splits.tuning_rows(rows).drop("split"), ["id"], 2, seed=1)
    trials = Trials(spark, f"{tmp_path}/log")
    base = ModelConfig(n_estimators=3, early_stopping_rounds=2)
    out = search(plan, task, {"max_depth": Range(2, 3, whole=True)}, trials, "p_s", 1, base, sampler="random")
    best = metrics.best_trial(out, True).first()
    assert best.value > 0.9
    registry = Registry(spark, f"{tmp_path}/registry")
    trial = trials.load("p_s", best.trial_number)
    v1 = registry.promote("p", trial, sides["train"], sides["val"], task, base, today="2020_01_01")
    v2 = registry.promote("p", trial, sides["train"], sides["val"], task, replace(base, n_estimators=2), today="2020_01_02")
    assert registry.champion("p") == v2 and registry.versions("p") == [v2, v1]
    registry.rollback("p", v1)
    receipt = registry.score_holdout("p", sides["test"], "id")
    assert receipt["version"] == v1 and receipt["score"] > 0.9 and receipt["n_rows"] == sides["test"].count()
    assert json.loads(spark.read.text(f"{tmp_path}/registry/p/holdout/{v1}/receipt").first().value)["version"] == v1
    with pytest.raises(FileNotFoundError):
        registry.rollback("p", "v_none")
    with pytest.raises(ValueError):
        registry.promote("p", trial | {"state": "PRUNED"}, sides["train"], sides["val"], task, base)
    with pytest.raises(KeyError):
        trials.load("p_s", 99)


def test_interrupted_trial_is_no_best(spark, tmp_path):
    df = spark.range(30).select("id", F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    plan = cv.k_fold(df, ["id"], 3, seed=1)
    trials = Trials(spark, f"{tmp_path}/log")

    def stopped(plan, i, *_):
        if i:
            raise KeyboardInterrupt
        return 0.99, 1

    with pytest.raises(KeyboardInterrupt):
        search(plan, Task(Features(("x",), ()), "y", "auc", ("id",)), {"max_depth": Range(2, 3, whole=True)}, trials, "s", 1, objective=stopped, sampler="random")
    assert trials.load("s", 0)["state"] == "FAIL"


def greedy(sizes, k):
    loads, out = [0] * k, []
    for s in sorted(sizes, reverse=True):
        i = loads.index(min(loads))
        loads[i] += s
        out.append(i)
    return out


def test_turns_equal_the_greedy_rule():
    import random

    rng = random.Random(1)
    for case in range(300):
        k = rng.randrange(2, 7)
        sizes = sorted((rng.choice([1, 1, 2, 3, 7, 50, 1000]) for _ in range(rng.randrange(1, 80))), reverse=True)
        runs = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        stretches = cv.dealt_runs(runs, k)
        ends = [at for _, at, _ in stretches[1:]] + [len(sizes)]
        got = [turn[(p - at) % len(turn)] for (_, at, turn), end in zip(stretches, ends, strict=True) for p in range(at, end)]
        assert got == greedy(sizes, k), case
        assert len(stretches) <= k * len(runs)
    assert cv.dealt_runs([(10**9, 1), (1, 10**9)], 5) == [(10**9, 0, [0, 1, 2, 3, 4]), (1, 1, [1, 2, 3, 4])]


def test_group_folds_equal_the_greedy_rule(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 31 != 0, F.floor(F.sqrt(F.col("id")) * F.col("id") % 97)).alias("g"))
    plan = cv.group_k_fold(df, "g", 4)
    rows = plan.frame.groupBy("g").agg(F.count("*").alias("n"), F.max("fold").alias("fold")).collect()
    rows.sort(key=lambda r: (-r.n, r.g is not None, r.g or 0))
    assert [r.fold for r in rows] == greedy([r.n for r in rows], 4) and sum(r.n for r in rows) == 4000


def test_median_of_ties(spark, monkeypatch):
    monkeypatch.setattr(order.ranged, "__defaults__", (50,))
    for values, want in (([1] * 500 + [2] * 499, 1), ([1] * 500 + [4] * 500, 2.5), ([None, 7], 7), ([], None), ([None], None), (list(range(301)), 150)):
        assert order.exact_median(spark.createDataFrame([(v,) for v in values], "v long"), "v") == want


def test_row_hashes_do_not_depend_on_the_time_zone(spark):
    df = spark.range(3).select(F.timestamp_seconds(F.col("id") * 86400).alias("t"), "id")
    hashes = []
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            hashes.append(hashing.logical_hash(df).first().logical_hash)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert hashes[0] == hashes[1]

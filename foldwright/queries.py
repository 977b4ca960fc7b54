"""The registered queries of the tabular operators, and DuckDB SQL for their rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, metrics
from .operators import features, runs, training
from .plans import cv, splits
from .plans.order import md5_key, with_pos
from .sources.parquet import chunks

SEED = 7
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _t(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def _orders(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return _t(spark, sf_dir, "orders", "o_orderkey", *cols)


def _events(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return _t(spark, sf_dir, "events", "event_id", "ts", *cols)


def _lines(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem", *LINE_KEY, "l_shipdate", *cols)


# splits


def split_random_rows(spark, sf_dir):
    return splits.random_split(_orders(spark, sf_dir), ["o_orderkey"], SEED).select("o_orderkey", "pos", "split")


def split_random_counts(spark, sf_dir):
    return split_random_rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


def split_temporal_rows(spark, sf_dir):
    return splits.temporal_split(_events(spark, sf_dir), "ts", ["event_id"]).select("event_id", "pos", "split")


def split_temporal_bounds(spark, sf_dir):
    rows = splits.temporal_split(_events(spark, sf_dir), "ts", ["event_id"])
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def tuning_substrate(spark, sf_dir):
    return splits.tuning_rows(split_random_rows(spark, sf_dir)).select("o_orderkey")


def inner_validation(spark, sf_dir):
    return splits.inner_validation(_events(spark, sf_dir), 0.2, [F.col("ts"), F.col("event_id")]).select("event_id", "inner")


def chunk_assign(spark, sf_dir):
    return chunks(_lines(spark, sf_dir), [F.col(c) for c in LINE_KEY], 4).select(*LINE_KEY, "chunk")


# cross-validation


def kfold_assign(spark, sf_dir):
    return cv.k_fold(_orders(spark, sf_dir), ["o_orderkey"], 7, shuffle=False).frame.select("o_orderkey", "fold")


def kfold_shuffled(spark, sf_dir):
    return cv.k_fold(_orders(spark, sf_dir), ["o_orderkey"], 7, seed=SEED).frame.select("o_orderkey", "fold")


def stratified_assign(spark, sf_dir):
    return cv.stratified_k_fold(_orders(spark, sf_dir, "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 5, seed=SEED).frame.select("o_orderkey", "o_orderstatus", "fold")


def stratified_balance(spark, sf_dir):
    plan = cv.stratified_k_fold(_orders(spark, sf_dir, "o_orderpriority"), "o_orderpriority", ["o_orderkey"], 4, seed=SEED)
    return plan.frame.groupBy("o_orderpriority", "fold").agg(F.count("*").alias("n"))


def _walk(spark, sf_dir, **options):
    return cv.walk_forward(_events(spark, sf_dir), ["ts", "event_id"], 5, time="ts", **options).roles().select("split_id", "event_id", "role")


def walkforward_expanding(spark, sf_dir):
    return _walk(spark, sf_dir)


def walkforward_rolling(spark, sf_dir):
    return _walk(spark, sf_dir, max_train_size=300, gap=10)


def walkforward_embargo(spark, sf_dir):
    return _walk(spark, sf_dir, embargo="3h")


def group_kfold_assign(spark, sf_dir):
    plan = cv.group_k_fold(_t(spark, sf_dir, "events", "user_id"), "user_id", 5)
    return plan.frame.groupBy("user_id", "fold").agg(F.count("*").alias("n"))


def group_kfold_overlap(spark, sf_dir):
    plan = cv.group_k_fold(_t(spark, sf_dir, "lineitem", "l_suppkey"), "l_suppkey", 4)
    per = plan.frame.groupBy("l_suppkey").agg(F.count_distinct("fold").alias("folds"))
    return per.agg(F.count(F.when(F.col("folds") > 1, 1)).alias("violations"), F.count("*").alias("supp_groups"))


def cpcv_roles(spark, sf_dir):
    plan = cv.combinatorial_purged(_events(spark, sf_dir), ["ts", "event_id"], 6, 2, purge=10, embargo=5)
    return plan.roles().groupBy("split_id", "role").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


def _panel(spark, sf_dir, *cols):
    return cv.panel_combinatorial_purged(_lines(spark, sf_dir, *cols), "l_shipdate", "l_suppkey", 5, 2, target_horizon_bars=3, embargo_pct=0.01)


def _panel_times(spark, sf_dir, *sums):
    """Roles of the panel's times, each with its number of rows and sums over them."""
    plan = _panel(spark, sf_dir, "l_quantity")
    return plan.roles(plan.frame.groupBy("l_shipdate", "pos", "fold").agg(F.count("*").alias("rows"), *sums))


def panel_cpcv_roles(spark, sf_dir):
    return _panel_times(spark, sf_dir).groupBy("split_id", "role").agg(F.sum("rows").alias("n"), F.count_distinct("pos").alias("times"), F.sum(F.col("pos") * F.col("rows")).alias("pos_sum"))


def panel_timestamp_overlap(spark, sf_dir):
    roles = _panel_times(spark, sf_dir).groupBy("split_id", "l_shipdate").agg(F.count_distinct("role").alias("roles"))
    return roles.groupBy("split_id").agg(F.count(F.when(F.col("roles") > 1, 1)).alias("violations"))


def panel_mean_rmse(spark, sf_dir):
    """Each split's train mean as the prediction of its test rows, from sums by time.

    Squares are summed around the mean of the time they belong to, so none of the terms is a small difference of large ones.
    """
    q = F.col("l_quantity")
    rows = _panel_times(spark, sf_dir, F.sum(q).alias("total"), F.avg(q).alias("mean"), F.var_pop(q).alias("var"))
    is_train, is_test, n = F.col("role") == "train", F.col("role") == "test", F.col("rows")
    mean = (F.sum(F.when(is_train, F.col("total"))) / F.sum(F.when(is_train, n))).alias("m")
    split = rows.groupBy("split_id").agg(mean)
    tests = rows.where(is_test).join(F.broadcast(split), "split_id")  # a row a split
    error = n * (F.col("var") + (F.col("mean") - F.col("m")) * (F.col("mean") - F.col("m")))
    return tests.groupBy("split_id").agg(F.sum("rows").alias("n_test"), F.round(F.sqrt(F.sum(error) / F.sum("rows")), 6).alias("rmse"))


def panel_rmse_summary(spark, sf_dir):
    out = metrics.fold_summary(panel_mean_rmse(spark, sf_dir), "rmse")
    return out.select(F.round("metric_mean", 6).alias("metric_mean"), F.round("metric_std", 6).alias("metric_std"), "n_folds")


# features


def cardinalities(spark, sf_dir):
    return features.cardinalities(_t(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size", "p_name"])


def encoder_routing(spark, sf_dir):
    return features.routes(_t(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size", "p_name"], 30)


def select_features(spark, sf_dir):
    spec = features.Features(("l_quantity", "l_discount"), ("l_returnflag", "l_suppkey"))
    return features.select_features(_t(spark, sf_dir, "lineitem"), spec, "l_tax")


def _priced(spark, sf_dir):
    return _orders(spark, sf_dir, "o_orderpriority", "o_custkey", "o_totalprice")


def target_encode_full(spark, sf_dir):
    df = _priced(spark, sf_dir)
    out = features.TargetEncoder(["o_orderpriority", "o_custkey"], "o_totalprice").fit(df).transform(df)
    return out.select("o_orderkey", F.round("o_orderpriority", 4).alias("priority_enc"), F.round("o_custkey", 4).alias("cust_enc"))


def target_encode_oof(spark, sf_dir):
    df = _priced(spark, sf_dir)
    out = features.out_of_fold(df, ["o_custkey"], "o_totalprice", cv.k_fold(df, ["o_orderkey"], 5, seed=SEED))
    return out.select("o_orderkey", "fold", F.round("o_custkey", 4).alias("cust_enc"))


# hashes and metrics


def logical_hash(spark, sf_dir):
    return hashing.logical_hash(_t(spark, sf_dir, "orders"))


def _scored(spark, sf_dir):
    """Events as predictions: the target is whether the id is divisible by 3, the score follows from the value."""
    p = F.round(F.col("value") / (1 + F.abs(F.col("value"))) / 2 + 0.5, 2)
    return _t(spark, sf_dir, "events").select((F.col("event_id") % 3 == 0).cast("int").alias("y"), p.alias("p"), (F.col("event_id") % 5).alias("fold"))


def auc_midrank(spark, sf_dir):
    return metrics.auc(_scored(spark, sf_dir), "y", "p").select(F.round("auc", 9).alias("auc"))


def point_metrics(spark, sf_dir):
    df = _scored(spark, sf_dir)
    return df.agg(*(F.round(f("y", "p"), 9).alias(f.__name__) for f in (metrics.logloss, metrics.rmse, metrics.mae)))


def fold_metric_summary(spark, sf_dir):
    folds = _scored(spark, sf_dir).groupBy("fold").agg(metrics.rmse("y", "p").alias("score"))
    return metrics.fold_summary(folds).select(F.round("metric_mean", 9).alias("metric_mean"), F.round("metric_std", 9).alias("metric_std"), "n_folds")


def holdout_stats(spark, sf_dir):
    test = splits.temporal_split(_events(spark, sf_dir), "ts", ["event_id"]).where("split = 'test'")
    return metrics.holdout_stats(test, "event_id")


# runs and models


def holdout_times(spark, sf_dir):
    """Statistics of the test rows by their time, through the dispatcher of splits."""
    test = splits.split(_events(spark, sf_dir), "time_ordered", ["event_id"], time="ts").where("split = 'test'")
    return metrics.holdout_stats(test, "ts")


def plan_sizes(spark, sf_dir):
    """Rows of every split and side of a plan that the factory makes."""
    plan = cv.make_plan(_events(spark, sf_dir), "cpcv", ["event_id"], time="ts", n_folds=5, n_test_folds=2, target_horizon_bars=4, embargo_pct=0.01)
    return plan.roles().groupBy("split_id", "role").agg(F.count("*").alias("n"))


def _trials(spark, sf_dir):
    """Orders as a log of trials: a study a customer group, a trial an order."""
    df = _orders(spark, sf_dir, "o_custkey", "o_orderstatus", "o_totalprice")
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "PRUNED").otherwise("FAIL")
    params = F.create_map(F.lit("depth"), (F.col("o_orderkey") % 9).cast("string"), F.lit("rate"), (F.col("o_custkey") % 4).cast("string"))
    attrs = F.create_map(F.lit("metric"), F.lit("rmse"))
    return df.select(F.concat(F.lit("study_"), (F.col("o_custkey") % 8).cast("string")).alias("study_name"), F.col("o_orderkey").cast("int").alias("trial_number"), state.alias("state"), F.col("o_totalprice").alias("value"), params.alias("params"), attrs.alias("attrs"))


def runs_union(spark, sf_dir):
    t = _trials(spark, sf_dir).select("study_name", "trial_number", "state", "value")
    return runs.list_runs([t.where("study_name = 'study_1'").drop("value"), t.where("study_name <> 'study_1'")])


def runs_compare(spark, sf_dir):
    out = runs.compare_runs(_trials(spark, sf_dir), ["depth", "rate"])
    return out.select("study_name", "trial_number", "state", "value", "params_depth", "params_rate", "attrs_metric")


def state_counts(spark, sf_dir):
    return metrics.state_counts(_trials(spark, sf_dir))


def best_trial(spark, sf_dir):
    return metrics.best_trial(_trials(spark, sf_dir), maximize=False)


def trial_summaries(spark, sf_dir):
    """Customers as trials with their orders as folds: mean, deviation and number of the scores of each."""
    df = _orders(spark, sf_dir, "o_custkey", "o_totalprice")
    trials = df.groupBy(F.concat(F.lit("study_"), (F.col("o_custkey") % 8).cast("string")).alias("study_name"), F.col("o_custkey").cast("int").alias("trial_number")).agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda x: x["o_totalprice"]).alias("scores"))
    out = metrics.fold_summary(runs.fold_artifact(trials), "score", "study_name", "trial_number")
    return out.select("study_name", "trial_number", F.round("metric_mean", 6).alias("metric_mean"), F.round("metric_std", 6).alias("metric_std"), "n_folds")


def latest_states(spark, sf_dir):
    """Events as the log of trials, a trial a user: the state that counts is the last one."""
    log = _events(spark, sf_dir, "user_id", "event_type").select(F.lit("s").alias("study_name"), F.col("user_id").cast("int").alias("trial_number"), F.col("event_type").alias("state"), F.col("event_id").alias("at"))
    return runs.latest(log)


def routed_features(spark, sf_dir):
    """Columns of few values as they are, the others by the mean of their category."""
    df = _orders(spark, sf_dir, "o_orderpriority", "o_orderstatus", "o_totalprice")
    router = features.FeatureRouter(features.Features((), ("o_orderstatus", "o_orderpriority")), "o_totalprice", 4, False).fit(df)
    return router.transform(df).select("o_orderkey", "o_orderstatus", F.round("o_orderpriority", 4).alias("priority_enc"))


def gbt_holdout(spark, sf_dir):
    """A small boosted model of the order price: the rows of the test side with their predictions."""
    df = splits.random_split(_priced(spark, sf_dir), ["o_orderkey"], SEED).persist()
    sides = {k: v.drop("pos") for k, v in splits.parts(df).items()}
    router = features.FeatureRouter(features.Features(("o_custkey",), ("o_orderpriority",)), "o_totalprice", 10, False).fit(sides["train"])
    cfg = training.ModelConfig(max_depth=3, n_estimators=4, early_stopping_rounds=2)
    model = training.fit(router.transform(sides["train"]), router.features, "o_totalprice", cfg, "rmse", SEED, router.transform(sides["val"]))
    return model.predict(router.transform(sides["test"]), "o_totalprice").select("o_orderkey", "o_totalprice", "prediction")


_NAMES = """split_random_rows split_random_counts split_temporal_rows split_temporal_bounds tuning_substrate inner_validation chunk_assign
kfold_assign kfold_shuffled stratified_assign stratified_balance walkforward_expanding walkforward_rolling walkforward_embargo
group_kfold_assign group_kfold_overlap cpcv_roles panel_cpcv_roles panel_timestamp_overlap panel_mean_rmse panel_rmse_summary
cardinalities encoder_routing select_features target_encode_full target_encode_oof logical_hash auc_midrank point_metrics
fold_metric_summary holdout_stats holdout_times plan_sizes runs_union runs_compare state_counts best_trial trial_summaries latest_states routed_features gbt_holdout""".split()

QUERIES = {name: globals()[name] for name in _NAMES}

# SQL

_MD5 = "md5('7|' || o_orderkey)"
_RANDOM = f"SELECT o_orderkey, row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders"
_EVENTS = "SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events"
_ROLE = "CASE WHEN pos < floor(n * 0.7) THEN 'train' WHEN pos < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END"
_FOLD7 = "CAST(CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT)"


def _stratified(y: str, k: int) -> str:
    """Deal the rows sorted by class round-robin, count each class in each fold, then hand out in order of the permutation."""
    return f"""
  s AS (SELECT o_orderkey, {y}, row_number() OVER (ORDER BY {y}) - 1 AS r, row_number() OVER (PARTITION BY {y} ORDER BY {_MD5}, o_orderkey) - 1 AS q FROM orders),
  alloc AS (SELECT {y}, r % {k} AS fold, count(*) AS n FROM s GROUP BY ALL),
  upto AS (SELECT {y}, fold, sum(n) OVER (PARTITION BY {y} ORDER BY fold) AS hi, n FROM alloc),
  dealt AS (SELECT s.o_orderkey, s.{y}, CAST(u.fold AS INT) AS fold FROM s JOIN upto u ON s.{y} = u.{y} AND s.q >= u.hi - u.n AND s.q < u.hi)"""


def _grouped(table: str, key: str, k: int) -> str:
    """One group after the other, largest first, into the lightest fold."""
    return f"""
WITH RECURSIVE g AS (SELECT {key}, count(*) AS n FROM {table} GROUP BY {key}),
o AS (SELECT {key}, n, row_number() OVER (ORDER BY n DESC, {key}) AS i FROM g),
r(i, {key}, n, fold, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INT), [CAST(0 AS BIGINT){", 0" * (k - 1)}]
  UNION ALL
  SELECT o.i, o.{key}, o.n, CAST(list_position(loads, list_min(loads)) - 1 AS INT), list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + o.n ELSE x END)
  FROM r JOIN o ON o.i = r.i + 1)"""


def _walk_sql(gap: str, longest: str = "NULL") -> str:
    return f"""
WITH e AS ({_EVENTS}), i AS (SELECT unnest(range(5)) AS split_id), g AS (SELECT {gap} AS gap),
b AS (SELECT split_id, event_id, pos, n - (5 - split_id) * (n // 6) AS start, n // 6 AS len, gap FROM e, i, g)
SELECT CAST(split_id AS INT) AS split_id, event_id, role FROM (
  SELECT *, CASE WHEN pos >= start AND pos < start + len THEN 'test'
    WHEN pos < start - gap AND pos >= coalesce(start - gap - {longest}, 0) THEN 'train' END AS role FROM b) WHERE role IS NOT NULL"""


def _purged(places: str, n_folds: int, purge: str, embargo: str) -> str:
    """Roles of every place by distance to the places of test folds, pair by pair of folds."""
    pairs = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(combinations(range(n_folds), 2)))
    side = lambda f: f"(SELECT split_id, {f} * (n // {n_folds}) AS s, CASE WHEN {f} = {n_folds - 1} THEN n ELSE ({f} + 1) * (n // {n_folds}) END AS e FROM picks, total)"
    return f"""places AS ({places}), total AS (SELECT count(*) AS n FROM places), knobs AS (SELECT {purge} AS purge, {embargo} AS embargo FROM total),
picks(split_id, a, b) AS (VALUES {pairs}), sides AS (SELECT * FROM {side("a")} UNION ALL SELECT * FROM {side("b")}),
near AS (SELECT split_id, pos, max(CASE WHEN pos >= s AND pos < e THEN 2 WHEN pos >= s - purge AND pos < e + purge + embargo THEN 1 ELSE 0 END) AS k FROM places, sides, knobs GROUP BY ALL),
roles AS (SELECT split_id, pos, CASE k WHEN 2 THEN 'test' WHEN 0 THEN 'train' END AS role FROM near WHERE k <> 1)"""


_PANEL = "WITH " + _purged("SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate) - 1 AS pos FROM (SELECT DISTINCT l_shipdate FROM lineitem)", 5, "3", "floor(n * 0.01)") + ", panel AS (SELECT r.split_id, r.pos, r.role, l.* FROM roles r JOIN places USING (pos) JOIN lineitem l USING (l_shipdate))"
_PANEL_RMSE = _PANEL + """, m AS (SELECT split_id, avg(l_quantity) AS m FROM panel WHERE role = 'train' GROUP BY split_id),
folds AS (SELECT CAST(split_id AS INT) AS split_id, count(*) AS n_test, round(sqrt(avg((l_quantity - m) * (l_quantity - m))), 6) AS rmse FROM panel JOIN m USING (split_id) WHERE role = 'test' GROUP BY ALL)"""
_SMOOTH = "(1 / (1 + exp(-(n - 20) / 10.0)))"
_SCORED = "WITH s AS (SELECT CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS y, round(value / (1 + abs(value)) / 2 + 0.5, 2) AS p, event_id % 5 AS fold FROM events)"
_CARD = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS cardinality FROM (SELECT DISTINCT {c} FROM part)" for c in ("p_brand", "p_type", "p_size", "p_name"))
_TRIALS = "t AS (SELECT 'study_' || (o_custkey % 8) AS study_name, CAST(o_orderkey AS INT) AS trial_number, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PRUNED' ELSE 'FAIL' END AS state, o_totalprice AS value, o_orderkey, o_custkey FROM orders)"

ORACLE_SQL = {
    "split_random_rows": f"SELECT o_orderkey, pos, {_ROLE} AS split FROM ({_RANDOM})",
    "split_random_counts": f"SELECT {_ROLE} AS split, count(*) AS n FROM ({_RANDOM}) GROUP BY 1",
    "split_temporal_rows": f"SELECT event_id, pos, {_ROLE} AS split FROM ({_EVENTS})",
    "split_temporal_bounds": f"SELECT {_ROLE} AS split, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM ({_EVENTS}) GROUP BY 1",
    "tuning_substrate": f"SELECT o_orderkey FROM ({_RANDOM}) WHERE {_ROLE} <> 'test'",
    "inner_validation": f"SELECT event_id, CASE WHEN pos >= n - round(n * 0.2) THEN 'val' ELSE 'train' END AS \"inner\" FROM ({_EVENTS})",
    "chunk_assign": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST((row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // ((SELECT count(*) + 3 FROM lineitem) // 4) AS INT) AS chunk FROM lineitem",
    "kfold_assign": f"SELECT o_orderkey, {_FOLD7} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)",
    "kfold_shuffled": f"SELECT o_orderkey, {_FOLD7} AS fold FROM ({_RANDOM})",
    "stratified_assign": f"WITH {_stratified('o_orderstatus', 5)} SELECT * FROM dealt",
    "stratified_balance": f"WITH {_stratified('o_orderpriority', 4)} SELECT o_orderpriority, fold, count(*) AS n FROM dealt GROUP BY ALL",
    "walkforward_expanding": _walk_sql("0"),
    "walkforward_rolling": _walk_sql("10", "300"),
    "walkforward_embargo": _walk_sql("(SELECT ceil(ceil(10800000000.0 / floor(median(d))) * (SELECT count(*) FROM events) / (SELECT count(DISTINCT ts) FROM events)) FROM (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS d FROM (SELECT DISTINCT ts FROM events)) WHERE d IS NOT NULL)"),
    "group_kfold_assign": f"{_grouped('events', 'user_id', 5)} SELECT user_id, fold, n FROM r WHERE i > 0",
    "group_kfold_overlap": f"{_grouped('lineitem', 'l_suppkey', 4)} SELECT count(CASE WHEN folds > 1 THEN 1 END) AS violations, count(*) AS supp_groups FROM (SELECT l.l_suppkey, count(DISTINCT fold) AS folds FROM lineitem l JOIN r ON r.i > 0 AND r.l_suppkey = l.l_suppkey GROUP BY 1)",
    "cpcv_roles": f"WITH {_purged(_EVENTS, 6, '10', '5')} SELECT CAST(split_id AS INT) AS split_id, role, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM roles GROUP BY ALL",
    "panel_cpcv_roles": f"{_PANEL} SELECT CAST(split_id AS INT) AS split_id, role, count(*) AS n, count(DISTINCT pos) AS times, CAST(sum(pos) AS BIGINT) AS pos_sum FROM panel GROUP BY ALL",
    "panel_timestamp_overlap": f"{_PANEL} SELECT CAST(split_id AS INT) AS split_id, count(CASE WHEN n > 1 THEN 1 END) AS violations FROM (SELECT split_id, l_shipdate, count(DISTINCT role) AS n FROM panel GROUP BY ALL) GROUP BY split_id",
    "panel_mean_rmse": f"{_PANEL_RMSE} SELECT * FROM folds",
    "panel_rmse_summary": f"{_PANEL_RMSE} SELECT round(avg(rmse), 6) AS metric_mean, round(stddev_pop(rmse), 6) AS metric_std, count(*) AS n_folds FROM folds",
    "cardinalities": _CARD,
    "encoder_routing": f"SELECT \"column\", CASE WHEN cardinality <= 30 THEN 'passthrough' ELSE 'encode' END AS route FROM ({_CARD})",
    "select_features": "SELECT l_quantity, l_discount, l_returnflag, CAST(l_suppkey AS VARCHAR) AS l_suppkey, l_tax FROM lineitem",
    "target_encode_full": f"""
WITH g AS (SELECT avg(o_totalprice) AS prior FROM orders),
p AS (SELECT o_orderpriority, {_SMOOTH} * m + (1 - {_SMOOTH}) * prior AS enc FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), g),
c AS (SELECT o_custkey, {_SMOOTH} * m + (1 - {_SMOOTH}) * prior AS enc FROM (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), g)
SELECT o_orderkey, round(p.enc, 4) AS priority_enc, round(c.enc, 4) AS cust_enc FROM orders JOIN p USING (o_orderpriority) JOIN c USING (o_custkey)""",
    "target_encode_oof": f"""
WITH f AS (SELECT o_orderkey, CAST(CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INT) AS fold FROM ({_RANDOM})),
d AS (SELECT o.o_orderkey, o_custkey, o_totalprice, fold FROM orders o JOIN f USING (o_orderkey)),
k AS (SELECT unnest(range(5)) AS kf),
pr AS (SELECT kf, avg(o_totalprice) AS prior FROM d, k WHERE fold <> kf GROUP BY kf),
st AS (SELECT kf, o_custkey, count(*) AS n, avg(o_totalprice) AS m FROM d, k WHERE fold <> kf GROUP BY ALL)
SELECT o_orderkey, d.fold, round(coalesce({_SMOOTH} * m + (1 - {_SMOOTH}) * prior, prior), 4) AS cust_enc
FROM d JOIN pr ON pr.kf = d.fold LEFT JOIN st ON st.kf = d.fold AND st.o_custkey = d.o_custkey""",
    "logical_hash": """
WITH r AS (SELECT sha256('=' || o_custkey || chr(31) || '=' || o_orderdate || chr(31) || '=' || o_orderkey || chr(31) || '=' || o_orderpriority || chr(31) || '=' || o_orderstatus || chr(31) || '=' || o_totalprice) AS h FROM orders),
c AS (SELECT h, count(*) AS n FROM r GROUP BY h),
b AS (SELECT substring(h, 1, 4) AS b, sha256(string_agg(h || ':' || n, '' ORDER BY h || ':' || n)) AS d FROM c GROUP BY 1)
SELECT sha256(string_agg(b || d, '' ORDER BY b || d)) AS logical_hash FROM b""",
    "auc_midrank": f"""{_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM s), c AS (SELECT sum(y) AS pos, count(*) - sum(y) AS neg FROM s)
SELECT round((sum(CASE WHEN y = 1 THEN k END) - any_value(pos) * (any_value(pos) + 1) / 2.0) / (any_value(pos) * any_value(neg)), 9) AS auc FROM r, c""",
    "point_metrics": f"{_SCORED}, q AS (SELECT y, p, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS c FROM s) SELECT round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 9) AS logloss, round(sqrt(avg((y - p) * (y - p))), 9) AS rmse, round(avg(abs(y - p)), 9) AS mae FROM q",
    "fold_metric_summary": f"{_SCORED}, f AS (SELECT fold, sqrt(avg((y - p) * (y - p))) AS v FROM s GROUP BY fold) SELECT round(avg(v), 9) AS metric_mean, round(stddev_pop(v), 9) AS metric_std, count(*) AS n_folds FROM f",
    "holdout_stats": f"SELECT count(*) AS n_rows, CAST(min(event_id) AS VARCHAR) AS first_time, CAST(max(event_id) AS VARCHAR) AS last_time FROM ({_EVENTS}) WHERE {_ROLE} = 'test'",
    "holdout_times": f"SELECT count(*) AS n_rows, CAST(min(ts) AS VARCHAR) AS first_time, CAST(max(ts) AS VARCHAR) AS last_time FROM ({_EVENTS}) WHERE {_ROLE} = 'test'",
    "plan_sizes": f"WITH {_purged(_EVENTS, 5, '4', 'floor(n * 0.01)')} SELECT CAST(split_id AS INT) AS split_id, role, count(*) AS n FROM roles GROUP BY ALL",
    "runs_union": f"WITH {_TRIALS} SELECT study_name, trial_number, state, CASE WHEN study_name <> 'study_1' THEN value END AS value FROM t",
    "runs_compare": f"WITH {_TRIALS} SELECT study_name, trial_number, state, value, CAST(o_orderkey % 9 AS VARCHAR) AS params_depth, CAST(o_custkey % 4 AS VARCHAR) AS params_rate, 'rmse' AS attrs_metric FROM t",
    "trial_summaries": "SELECT 'study_' || (o_custkey % 8) AS study_name, CAST(o_custkey AS INT) AS trial_number, round(avg(o_totalprice), 6) AS metric_mean, round(stddev_pop(o_totalprice), 6) AS metric_std, count(*) AS n_folds FROM orders GROUP BY o_custkey",
    "latest_states": "SELECT 's' AS study_name, CAST(user_id AS INT) AS trial_number, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "routed_features": f"""
WITH g AS (SELECT avg(o_totalprice) AS prior FROM orders),
p AS (SELECT o_orderpriority, {_SMOOTH} * m + (1 - {_SMOOTH}) * prior AS enc FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), g)
SELECT o_orderkey, o_orderstatus, round(enc, 4) AS priority_enc FROM orders JOIN p USING (o_orderpriority)""",
    "state_counts": f"WITH {_TRIALS} SELECT state, count(*) AS trials FROM t GROUP BY state",
    "best_trial": f"WITH {_TRIALS} SELECT study_name, trial_number, value FROM t WHERE state = 'COMPLETE' QUALIFY row_number() OVER (PARTITION BY study_name ORDER BY value, trial_number) = 1",
}

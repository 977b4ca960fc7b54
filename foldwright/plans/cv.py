"""Cross-validation plans: every row gets a position or fold once; each side of each split is a predicate over it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import BROADCAST_ROWS, exact_median, md5_key, sized, with_pos

#: Microseconds of the units of durations and of integer times.
DURATION_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
TIME_UNITS = {"ns": Fraction(1, 1000), "us": Fraction(1), "ms": Fraction(1000), "s": Fraction(1_000_000)}


@dataclass(frozen=True)
class SplitPlan:
    """``frame`` holds the columns that the predicates ``train(i)`` and ``test(i)`` read; they are never null."""

    frame: DataFrame
    n_splits: int
    train: Callable[[int], Column]
    test: Callable[[int], Column]

    def side(self, i: int, role: str) -> DataFrame:
        if not 0 <= i < self.n_splits:
            raise ValueError(f"split {i} of {self.n_splits}")
        return self.frame.where({"train": self.train, "test": self.test}[role](i))

    def roles(self, frame: DataFrame | None = None) -> DataFrame:
        """One row a split, row and role ('train' or 'test'; neither: no row), in one pass over the frame.

        ``frame`` may be one that sums the plan's rows up by the columns that its sides hang on, ``pos`` and ``fold``: then
        the sums are multiplied by the splits, and not the rows.
        """
        frame = self.frame if frame is None else frame
        role = lambda i: F.when(self.test(i), "test").when(self.train(i), "train")
        every = F.array(*(F.struct(F.lit(i).alias("split_id"), role(i).alias("role")) for i in range(self.n_splits)))
        out = frame.withColumn("_role", F.explode(every))
        return out.select(*frame.columns, "_role.split_id", "_role.role").where("role IS NOT NULL")


def need(df: DataFrame, *cols: str | None) -> None:
    missing = [c for c in cols if c is None or c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _by_fold(frame: DataFrame, k: int) -> SplitPlan:
    return SplitPlan(frame, k, lambda i: F.col("fold") != i, lambda i: F.col("fold") == i)


def _enough(n: int, k: int) -> None:
    if k < 2 or n < k:
        raise ValueError(f"{k} folds of {n} rows")


def k_fold(df: DataFrame, keys: list[str], n_splits: int = 5, shuffle: bool = True, seed: int = 0) -> SplitPlan:
    """Folds of n div k rows, one more in the first n mod k, in order of ``keys`` or of a seeded permutation."""
    need(df, *keys)
    order = [md5_key(seed, *keys)] * shuffle + [F.col(c) for c in keys]
    out, n = with_pos(df, order)
    _enough(n, n_splits)
    q, r = divmod(n, n_splits)
    late = F.floor((F.col("pos") - r * (q + 1)) / q) + r
    return _by_fold(out.withColumn("fold", F.when(F.col("pos") < r * (q + 1), F.floor(F.col("pos") / (q + 1))).otherwise(late).cast("int")), n_splits)


def stratified_k_fold(df: DataFrame, y: str | None, keys: list[str], n_splits: int = 5, shuffle: bool = True, seed: int = 0) -> SplitPlan:
    """Folds that keep the shares of the classes of ``y``: every class and every fold is level to one row.

    Rows sorted by class are dealt round-robin to find how many rows of each class a fold gets; then each class hands
    them out in order of ``keys`` or of a seeded permutation. Only one row a class is summed up and joined back.
    """
    if y is None:
        raise ValueError("stratified folds need a target column")
    need(df, y, *keys)
    out, n = with_pos(df, [F.col(y), *([md5_key(seed, *keys)] * shuffle), *map(F.col, keys)])
    _enough(n, n_splits)
    starts = out.groupBy(F.col(y).alias("_class")).agg(F.min("pos").alias("_start"), F.count("*").alias("_size"))
    # rows r of [start, start + size) with r mod k = i, summed over the folds up to i
    held = [F.floor((F.col("_start") + F.col("_size") - 1 - i + n_splits) / n_splits) - F.floor((F.col("_start") - 1 - i + n_splits) / n_splits) for i in range(n_splits)]
    starts = starts.withColumn("_held", F.array(*held)).withColumn("_upto", F.transform(F.sequence(F.lit(1), F.lit(n_splits)), lambda i: F.aggregate(F.slice("_held", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x)))
    out = out.join(sized(starts.select("_class", "_start", "_upto")), F.col(y).eqNullSafe(F.col("_class")))
    fold = F.size(F.filter("_upto", lambda u: u <= F.col("pos") - F.col("_start")))
    return _by_fold(out.withColumn("fold", fold).drop("_class", "_start", "_upto"), n_splits)


def dealt_runs(runs: list[tuple[int, int]], n_splits: int) -> list[tuple[int, int, list[int]]]:
    """How the greedy rule deals groups to folds: (size, first place, folds in turn) of stretches of equal groups.

    ``runs`` has the sizes of groups, largest first, with how many groups have each. Each group goes into the lightest
    fold (the lowest of equals). Among groups of one size, the folds that lie less than a size above the lightest take
    turns, in order of their loads, until the lightest has come so near to a heavier fold that this one joins; so a run
    of equal groups, however long, is at most ``n_splits`` stretches of turns.
    """
    loads, out, at = [0] * n_splits, [], 0
    for size, left in runs:
        while left:
            turn = sorted(range(n_splits), key=lambda i: (loads[i], i))
            low = loads[turn[0]]
            heavy = [i for i in turn if loads[i] >= low + size]
            turn = turn[: n_splits - len(heavy)]
            rounds = min((loads[heavy[0]] - low) // size if heavy else left, -(-left // len(turn)))
            n = min(left, rounds * len(turn))
            out.append((size, at, turn))
            for k, i in enumerate(turn):
                loads[i] += size * (n // len(turn) + (k < n % len(turn)))
            at, left = at + n, left - n
    return out


def group_k_fold(df: DataFrame, group: str | None, n_splits: int = 5) -> SplitPlan:
    """Folds that never part a group: groups by falling size, then key, each into the lightest fold (lowest of equals).

    One rule at every size: only the distinct sizes of groups reach the driver (of n rows, fewer than the root of 2 n),
    which finds in what turns they are dealt; each group then takes its fold from its place in the order.
    """
    if group is None:
        raise ValueError("grouped folds need a group column")
    need(df, group)
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size"))
    runs = [(r._size, r.n) for r in sizes.groupBy("_size").agg(F.count("*").alias("n")).orderBy(F.desc("_size")).collect()]
    _enough(sum(n for _, n in runs), n_splits)
    turns: dict[int, list] = {}
    for size, at, folds in dealt_runs(runs, n_splits):
        turns.setdefault(size, []).append((at, folds))
    dealt = df.sparkSession.createDataFrame(list(turns.items()), "_size long, _turns array<struct<at:long,folds:array<int>>>")
    places, _ = with_pos(sizes, [-F.col("_size"), F.col("_group")])
    own = places.join(sized(dealt), "_size").withColumn("_turn", F.element_at(F.filter("_turns", lambda t: t["at"] <= F.col("pos")), -1))
    fold = F.get("_turn.folds", ((F.col("pos") - F.col("_turn.at")) % F.size("_turn.folds")).cast("int"))
    out = df.join(sized(own.select("_group", fold.alias("fold"))), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")
    return _by_fold(out, n_splits)


def duration_us(text: str) -> int:
    """Microseconds of a duration such as '24h', '3d' or '90 min'."""
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-z]+)\s*", text.lower())
    if not found or found[2] not in DURATION_UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return int(Fraction(found[1]) * DURATION_UNITS[found[2]])


def _is_timestamp(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))


def time_us(df: DataFrame, time: str, unit: str | None) -> Column:
    """Microseconds of a time column; integer times need a unit, timestamps must have none."""
    if _is_timestamp(df, time):
        if unit is not None:
            raise ValueError("a timestamp column carries its unit")
        return F.unix_micros(F.col(time).cast("timestamp"))
    if unit not in TIME_UNITS:
        raise ValueError(f"an integer time column needs a unit of {sorted(TIME_UNITS)}")
    scale = TIME_UNITS[unit]
    return F.floor(F.col(time) * scale.numerator / scale.denominator).cast("bigint") if scale < 1 else F.col(time) * scale.numerator


def embargo_rows(df: DataFrame, time: str | None, embargo: int | str | None, gap: int = 0, unit: str | None = None) -> int:
    """Rows between train and test: ``gap`` without an embargo, a number as it is, or rows for a duration.

    A duration is ceil(ceil(duration / median step of distinct times) * rows / distinct times).
    """
    if embargo is None:
        return gap
    if isinstance(embargo, int):
        return embargo
    need(df, time)
    times, distinct = with_pos(df.select(time_us(df, time, unit).alias("us")).distinct(), [F.col("us")])
    if distinct < 2:
        return 0
    steps = times.select("us", "pos").join(times.select(F.col("us").alias("before"), (F.col("pos") + 1).alias("pos")), "pos")
    median = int(exact_median(steps.select((F.col("us") - F.col("before")).alias("step")), "step"))
    if median <= 0:
        raise ValueError("the median step between times is not positive")
    return ceil(Fraction(-(-duration_us(embargo) // median)) * df.count() / distinct)


def walk_forward(df: DataFrame, order: list[str], n_splits: int = 5, gap: int = 0, max_train_size: int | None = None, embargo: int | str | None = None, time: str | None = None, unit: str | None = None) -> SplitPlan:
    """Test i is the block of n div (k + 1) rows that ends k - 1 - i blocks before the last row; train is all before it.

    ``order`` must be a total order. The train side ends ``gap`` (or embargo) rows earlier and keeps its last
    ``max_train_size`` rows.
    """
    need(df, *order)
    out, n = with_pos(df, [F.col(c) for c in order])
    gap = embargo_rows(df, time, embargo, gap, unit)
    size = n // (n_splits + 1)
    starts = [n - (n_splits - i) * size for i in range(n_splits)]
    if n_splits < 2 or size == 0 or starts[0] - gap <= 0:
        raise ValueError(f"{n} rows are too few for {n_splits} splits with a gap of {gap}")

    def train(i: int) -> Column:
        end = starts[i] - gap
        return (F.col("pos") >= max(0, end - (max_train_size or end))) & (F.col("pos") < end)

    return SplitPlan(out, n_splits, train, lambda i: (F.col("pos") >= starts[i]) & (F.col("pos") < starts[i] + size))


def purged_sides(n: int, n_folds: int, n_test_folds: int, purge: int, embargo: int) -> tuple[int, list[tuple[int, ...]], Callable[[int], Column], Callable[[int], Column]]:
    """Fold size, combinations and the two predicates over ``pos`` of combinatorial purged folds of n places."""
    if not 0 < n_test_folds < n_folds or n < n_folds:
        raise ValueError(f"{n_test_folds} of {n_folds} folds of {n} places")
    size = n // n_folds
    if purge < 0 or embargo < 0 or purge + embargo >= size:
        raise ValueError(f"purge {purge} and embargo {embargo} must be less than a fold of {size}")
    picks = list(combinations(range(n_folds), n_test_folds))
    end = lambda f: n if f == n_folds - 1 else (f + 1) * size
    pos = F.col("pos")

    def runs(i: int) -> list[tuple[int, int]]:
        """Test intervals, adjacent folds merged: nothing is purged between two test folds."""
        out: list[tuple[int, int]] = []
        for f in picks[i]:
            if out and out[-1][1] == f * size:
                out[-1] = (out[-1][0], end(f))
            else:
                out.append((f * size, end(f)))
        return out

    def any_of(spans: list[tuple[int, int]]) -> Column:
        out = F.lit(False)
        for lo, hi in spans:
            out = out | ((pos >= lo) & (pos < hi))
        return out

    return size, picks, lambda i: ~any_of([(s - purge, e + purge + embargo) for s, e in runs(i)]), lambda i: any_of(runs(i))


def _sizes(n: int, purge: int, embargo: int, horizon: int, embargo_pct: float) -> tuple[int, int]:
    return purge or horizon, embargo or int(n * embargo_pct)


def combinatorial_purged(df: DataFrame, order: list[str], n_folds: int = 10, n_test_folds: int = 2, purge: int = 0, embargo: int = 0, target_horizon_bars: int = 0, embargo_pct: float = 0.0) -> SplitPlan:
    """All choices of test folds out of contiguous folds; rows within ``purge`` of a test side, and ``embargo`` rows more
    after it, leave the train side. The last fold takes the remainder. A zero purge or embargo is taken from the horizon
    or the share of rows."""
    need(df, *order)
    out, n = with_pos(df, [F.col(c) for c in order])
    size, picks, train, test = purged_sides(n, n_folds, n_test_folds, *_sizes(n, purge, embargo, target_horizon_bars, embargo_pct))
    out = out.withColumn("fold", F.least(F.floor(F.col("pos") / size), F.lit(n_folds - 1)).cast("int"))
    return SplitPlan(out, len(picks), train, test)


def panel_combinatorial_purged(df: DataFrame, time: str | None, asset: str | None, n_folds: int = 10, n_test_folds: int = 2, purge: int = 0, embargo: int = 0, target_horizon_bars: int = 0, embargo_pct: float = 0.0) -> SplitPlan:
    """``combinatorial_purged`` over the distinct times of a panel: all rows of a time fall on one side."""
    need(df, time, asset)
    times, n = with_pos(df.select(F.col(time).alias("_time")).distinct(), [F.col("_time")])
    size, picks, train, test = purged_sides(n, n_folds, n_test_folds, *_sizes(n, purge, embargo, target_horizon_bars, embargo_pct))
    times = times.withColumn("fold", F.least(F.floor(F.col("pos") / size), F.lit(n_folds - 1)).cast("int"))
    times = F.broadcast(times) if n <= BROADCAST_ROWS else times
    return SplitPlan(df.join(times, F.col(time).eqNullSafe(F.col("_time"))).drop("_time"), len(picks), train, test)


def make_plan(df: DataFrame, kind: str, keys: list[str], *, seed: int = 0, y: str | None = None, group: str | None = None, time: str | None = None, asset: str | None = None, **options) -> SplitPlan:
    """Plan of a kind: kfold, stratified, group, time_series, cpcv or panel_cpcv; only shuffled kinds use the seed."""
    order = [c for c in (time, *keys) if c]
    makers = {
        "kfold": lambda: k_fold(df, keys, seed=seed, **options),
        "stratified": lambda: stratified_k_fold(df, y, keys, seed=seed, **options),
        "group": lambda: group_k_fold(df, group, **options),
        "time_series": lambda: walk_forward(df, order, time=time, **options),
        "cpcv": lambda: combinatorial_purged(df, order, **options),
        "panel_cpcv": lambda: panel_combinatorial_purged(df, time, asset, **options),
    }
    if kind not in makers:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(makers)}")
    return makers[kind]()

"""Global positions, running sums and exact medians, in ranges of the sort key instead of one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task may number by itself; beyond it the order is cut into ranges of about so many rows.
ROWS_PER_RANGE = 100_000
#: Most ranges, and sampled keys a range from which the cuts are taken.
MAX_RANGES = 512
SAMPLES_PER_RANGE = 16
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have few rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def new_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def md5_key(seed: int | str, *cols: str) -> Column:
    """Key of a seeded permutation; pair it with ``cols`` to make the order total."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)))


@dataclass(frozen=True)
class Ranged:
    """A frame with its rows dealt to ranges of the sort key, numbered in order."""

    frame: DataFrame
    keys: list[str]
    part: str
    rows: int

    def window(self) -> Window:
        return Window.partitionBy(self.part).orderBy(*(F.col(k).asc_nulls_first() for k in self.keys))

    def offsets(self, total: Column) -> DataFrame:
        """(part, before): ``total`` over all earlier ranges; MAX_RANGES rows at most."""
        sums = self.frame.groupBy(self.part).agg(total.alias("before"))
        return sums.select(self.part, (F.sum("before").over(Window.orderBy(self.part)) - F.col("before")).alias("before"))


def ranged(df: DataFrame, order: list[Column], rows_per_range: int = ROWS_PER_RANGE) -> Ranged:
    """Deal ``df`` to ranges of ``order`` (ascending, nulls first).

    Cuts come from a sample chosen by hash, so they are the same in every run; rows beside the cuts are decided by
    comparison alone, whatever the sample. Equal keys share a range: the order should be total.
    """
    rows = df.count()
    keys = new_names(df, *(f"key{i}" for i in range(len(order))))
    out = df.withColumns(dict(zip(keys, order, strict=True)))
    part = new_names(out, "range")[0]
    n = min(MAX_RANGES, -(-rows // rows_per_range))
    if n <= 1:
        return Ranged(out.withColumn(part, F.lit(0)), keys, part, rows)
    sample = out.select(*keys).orderBy(F.xxhash64(*keys)).limit(n * SAMPLES_PER_RANGE).orderBy(*(F.col(k).asc_nulls_first() for k in keys)).collect()
    step = max(1, len(sample) // n)
    cuts = [r for i, r in enumerate(sample) if i and i % step == 0]
    kinds = [out.schema[k].dataType for k in keys]
    own = F.struct(*keys)

    def cut(row) -> Column:
        return F.struct(*(F.lit(v).cast(t).alias(k) for k, t, v in zip(keys, kinds, row, strict=True)))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(own < cut(cuts[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return Ranged(out.withColumn(part, place(0, len(cuts))), keys, part, rows)


def with_pos(df: DataFrame, order: list[Column], pos: str = "pos") -> tuple[DataFrame, int]:
    """``df`` with the 0-based global position of each row in ``order``, and the number of rows.

    One shuffle by range, a window in each range, and a broadcast of the range totals. ``order`` must be total for the
    positions to be the same in every run. No rows, no positions; a column named like ``pos`` is replaced.
    """
    r = ranged(df.drop(pos), order)
    offsets = r.offsets(F.count("*"))
    out = r.frame.withColumn(pos, F.row_number().over(r.window()).cast("bigint") - 1)
    out = out.join(F.broadcast(offsets), r.part).withColumn(pos, F.col(pos) + F.col("before"))
    return out.select(*(c for c in df.columns if c.lower() != pos.lower()), pos), r.rows


def running_sum(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in ``order``, itself excluded."""
    r = ranged(df, order)
    offsets = r.offsets(F.sum(value))
    out = r.frame.withColumn(name, F.sum(value).over(r.window().rowsBetween(Window.unboundedPreceding, 0)) - F.col(value))
    out = out.join(F.broadcast(offsets), r.part).withColumn(name, F.col(name) + F.col("before"))
    return out.select(*df.columns, name)


def exact_median(df: DataFrame, col: str) -> float | None:
    """The median of the values that are not null, as the mean of the middle one or two; None without values.

    Equal values are counted before they are ordered, so values that many rows share meet in no task.
    """
    by = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    n = by.agg(F.sum("n").alias("n")).first().n
    if not n:
        return None
    by = running_sum(by, [F.col("value")], "n", "below")
    holds = lambda place: (F.col("below") <= place) & (F.col("below") + F.col("n") > place)
    middle = F.when(holds((n - 1) // 2), F.col("value")), F.when(holds(n // 2), F.col("value"))
    return by.agg(((F.max(middle[0]) + F.max(middle[1])) / 2).alias("m")).first().m

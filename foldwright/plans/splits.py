"""One-shot train, validation and test splits of exact sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import md5_key, with_pos

ROLES = ("train", "val", "test")
DEFAULT_RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def check_ratios(ratios: dict[str, float]) -> None:
    """ValueError unless the keys are train, val and test, none is negative and they sum to 1."""
    if set(ratios) != set(ROLES):
        raise ValueError(f"ratios need the keys {ROLES}, not {sorted(ratios)}")
    if min(ratios.values()) < 0 or abs(sum(ratios.values()) - 1) > 1e-6:
        raise ValueError(f"ratios must not be negative and sum to 1: {ratios}")


def role_of(pos: Column, n: int, ratios: dict[str, float]) -> Column:
    """Role of a position: int(n * ratio) rows of train, then of val; test is the remainder."""
    train, val = int(n * ratios["train"]), int(n * ratios["val"])
    return F.when(pos < train, "train").when(pos < train + val, "val").otherwise("test")


def _split(df: DataFrame, order: list[Column], ratios: dict[str, float] | None, name: str) -> DataFrame:
    ratios = ratios or DEFAULT_RATIOS
    check_ratios(ratios)
    out, n = with_pos(df, order)
    return out.withColumn(name, role_of(F.col("pos"), n, ratios))


def random_split(df: DataFrame, keys: list[str], seed: int, ratios: dict[str, float] | None = None, name: str = "split") -> DataFrame:
    """``df`` with its position in a seeded permutation and its role; ``keys`` identify a row."""
    return _split(df, [md5_key(seed, *keys), *map(F.col, keys)], ratios, name)


def temporal_split(df: DataFrame, time: str, keys: list[str], ratios: dict[str, float] | None = None, name: str = "split") -> DataFrame:
    """As ``random_split``, in order of time and then ``keys``; neighbours of one time may lie on both sides of a cut."""
    if time not in df.columns:
        raise ValueError(f"no time column {time!r}")
    return _split(df, [F.col(time), *map(F.col, keys)], ratios, name)


def split(df: DataFrame, kind: str, keys: list[str], seed: int = 0, time: str | None = None, ratios: dict[str, float] | None = None) -> DataFrame:
    """Dispatch by kind: 'random', or 'time_ordered', which ignores the seed."""
    if kind == "random":
        return random_split(df, keys, seed, ratios)
    if kind == "time_ordered" and time:
        return temporal_split(df, time, keys, ratios)
    raise ValueError(f"split kind {kind!r} with time column {time!r}")


def parts(df: DataFrame, name: str = "split") -> dict[str, DataFrame]:
    """The three roles as filters over one frame."""
    return {role: df.where(F.col(name) == role).drop(name) for role in ROLES}


def tuning_rows(df: DataFrame, name: str = "split") -> DataFrame:
    """Rows that a search may see: all but test."""
    return df.where(F.col(name) != "test")


def inner_validation(df: DataFrame, ratio: float, order: list[Column], name: str = "inner") -> DataFrame:
    """The last round(n * ratio) rows in ``order`` are 'val', the others 'train'."""
    out, n = with_pos(df, order)
    return out.withColumn(name, F.when(F.col("pos") >= n - round(n * ratio), "val").otherwise("train"))

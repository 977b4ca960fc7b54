"""Content hashes of tables, files and settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_digests

#: Hex digits of a row hash that name its bucket: 65,536 buckets, so a bucket of 10 ** 11 rows holds 100 MB of hashes.
BUCKET_DIGITS = 4


def canonical_json(value: object) -> str:
    """JSON with sorted keys and without spaces; what JSON lacks is written as text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def settings_hash(settings: dict, leave_out: tuple[str, ...] = ()) -> str:
    """Hash of settings without the runtime paths named as 'layer.field'."""
    kept = {k: {f: x for f, x in v.items() if f"{k}.{f}" not in leave_out} if isinstance(v, dict) else v for k, v in settings.items()}
    return sha256_text(canonical_json(kept))


def columns_hash(columns: list[str]) -> str:
    return sha256_text(canonical_json(sorted(columns)))


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of a row over its columns in order of name; null is told from every text, and no text holds the separator.

    Points in time count by their microseconds, so the session's time zone does not matter.
    """
    kinds = dict(df.dtypes)
    text = lambda c: (F.unix_micros(F.col(f"`{c}`")) if kinds[c] == "timestamp" else F.col(f"`{c}`")).cast("string")
    plain = lambda x: F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\u"))
    cell = lambda c: F.coalesce(F.concat(F.lit("="), plain(text(c))), F.lit("~"))
    return F.sha2(F.concat_ws("\x1f", *map(cell, sorted(df.columns))), 256)


def logical_hash(df: DataFrame) -> DataFrame:
    """One row, ``logical_hash``: depends on the rows and how often each occurs, not on their order or files.

    Equal rows are counted first. The hashes of a bucket, with their counts, are sorted and hashed; the root hashes the
    sorted buckets. An empty table has the hash of the empty text.
    """
    rows = df.select(row_hash(df).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    entry = F.concat(F.col("h"), F.lit(":"), F.col("n").cast("string"))
    buckets = rows.groupBy(F.substring("h", 1, BUCKET_DIGITS).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(entry)), ""), 256).alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("b", "d"))), ""), 256).alias("logical_hash"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, digest) of the Parquet files under a path, by ranges of them that tasks read; no size is too large."""
    return file_digests(spark, path)


def bytes_hash(spark: SparkSession, path: str) -> str:
    """Hash of the sorted digests of the files: names and order do not matter, layout does."""
    return digests_hash(file_hashes(spark, path))


def digests_hash(files: DataFrame) -> str:
    return files.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("digest")), ","), 256).alias("h")).first().h


def data_hash(hashes: dict) -> str:
    """The bytes and the logical hash of a dataset as one text: what the version id is the digest of."""
    return f"{hashes['bytes_hash']}|{hashes['logical_hash']}"


def dataset_hashes(spark: SparkSession, path: str) -> dict:
    """bytes_hash, logical_hash, version_id, row_count and schema (names sorted) of a Parquet dataset."""
    df = spark.read.parquet(path)
    out = {"bytes_hash": bytes_hash(spark, path), "logical_hash": logical_hash(df).first().logical_hash}
    out["version_id"] = sha256_text(data_hash(out))[:16]
    return out | {"row_count": df.count(), "schema": dict(sorted(df.dtypes))}

"""Parquet sources: scans, file lists, equal chunks and snapshots with manifests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import dataset_hashes, file_hashes
from ..plans.order import sized, with_pos
from .files import Files, copied

MANIFEST_SCHEMA = "name string, version_id string, bytes_hash string, logical_hash string, row_count long, schema map<string,string>, files array<struct<path:string,bytes:long,digest:string,target:string>>, created_at string"
MANIFEST_FIELDS = ("name", "version_id", "bytes_hash", "logical_hash", "row_count", "schema", "files", "created_at")


class ManifestError(ValueError):
    """A manifest that is not whole."""


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Lazy scan of a file or of a folder, with its partition columns."""
    return spark.read.parquet(path)


def materialize(df: DataFrame, engine: str = "streaming") -> DataFrame:
    """Keep the rows for further use: 'streaming' may spill to disk, 'in-memory' recomputes what does not fit."""
    levels = {"streaming": StorageLevel.MEMORY_AND_DISK, "in-memory": StorageLevel.MEMORY_ONLY}
    if engine not in levels:
        raise ValueError(f"unknown engine {engine!r}; known: {sorted(levels)}")
    return df.persist(levels[engine])


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the Parquet files under a path, in order; FileNotFoundError if there are none."""
    try:
        files = sorted(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path).inputFiles())
    except Exception as e:
        if re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(e)):
            raise FileNotFoundError(path) from e
        raise
    if not files:
        raise FileNotFoundError(path)
    return files


def file_batches(spark: SparkSession, path: str, target: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(features, target) frames, one pair a file, in order of the paths."""
    for file in parquet_files(spark, path):
        df = spark.read.parquet(file)
        if target not in df.columns:
            raise ValueError(f"no target column {target!r} in {file}")
        yield df.drop(target), df.select(target)


def chunks(df: DataFrame, order: list[Column], n_chunks: int, name: str = "chunk") -> DataFrame:
    """``df`` with a chunk number: chunks of ceil(n / n_chunks) rows in ``order``, the last one shorter."""
    if n_chunks <= 0:
        raise ValueError("n_chunks must be positive")
    out, n = with_pos(df, order)
    if n == 0:
        raise ValueError("no rows to cut into chunks")
    return out.withColumn(name, F.floor(F.col("pos") / -(-n // n_chunks)).cast("int"))


def snapshot(spark: SparkSession, path: str, name: str, root: str) -> dict:
    """Store the files of a dataset by their content under ``root``/cas, those that are there excepted, and a manifest.

    Tasks copy the bytes as they are, so the stored files have the dataset's bytes hash, and files that several versions
    share are stored once. Returns the manifest.
    """
    hashes = dataset_hashes(spark, path)
    base = _qualified(spark, path)
    relative = F.when(F.col("file") == base, F.regexp_extract("file", "[^/]+$", 0)).otherwise(F.replace("file", F.lit(f"{base}/"), F.lit("")))
    stored = F.concat_ws("/", F.lit(_qualified(spark, f"{root}/cas")), F.substring("digest", 1, 2), F.concat_ws("__", "digest", F.regexp_extract("file", "[^/]+$", 0)))
    files = file_hashes(spark, path).select("file", relative.alias("path"), "bytes", "digest", stored.alias("target"))
    files = [r.asDict() for r in files.orderBy("path").collect()]  # a row a file, as the manifest lists them
    frame = spark.createDataFrame([(f["file"], f["target"]) for f in files], "file string, target string").dropDuplicates(["target"])
    copied(frame).agg(F.count("*")).first()
    manifest = {"name": name, "created_at": datetime.now(UTC).isoformat(timespec="microseconds"), "files": [{k: f[k] for k in ("path", "bytes", "digest", "target")} for f in files]} | hashes
    write_manifest(spark, root, manifest)
    return manifest


def _qualified(spark: SparkSession, path: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    """Write a manifest in one step; ManifestError if a field is missing or unknown."""
    checked_manifest(manifest)
    Files(spark).write(f"{root}/manifests/{manifest['name']}/{manifest['version_id']}.json", json.dumps(manifest, sort_keys=True))


def checked_manifest(manifest: object) -> dict:
    if not isinstance(manifest, dict) or set(manifest) != set(MANIFEST_FIELDS):
        raise ManifestError(f"a manifest has the fields {MANIFEST_FIELDS}, not {sorted(manifest) if isinstance(manifest, dict) else manifest!r}")
    return manifest


def read_manifest(spark: SparkSession, root: str, name: str, version: str) -> dict:
    """The manifest of a version; FileNotFoundError if there is none, ManifestError if it is not whole."""
    text = Files(spark).read(f"{root}/manifests/{name}/{version}.json")
    try:
        return checked_manifest(json.loads(text))
    except json.JSONDecodeError as e:
        raise ManifestError(f"{name} {version}: {e}") from e


def load_snapshot(spark: SparkSession, manifest: dict) -> DataFrame:
    """The rows of a stored version, with the columns of partition folders that its files came from."""
    folders = sorted({part.partition("=")[0] for f in manifest["files"] for part in f["path"].split("/")[:-1] if "=" in part})
    df = spark.read.parquet(*sorted({f["target"] for f in manifest["files"]}))
    if not folders:
        return df
    rows = [(f["target"].rsplit("/", 1)[1], f["path"]) for f in manifest["files"]]
    paths = spark.createDataFrame(rows, "_file string, _path string")
    value = lambda c: F.url_decode(F.regexp_extract("_path", f"(?:^|/){re.escape(c)}=([^/]*)/", 1))
    paths = paths.select("_file", *(F.nullif(value(c), F.lit("__HIVE_DEFAULT_PARTITION__")).cast(manifest["schema"][c]).alias(c) for c in folders))
    return df.withColumn("_file", F.col("_metadata.file_name")).join(sized(paths), "_file").drop("_file")


def list_manifests(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """Manifests under ``root``, newest first; none yet: no rows."""
    try:
        out = spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", "true").json(f"{root}/manifests")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        out = spark.createDataFrame([], MANIFEST_SCHEMA)
    out = out if name is None else out.where(F.col("name") == name)
    return out.orderBy(F.col("created_at").desc(), "name", "version_id")

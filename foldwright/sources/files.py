"""Small files written in one step, and bytes of large ones read and copied by tasks."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the ranges whose digests make up that of a file, and of a piece that a task holds at once.
RANGE_BYTES = 64 << 20
PIECE_BYTES = 1 << 20
#: Schemes of Hadoop and what the readers inside tasks call them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


class Files:
    """Files of any store that Spark can write, by Hadoop's interface on the driver; for small texts, not for data."""

    def __init__(self, spark: SparkSession):
        self.context, self.hadoop = spark.sparkContext, spark.sparkContext._jvm.org.apache.hadoop.fs
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.hadoop.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        store, where = self._at(path)
        return store.exists(where)

    def names(self, path: str, folders: bool) -> list[str]:
        """Names of the folders, or of the files, right below a path; those that begin with _ or . are hidden."""
        store, where = self._at(path)
        found = store.listStatus(where) if store.exists(where) else []
        return sorted(s.getPath().getName() for s in found if s.isDirectory() == folders and s.getPath().getName()[0] not in "_.")

    def read(self, path: str) -> str:
        store, where = self._at(path)
        if not store.exists(where) or store.getFileStatus(where).isDirectory():
            raise FileNotFoundError(path)
        stream = store.open(where)
        try:
            return bytes(self.context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write a text aside and move it to its place: readers find the old file or the new one, never a part."""
        store, where = self._at(path)
        aside = self.hadoop.Path(where.getParent(), f"_{where.getName()}.{uuid.uuid4().hex}")
        try:
            out = store.create(aside, True)
            try:
                out.write(text.encode())
            finally:
                out.close()
            self._move(aside, where)
        except BaseException:
            store.delete(aside, False)
            raise

    def _move(self, aside, where) -> None:
        rename = getattr(self.hadoop, "Options$Rename")
        how = self.context._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        place = aside.getFileSystem(self.conf).makeQualified(where)
        self.hadoop.FileContext.getFileContext(place.toUri(), self.conf).rename(aside.getFileSystem(self.conf).makeQualified(aside), place, how)


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a file and its path there, for use inside tasks; ValueError for a scheme they cannot read."""
    scheme, rest = re.fullmatch(r"(?:(\w+):)?(.*)", uri).groups()
    if (scheme or "file") not in SCHEMES:
        raise ValueError(f"tasks cannot read bytes of {scheme}: files")
    rest = quote(rest if rest.startswith("//") else f"//{rest}", safe="/:@")  # Hadoop's paths are not escaped
    return pafs.FileSystem.from_uri(f"{SCHEMES[scheme or 'file']}:{rest}")


def listed(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, bytes) of the files under a path; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def range_digests(files: DataFrame, tasks: int | None = None, size: int = RANGE_BYTES) -> DataFrame:
    """(file, bytes, at, digest): SHA-256 of each range of ``size`` bytes, each read by some task, piece by piece.

    Files without a byte are not listed. Tasks hold PIECE_BYTES at a time, so files may be of any size.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    ranges = files.select("file", "bytes", F.explode(starts).alias("at"))
    ranges = ranges.repartition(tasks or files.sparkSession.sparkContext.defaultParallelism, "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                store, where = opened(file)
                digest, left = hashlib.sha256(), size
                with store.open_input_file(where) as stream:
                    stream.seek(at)
                    while left and (piece := stream.read(min(left, PIECE_BYTES))):
                        digest.update(piece)
                        left -= len(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["file", "bytes", "at", "digest"])

    return ranges.mapInArrow(run, "file string, bytes long, at long, digest string")


def file_digests(spark: SparkSession, path: str, tasks: int | None = None, pattern: str = "*.parquet") -> DataFrame:
    """(file, bytes, digest): the digest of a file is that of the digests of its ranges, in order; the number of tasks
    does not matter."""
    ranges = range_digests(listed(spark, path, pattern), tasks)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("at", "digest"))), lambda r: r["digest"])
    return ranges.groupBy("file", "bytes").agg(F.sha2(F.array_join(in_order, ""), 256).alias("digest"))


def copied(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file, target, copied): each file's bytes at its target, copied by tasks piece by piece unless a file is there.

    ``files`` has the columns file and target. A copy is made aside and then moved, so a target is whole or missing, and
    a task that is run again finds it or makes it anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for file, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, where = opened(file)
                other, there = opened(target)
                done.append(other.get_file_info(there).type == pafs.FileType.NotFound)
                if done[-1]:
                    folder, name = there.rsplit("/", 1)
                    aside = f"{folder}/_{name}.{uuid.uuid4().hex}"
                    other.create_dir(folder, recursive=True)
                    with store.open_input_stream(where) as source, other.open_output_stream(aside) as sink:
                        while piece := source.read(PIECE_BYTES):
                            sink.write(piece)
                    other.move(aside, there)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done)], names=["file", "target", "copied"])

    rows = files.select("file", "target").repartition(tasks or files.sparkSession.sparkContext.defaultParallelism, "file")
    return rows.mapInArrow(run, "file string, target string, copied boolean")

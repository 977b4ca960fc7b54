"""Files written in one step, digests by ranges, snapshots by bytes."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from foldwright.functions import hashing
from foldwright.sources import files, parquet
from foldwright.sources.files import Files


def test_texts_are_written_whole(spark, tmp_path, monkeypatch):
    store, path = Files(spark), f"{tmp_path}/a/b.json"
    with pytest.raises(FileNotFoundError):
        store.read(path)
    store.write(path, "één")
    store.write(path, "two")
    assert store.read(path) == "two" and store.names(f"{tmp_path}/a", False) == ["b.json"] and store.names(f"{tmp_path}", True) == ["a"]
    assert store.names(f"{tmp_path}/none", True) == [] and store.exists(path)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(Files, "_move", broken)
    with pytest.raises(RuntimeError):
        store.write(path, "three")
    assert store.read(path) == "two" and not [n for n in os.listdir(f"{tmp_path}/a") if n.startswith("_")]


def blob(path, n):
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(bytes(i * 7 % 251 for i in range(n)))


def test_digests_do_not_depend_on_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files.range_digests, "__defaults__", (None, 1000))
    monkeypatch.setattr(files, "PIECE_BYTES", 300)
    for name, n in (("a", 0), ("b", 1000), ("c", 1001), ("d", 45_678), ("e", 1000)):
        blob(tmp_path / "d" / f"{name}.parquet", n)
    want = {}
    for p in sorted((tmp_path / "d").iterdir()):
        data = p.read_bytes()
        leaves = [hashlib.sha256(data[i : i + 1000]).hexdigest() for i in range(0, len(data), 1000)]
        if data:
            want[p.name] = (len(data), hashlib.sha256("".join(leaves).encode()).hexdigest())
    for tasks in (1, 7):
        found = files.file_digests(spark, f"{tmp_path}/d", tasks).collect()
        assert {r.file.rsplit("/", 1)[1]: (r.bytes, r.digest) for r in found} == want
    assert want["b.parquet"] == want["e.parquet"] != want["c.parquet"]


def test_copies_are_made_once(spark, tmp_path):
    blob(tmp_path / "a" / "x y.parquet", 5000)
    rows = spark.createDataFrame([(f"file:{tmp_path}/a/x y.parquet", f"file:{tmp_path}/b/c/x y.parquet")], "file string, target string")
    assert [r.copied for r in files.copied(rows).collect()] == [True]
    assert [r.copied for r in files.copied(rows).collect()] == [False]
    assert (tmp_path / "b/c/x y.parquet").read_bytes() == (tmp_path / "a/x y.parquet").read_bytes()
    with pytest.raises(ValueError):
        files.opened("nowhere://a/b")


def test_snapshot_keeps_bytes_and_shares_files(spark, tmp_path):
    source, root = f"{tmp_path}/d", f"{tmp_path}/store"
    spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("p")).repartition(2).write.parquet(source)
    made = parquet.snapshot(spark, source, "t", root)
    assert hashing.bytes_hash(spark, f"{root}/cas") == hashing.bytes_hash(spark, source) == made["bytes_hash"]
    assert made["version_id"] == hashing.sha256_text(hashing.data_hash(made))[:16]
    assert sorted(parquet.load_snapshot(spark, made).collect()) == sorted(spark.read.parquet(source).collect())
    stored = {f["target"] for f in made["files"]}
    spark.range(5).select("id", F.lit("q").alias("p")).coalesce(1).write.mode("append").parquet(source)
    more = parquet.snapshot(spark, source, "t", root)
    assert len(more["files"]) == len(made["files"]) + 1 and stored < {f["target"] for f in more["files"]}
    assert parquet.load_snapshot(spark, made).count() == 100 and parquet.load_snapshot(spark, more).count() == 105
    assert [r.version_id for r in parquet.list_manifests(spark, root, "t").collect()] == [more["version_id"], made["version_id"]]
    assert parquet.read_manifest(spark, root, "t", made["version_id"]) == made


def test_snapshot_of_partition_folders_and_single_files(spark, tmp_path):
    source, root = f"{tmp_path}/d", f"{tmp_path}/store"
    df = spark.range(20).select("id", (F.col("id") % 3).cast("int").alias("part"), F.when(F.col("id") > 4, F.concat(F.lit("a b/"), F.col("id") % 2)).alias("name"))
    df.write.partitionBy("part", "name").parquet(source)
    made = parquet.snapshot(spark, source, "t", root)
    back = parquet.load_snapshot(spark, made)
    assert sorted(back.select("id", "part", "name").collect(), key=str) == sorted(df.collect(), key=str) and dict(back.dtypes)["part"] == "int"
    one = next(p for p in (tmp_path / "d").rglob("*.parquet"))
    single = parquet.snapshot(spark, str(one), "one", root)
    assert [f["path"] for f in single["files"]] == [one.name] and single["files"][0]["target"] in {f["target"] for f in made["files"]}


def test_manifests_are_checked(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/d")
    made, root = parquet.snapshot(spark, f"{tmp_path}/d", "t", f"{tmp_path}/store"), f"{tmp_path}/store"
    where = f"{root}/manifests/t/{made['version_id']}.json"
    for text in (json.dumps(made | {"more": 1}), json.dumps({k: v for k, v in made.items() if k != "files"}), "[]", "{"):
        Files(spark).write(where, text)
        with pytest.raises(parquet.ManifestError):
            parquet.read_manifest(spark, root, "t", made["version_id"])
    with pytest.raises(FileNotFoundError):
        parquet.read_manifest(spark, root, "t", "none")
    with pytest.raises(parquet.ManifestError):
        parquet.write_manifest(spark, root, {"name": "t"})

"""The corpus pipeline: documents through toxicity, near-duplicate, decontamination, mixing and sharding stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foldwright.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from foldwright.llm.common import shared_dir

STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("near-dedup", near_dedup.near_dedup_stage),
    ("decontamination", decontaminate.decontaminate_stage),
    ("mixing", mixing.mix_stage),
    ("sharding", sharding.shard_stage),
]

#: Models, sketches and hashed samples are not expressible in SQL. Near-duplicates are tested against brute force,
#: decontamination against planted items, sharding against its network in plain numbers; toxicity by held-out rows and
#: mixing by its targets; the chain as a whole by what each stage keeps of the one before, in tests/llm/test_edges.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/foldwright/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A training-data pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, decontam, langid, mixing, parity_join, suffix_dedup


def bounded(stage):
    """The stage in batches of bounded size, as its executors share their memory with those of all other stages."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language id", bounded(langid.stage)),
    ("n-gram Jaccard join", bounded(parity_join.stage)),
    ("suffix-array dedup", bounded(suffix_dedup.stage)),
    ("benchmark decontamination", bounded(decontam.stage)),
    ("mixing", bounded(mixing.stage)),
]

#: The stages train a model, expand suffix intervals and compare sketches; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; what is between them goes to the shared folder that the session names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparkloom-pipeline-")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{root.rstrip('/')}/pipeline-{uuid.uuid4().hex}-{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

"""Writers of the text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value): the columns of each row, separated by spaces."""
    return df.select(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)).alias("value"))


def write_edges(df: DataFrame, path: str, *columns: str) -> None:
    edge_lines(df, *columns).write.text(path)


def write_contigs(contigs: DataFrame, path: str) -> None:
    """FASTA: a header with the length, then the sequence."""
    contigs.select(F.concat(F.lit(">contig_l_"), F.length("contig"), F.lit("\n"), F.col("contig")).alias("value")).write.text(path)


def write_records(df: DataFrame, path: str) -> None:
    """Property-graph records as comma-separated values; null is empty."""
    df.withColumn("date", F.date_format("date", "M/d/yyyy")).write.csv(path, nullValue="", emptyValue="")


def write_weights(weights: dict, path: str, spark) -> None:
    rows = [(name, list(value.shape), [float(x) for x in value.reshape(-1)]) for name, value in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>").write.parquet(path)


def read_weights(spark, path: str) -> dict:
    import numpy as np

    return {r["name"]: np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}

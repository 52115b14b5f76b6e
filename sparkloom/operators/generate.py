"""Samples, expansions and the Monte-Carlo smoke program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import draws, running


def systematic(df: DataFrame, key: str, skip: int, planted: list | None = None) -> DataFrame:
    """Every skip-th row in the order of a unique number, and the planted ones."""
    placed = running(df, key, F.lit(1), "__nth")
    keep = F.col("__nth") % skip == 0
    if planted:
        keep = keep | F.col(key).isin(*planted)
    return placed.where(keep).drop("__nth")


def closure(t: dict[str, DataFrame], sampled_sales: DataFrame, sampled_events: DataFrame) -> dict[str, DataFrame]:
    """What touches the sample: people of the sales, and authors, topics and forums of the events."""
    events = sampled_events.select("id").distinct()
    author = t["author"].where("item_type = 'FORUMEVENT'").join(events.withColumnRenamed("id", "item"), "item", "left_semi")
    topics = t["has_topic"].where("item_type = 'FORUMEVENT'").join(events.withColumnRenamed("id", "item"), "item", "left_semi")
    people = sampled_sales.select(F.col("seller").alias("id")).union(sampled_sales.select("buyer")).union(author.select("person")).distinct()
    return {"sale": sampled_sales, "forum_event": sampled_events, "author": author, "has_topic": topics, "person": people}


def expand(spark: SparkSession, sale: DataFrame, factor: int, persons: int, seed: int = 5) -> DataFrame:
    """n * (factor - 1) further sales: ids as in the given ones with one in twenty new, dates over 8050 days from 2000."""
    n = sale.count()
    new = spark.range(n * max(0, factor - 1)).withColumnRenamed("id", "i")
    u = lambda k: draws(F.col("i"), seed + k)
    person = lambda k: F.when(u(k) < 0.05, persons + F.floor(u(k + 1) * persons * 0.05)).otherwise(F.floor(u(k + 2) * persons)).cast("long")
    kinds = [r[0] for r in sale.select("product").distinct().orderBy("product").limit(1000).collect()]
    product = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.floor(u(20) * len(kinds)) + 1).cast("int"))
    return new.select(person(1).alias("seller"), person(7).alias("buyer"), product.alias("product"), F.date_add(F.lit("2000-01-01").cast("date"), F.floor(u(21) * 8050).cast("int")).alias("date"))


def pi(spark: SparkSession, n: int, seed: int = 9) -> DataFrame:
    """(estimate): four times the share of points of the unit square inside of the circle."""
    x, y = draws(F.col("id"), seed), draws(F.col("id"), seed + 1)
    return spark.range(n).select((x * x + y * y <= 1).cast("long").alias("hit")).agg((4.0 * F.sum("hit") / F.count(F.lit(1))).alias("estimate"))

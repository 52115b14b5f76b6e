"""Multi-hop reasoning over a knowledge graph: translation scores and chained top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import translation_score

GENERIC = (22174494, 20039, 2095, 1065, 20195, 19567, 33506)
LOWEST = -3.4028234663852886e38


def persons(triples: DataFrame, award: int) -> DataFrame:
    return triples.where(F.col("rel") == award).select(F.col("src").alias("id")).distinct()


def universities(triples: DataFrame, affiliated: int, excluded=GENERIC) -> DataFrame:
    return triples.where((F.col("rel") == affiliated) & ~F.col("dst").isin(*excluded)).select(F.col("dst").alias("id")).distinct()


def top_k(candidates: DataFrame, entities: DataFrame, relation: DataFrame, other: DataFrame, k: int = 50) -> DataFrame:
    """(id, score): candidates as heads of (candidate, relation, other), best first, ties by id.

    relation and other are one-row tables (embedding). A candidate without an embedding has the lowest score.
    """
    r, t = relation.select(F.col("embedding").alias("r")).limit(1), other.select(F.col("embedding").alias("t")).limit(1)
    rows = candidates.join(entities, "id", "left").join(F.broadcast(r)).join(F.broadcast(t))
    scored = rows.select("id", F.coalesce(translation_score(F.col("embedding"), F.col("r"), F.col("t")), F.lit(LOWEST)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def best_affiliation(heads: DataFrame, entities: DataFrame, relation: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place, score): of each head the place with the best score; heads are a top-k, so their number is bounded."""
    r = relation.select(F.col("embedding").alias("r")).limit(1)
    h = heads.select("id").join(entities, "id").select("id", F.col("embedding").alias("h"))
    t = places.select("id").join(entities, "id").select(F.col("id").alias("place"), F.col("embedding").alias("t"))
    scored = t.join(F.broadcast(h)).join(F.broadcast(r)).select("id", "place", translation_score(F.col("h"), F.col("r"), F.col("t")).alias("score"))
    best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("place")).alias("p"))).alias("b"))
    return best.select("id", (-F.col("b.p")).alias("place"), F.col("b.score").alias("score"))


def exact_three_way(triples: DataFrame, award: int, prize: int, works: int, topic: int, affiliated: int) -> DataFrame:
    """(id, place): who has the prize, works in the topic, and is affiliated with the place."""
    a = triples.where((F.col("rel") == award) & (F.col("dst") == prize)).select(F.col("src").alias("id"))
    w = triples.where((F.col("rel") == works) & (F.col("dst") == topic)).select(F.col("src").alias("id"))
    p = triples.where(F.col("rel") == affiliated).select(F.col("src").alias("id"), F.col("dst").alias("place"))
    return a.join(w, "id", "left_semi").join(p, "id").distinct()


def best_per_group(df: DataFrame, group: str, *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("__n = 1").drop("__n")

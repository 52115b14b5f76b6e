"""The property graph, market, knowledge graph and reads, read off the relational tables.

Sales are line items; forums are groups of event keys; a forum event is all that happens in a forum on one day, its topics
the kinds of events; publications are parts, written by their suppliers; organizations are nations on a made-up map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Pattern

PATTERN = Pattern("SMALL", "LARGE", "PROMO", "MEDIUM", "centre", ("click", "view", "signup"), ("purchase", "signup"), "error", "engineering")

SQL = r"""
sale AS (SELECT l_suppkey AS seller, o_custkey AS buyer, p_type AS product, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
post AS (SELECT event_id, user_id AS person, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS forum,
  (CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10) * 1000 + day(ts) AS item, CAST(ts - INTERVAL 25 YEAR AS DATE) AS date, event_type AS topic, ts FROM events),
author AS (SELECT person, item, 'FORUMEVENT' AS item_type FROM post UNION ALL SELECT DISTINCT l_suppkey, l_partkey, 'PUBLICATION' FROM lineitem),
forum_event AS (SELECT item AS id, forum, min(date) AS date FROM post GROUP BY item, forum),
has_topic AS (SELECT item, 'FORUMEVENT' AS item_type, topic FROM post
  UNION ALL SELECT DISTINCT forum, 'FORUM', CASE WHEN forum % 2 = 0 THEN 'centre' ELSE 'elsewhere' END FROM post
  UNION ALL SELECT p_partkey, 'PUBLICATION', CASE WHEN p_size % 5 = 0 THEN 'engineering' ELSE p_brand END FROM part),
has_org AS (SELECT p_partkey AS publication, p_size % 25 AS organization FROM part),
topic AS (SELECT n_nationkey AS id, 40.67 + (n_nationkey - 12) * 4.0 AS lat, -73.94 + (n_regionkey - 2) * 12.0 AS lon FROM nation)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("seller"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("amount"))
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("buyer"))
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product"))
    return lines.join(orders, "l_orderkey").join(part, "l_partkey").select("seller", "buyer", "product", "date", "amount")


def posts(events: DataFrame) -> DataFrame:
    """(event_id, person, forum, item, date, topic, ts); also over a stream of events."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return events.select(
        "event_id", F.col("user_id").alias("person"), (k % 10).alias("forum"), ((k % 10) * 1000 + F.dayofmonth("ts")).alias("item"),
        F.expr("CAST(ts - INTERVAL 25 YEAR AS DATE)").alias("date"), F.col("event_type").alias("topic"), "ts",
    )


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    post = posts(_read(spark, sf_dir, "events"))
    part = _read(spark, sf_dir, "part")
    wrote = _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_partkey").alias("item")).distinct()
    forum_topics = post.select(F.col("forum").alias("item")).distinct().select("item", F.lit("FORUM").alias("item_type"), F.when(F.col("item") % 2 == 0, "centre").otherwise("elsewhere").alias("topic"))
    about = part.select(F.col("p_partkey").alias("item"), F.lit("PUBLICATION").alias("item_type"), F.when(F.col("p_size") % 5 == 0, "engineering").otherwise(F.col("p_brand")).alias("topic"))
    nation = _read(spark, sf_dir, "nation")
    return {
        "sale": sale(spark, sf_dir),
        "post": post,
        "author": post.select("person", "item", F.lit("FORUMEVENT").alias("item_type")).unionByName(wrote.withColumn("item_type", F.lit("PUBLICATION"))),
        "forum_event": post.groupBy(F.col("item").alias("id"), "forum").agg(F.min("date").alias("date")),
        "has_topic": post.select("item", F.lit("FORUMEVENT").alias("item_type"), "topic").unionByName(forum_topics).unionByName(about),
        "has_org": part.select(F.col("p_partkey").alias("publication"), (F.col("p_size") % 25).alias("organization")),
        "topic": nation.select(F.col("n_nationkey").alias("id"), (40.67 + (F.col("n_nationkey") - 12) * 4.0).alias("lat"), (-73.94 + (F.col("n_regionkey") - 2) * 12.0).alias("lon")),
    }


GRAPH_SQL = r"""
fwd AS (
  SELECT seller AS src, 1000000 + buyer AS dst, 'SALE' AS type, 'PERSON' AS src_type, 'PERSON' AS dst_type FROM sale WHERE product IN ('SMALL', 'PROMO')
  UNION ALL SELECT 1000000 + person, 2000000 + item, 'AUTHOR', 'PERSON', 'FORUMEVENT' FROM post
  UNION ALL SELECT 3000000 + forum, 2000000 + id, 'INCLUDES', 'FORUM', 'FORUMEVENT' FROM forum_event
  UNION ALL SELECT 2000000 + item, 4000000 + length(topic), 'HASTOPIC', 'FORUMEVENT', 'TOPIC' FROM post
  UNION ALL SELECT 5000000 + publication, 4000100 + organization, 'HASORG', 'PUBLICATION', 'TOPIC' FROM has_org),
edges AS (SELECT * FROM fwd UNION ALL SELECT dst, src, CASE type WHEN 'SALE' THEN 'PURCHASE' WHEN 'AUTHOR' THEN 'WRITTENBY' WHEN 'INCLUDES' THEN 'INCLUDEDIN' WHEN 'HASTOPIC' THEN 'TOPICIN' ELSE 'ORGIN' END, dst_type, src_type FROM fwd)"""


def graph_edges(t: dict[str, DataFrame]) -> DataFrame:
    """The uniform graph: kinds of vertices are kept apart by millions."""
    from .files import with_reverse

    one = lambda df, src, dst, kind, a, b: df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), F.lit(kind).alias("type"), F.lit(a).alias("src_type"), F.lit(b).alias("dst_type"))
    c = F.col
    return with_reverse([
        one(t["sale"].where(c("product").isin("SMALL", "PROMO")), c("seller"), c("buyer") + 1000000, "SALE", "PERSON", "PERSON"),
        one(t["post"], c("person") + 1000000, c("item") + 2000000, "AUTHOR", "PERSON", "FORUMEVENT"),
        one(t["forum_event"], c("forum") + 3000000, c("id") + 2000000, "INCLUDES", "FORUM", "FORUMEVENT"),
        one(t["post"], c("item") + 2000000, F.length("topic") + 4000000, "HASTOPIC", "FORUMEVENT", "TOPIC"),
        one(t["has_org"], c("publication") + 5000000, c("organization") + 4000100, "HASORG", "PUBLICATION", "TOPIC"),
    ])

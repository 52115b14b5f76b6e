"""Readers of the delimited inputs. Bad numbers and dates become null; comment and header lines are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.scalar import us_date


def records(spark: SparkSession, path: str) -> DataFrame:
    """Property-graph records, ten columns each, of any kind."""
    raw = spark.read.csv(path, schema=schema.RECORDS, comment="#", quote="")
    return typed_records(raw)


def typed_records(raw: DataFrame) -> DataFrame:
    ids = [F.expr(f"try_cast({c} AS bigint)").alias(c) for c in ("person1", "person2", "forum", "forum_event", "publication", "topic")]
    return raw.select(F.trim("type").alias("type"), *ids, us_date(F.col("date")).alias("date"), F.expr("try_cast(lat AS double)").alias("lat"), F.expr("try_cast(lon AS double)").alias("lon"))


def views(rows: DataFrame) -> dict[str, DataFrame]:
    """One table for each kind of record; the filter on `type` reaches the scan."""
    of = lambda kind: rows.where(F.col("type") == kind)
    target = lambda first, *cols: (F.coalesce(*cols).alias("item"), first)
    return {
        "person": of("Person").select(F.col("person1").alias("id")),
        "forum": of("Forum").select(F.col("forum").alias("id")),
        "forum_event": of("ForumEvent").select(F.col("forum_event").alias("id"), "forum", "date"),
        "publication": of("Publication").select(F.col("publication").alias("id"), "date"),
        "topic": of("Topic").select(F.col("topic").alias("id"), "lat", "lon"),
        "sale": of("Sale").select(F.col("person1").alias("seller"), F.col("person2").alias("buyer"), F.col("topic").alias("product"), "date"),
        "author": of("Author").select(
            F.col("person1").alias("person"),
            *target(
                F.when(F.col("forum_event").isNotNull(), "FORUMEVENT").when(F.col("publication").isNotNull(), "PUBLICATION").when(F.col("forum").isNotNull(), "FORUM").alias("item_type"),
                "forum_event", "publication", "forum",
            ),
        ),
        "includes": of("Includes").select("forum", "forum_event"),
        "has_topic": of("HasTopic").select(
            *target(F.when(F.col("forum").isNotNull(), "FORUM").when(F.col("forum_event").isNotNull(), "FORUMEVENT").otherwise("PUBLICATION").alias("item_type"), "forum", "forum_event", "publication"), "topic"
        ),
        "has_org": of("HasOrg").select("publication", F.col("topic").alias("organization")),
    }


def uniform_edges(v: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, type, src_type, dst_type): every edge and its reverse."""
    one = lambda df, src, dst, kind, st, dt: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), st.alias("src_type"), dt.alias("dst_type"))
    lit = F.lit
    forward = [
        one(v["sale"], "seller", "buyer", "SALE", lit("PERSON"), lit("PERSON")),
        one(v["author"], "person", "item", "AUTHOR", lit("PERSON"), F.col("item_type")),
        one(v["includes"], "forum", "forum_event", "INCLUDES", lit("FORUM"), lit("FORUMEVENT")),
        one(v["has_topic"], "item", "topic", "HASTOPIC", F.col("item_type"), lit("TOPIC")),
        one(v["has_org"], "publication", "organization", "HASORG", lit("PUBLICATION"), lit("TOPIC")),
    ]
    return with_reverse(forward)


REVERSE = {"SALE": "PURCHASE", "AUTHOR": "WRITTENBY", "INCLUDES": "INCLUDEDIN", "HASTOPIC": "TOPICIN", "HASORG": "ORGIN"}


def with_reverse(forward: list[DataFrame]) -> DataFrame:
    edges = forward[0]
    for f in forward[1:]:
        edges = edges.unionByName(f)
    name = F.create_map(*[F.lit(x) for p in REVERSE.items() for x in p])
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), name[F.col("type")].alias("type"), F.col("dst_type").alias("src_type"), F.col("src_type").alias("dst_type"))
    return edges.unionByName(back)


def social(spark: SparkSession, path: str) -> DataFrame:
    """Friendships, each in both directions."""
    one = spark.read.csv(path, schema=schema.SOCIAL, comment="#")
    return one.union(one.select("person2", "person1"))


def cyber(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schema.CYBER, comment="#")


def uses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schema.USES, comment="#")


def commercial(spark: SparkSession, path: str) -> DataFrame:
    """(seller, buyer, product, date, amount)."""
    raw = spark.read.csv(path, schema=schema.COMMERCIAL, comment="#", quote="")
    long = lambda c: F.expr(f"try_cast({c} AS bigint)").alias(c)
    return raw.select(long("seller"), long("buyer"), long("product"), us_date(F.col("date")).alias("date"), F.expr("try_cast(amount AS double)").alias("amount"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(read): the sequence lines."""
    return spark.read.text(path).where(~F.col("value").startswith(">") & (F.length("value") > 0)).select(F.trim("value").alias("read"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=schema.TRIPLES, header=True).select("src", "rel", "dst")


def partitioned_triples(df: DataFrame, path: str) -> None:
    """Written by relation, so that a query reads only the relations that it names."""
    df.repartition("rel").write.partitionBy("rel").parquet(path)


def embedding_file(spark: SparkSession, path: str, width: int = 450) -> DataFrame:
    """(id, embedding): the first `width` numbers after the id of each line; a header line is skipped."""
    parts = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).select(F.expr("try_cast(element_at(split(value, '\\\\s*,\\\\s*'), 1) AS bigint)").alias("id"), F.transform(F.slice(parts, 2, width), lambda x: x.cast("float")).alias("embedding"))
    return rows.where("id IS NOT NULL")


def influencers(spark: SparkSession, path: str) -> DataFrame:
    """(id): the seeds of the first entry."""
    raw = spark.read.schema("Seeds array<bigint>").json(path, multiLine=True)
    return raw.select(F.explode("Seeds").alias("id"))


def split_file(spark: SparkSession, path: str) -> DataFrame:
    """Node lines `id <tab> features <tab> label` with comma-separated features."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where(~F.col("value").startswith("node_id")).select(parts[0].cast("long").alias("id"), F.transform(F.split(parts[1], ","), lambda x: x.cast("float")).alias("features"), parts[2].cast("int").alias("label"))

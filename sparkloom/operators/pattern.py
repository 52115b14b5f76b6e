"""The multi-relation temporal pattern: people whose purchases, posts and suppliers' publications fit together.

Tables: sale (seller, buyer, product, date), author (person, item, item_type), forum_event (id, forum, date),
has_topic (item, item_type, topic), has_org (publication, organization), topic (id, lat, lon).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import near
from ..schema import Pattern


def bits(column: Column, values) -> Column:
    """Bit i where the column is values[i]."""
    return F.bit_or(reduce(lambda c, iv: c.when(column == iv[1], 1 << iv[0]), enumerate(values), F.when(F.lit(False), 0)).otherwise(0))


def distributors(sale: DataFrame, p: Pattern) -> DataFrame:
    """Sellers of ammunition to two people or more. Counting minimum and maximum keeps one row for each task and seller."""
    own = sale.where(F.col("product") == p.ammunition).groupBy("seller").agg(F.min("buyer").alias("a"), F.max("buyer").alias("b"))
    return own.where("a <> b").select("seller")


def distributor_buyers(sale: DataFrame, p: Pattern) -> DataFrame:
    """(buyer, date) of ammunition bought from someone who also sold some to another person."""
    return sale.where(F.col("product") == p.ammunition).join(distributors(sale, p), "seller", "left_semi").select("buyer", "date")


def class_dates(sale: DataFrame, p: Pattern) -> DataFrame:
    """For each buyer the last date of each product class, ammunition only from distributors, and whether electronics were bought."""
    wanted = sale.where(F.col("product").isin(p.bath_bomb, p.pressure_cooker, p.ammunition, p.electronics))
    known = distributors(sale, p).withColumn("distributor", F.lit(True))
    joined = wanted.join(known, "seller", "left")
    last = lambda cond: F.max(F.when(cond, F.col("date")))
    return joined.groupBy("buyer").agg(
        last(F.col("product") == p.bath_bomb).alias("bb"), last(F.col("product") == p.pressure_cooker).alias("pc"),
        last((F.col("product") == p.ammunition) & F.col("distributor")).alias("am"), F.max((F.col("product") == p.electronics).cast("int")).alias("el"),
    )


def qualified_buyers(sale: DataFrame, p: Pattern) -> DataFrame:
    """(person, trans_date) of buyers of all four classes; the date is the least of the three last dates."""
    rows = class_dates(sale, p).where("bb IS NOT NULL AND pc IS NOT NULL AND am IS NOT NULL AND el = 1")
    return rows.select(F.col("buyer").alias("person"), F.least("bb", "pc", "am").alias("trans_date"))


def near_topics(topic: DataFrame, p: Pattern) -> DataFrame:
    """(id) of topics near the centre."""
    return topic.where(near(F.col("lat"), F.col("lon"), p.centre_lat, p.centre_lon, p.miles)).select("id")


def engineering_sellers(t: dict[str, DataFrame], p: Pattern) -> DataFrame:
    """People who wrote a publication on electrical engineering that has an organization near the centre."""
    about = t["has_topic"].where((F.col("item_type") == "PUBLICATION") & (F.col("topic") == p.engineering)).select(F.col("item").alias("publication"))
    close = t["has_org"].join(near_topics(t["topic"], p).withColumnRenamed("id", "organization"), "organization", "left_semi").select("publication")
    wrote = t["author"].where(F.col("item_type") == "PUBLICATION").select("person", F.col("item").alias("publication"))
    return wrote.join(about, "publication", "left_semi").join(close, "publication", "left_semi").select(F.col("person").alias("seller")).distinct()


def electronics_witness(t: dict[str, DataFrame], p: Pattern) -> DataFrame:
    """Buyers of electronics from such a seller."""
    bought = t["sale"].where(F.col("product") == p.electronics).select("seller", "buyer")
    return bought.join(engineering_sellers(t, p), "seller", "left_semi").select(F.col("buyer").alias("person")).distinct()


def item_bitmask(has_topic: DataFrame, p: Pattern) -> DataFrame:
    """(item, fe4, fe5, jihad) of forum events: bits of the topics that each has."""
    own = has_topic.where(F.col("item_type") == "FORUMEVENT").where(F.col("topic").isin(*p.event_topics, *p.outdoor_topics, p.jihad))
    c = F.col("topic")
    return own.groupBy("item").agg(bits(c, p.event_topics).alias("fe4"), bits(c, p.outdoor_topics).alias("fe5"), F.max((c == p.jihad).cast("int")).alias("jihad"))


def forum_state(t: dict[str, DataFrame], p: Pattern) -> DataFrame:
    """(forum, fe4, fe5, nyc, jihad, fe4_date): what is known of each forum from its events and its own topics."""
    mask = item_bitmask(t["has_topic"], p)
    events = mask.join(t["forum_event"].withColumnRenamed("id", "item"), "item")
    full4, full5 = (1 << len(p.event_topics)) - 1, (1 << len(p.outdoor_topics)) - 1
    per = events.groupBy("forum").agg(
        F.bool_or(F.col("fe4") == full4).alias("fe4"), F.bool_or(F.col("fe5") == full5).alias("fe5"),
        F.sum("jihad").cast("long").alias("jihad"), F.min(F.when(F.col("fe4") == full4, F.col("date"))).alias("fe4_date"),
    )
    local = t["has_topic"].where((F.col("item_type") == "FORUM") & (F.col("topic") == p.centre)).select(F.col("item").alias("forum")).distinct().withColumn("nyc", F.lit(True))
    out = per.join(local, "forum", "full")
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select("forum", false("fe4"), false("fe5"), false("nyc"), F.coalesce("jihad", F.lit(0).cast("long")).alias("jihad"), "fe4_date")


def exact_match(t: dict[str, DataFrame], p: Pattern) -> DataFrame:
    """(person): everyone who matches the whole pattern."""
    buyers = qualified_buyers(t["sale"], p).join(electronics_witness(t, p), "person", "left_semi")
    wrote = t["author"].where(F.col("item_type") == "FORUMEVENT").select("person", F.col("item").alias("id"))
    posts = wrote.join(t["forum_event"], "id").select("person", "forum").distinct().join(forum_state(t, p), "forum")
    joined = buyers.join(posts, "person")
    ok = joined.groupBy("person").agg(
        F.bool_or(F.col("nyc") & (F.col("jihad") > 1)).alias("first"),
        F.bool_or(F.col("fe4") & F.col("fe5") & (F.col("fe4_date") < F.col("trans_date"))).alias("second"),
    )
    return ok.where("first AND second").select("person")


def repeat_authors(t: dict[str, DataFrame], p: Pattern) -> DataFrame:
    """(person, forum, n): authors of two or more distinct events on the topic in one forum."""
    about = t["has_topic"].where((F.col("item_type") == "FORUMEVENT") & (F.col("topic") == p.jihad)).select("item").distinct()
    wrote = t["author"].where(F.col("item_type") == "FORUMEVENT").select("person", "item").distinct().join(about, "item", "left_semi")
    per = wrote.join(t["forum_event"].withColumnRenamed("id", "item"), "item").groupBy("person", "forum").agg(F.count(F.lit(1)).alias("n"))
    return per.where("n >= 2")


def partial_match(t: dict[str, DataFrame], p: Pattern) -> DataFrame:
    """(person): the final answer of the incrementally kept pattern, whose rules differ from the exact one.

    The purchase date is the last one over all four classes; an event date is the first of either kind of forum event;
    the two events must be written by the person in one forum, whose topic rows are counted; a publication needs both flags.
    """
    sale = t["sale"].where(F.col("product").isin(p.bath_bomb, p.pressure_cooker, p.ammunition, p.electronics))
    known = distributors(t["sale"], p).withColumn("distributor", F.lit(True))
    kinds = (p.bath_bomb, p.pressure_cooker, p.ammunition, p.electronics)
    sold = sale.join(known, "seller", "left").where((F.col("product") != p.ammunition) | F.col("distributor"))
    buyers = sold.groupBy("buyer").agg(bits(F.col("product"), kinds).alias("mask"), F.max("date").alias("last")).where("mask = 15").select(F.col("buyer").alias("person"), "last")
    mask = item_bitmask(t["has_topic"], p)
    full4, full5 = (1 << len(p.event_topics)) - 1, (1 << len(p.outdoor_topics)) - 1
    events = t["forum_event"].withColumnRenamed("id", "item")
    both = mask.join(events, "item").where((F.col("fe4") == full4) | (F.col("fe5") == full5))
    forums = both.groupBy("forum").agg(F.bool_or(F.col("fe4") == full4).alias("a"), F.bool_or(F.col("fe5") == full5).alias("b"), F.min("date").alias("first")).where("a AND b").select("forum", "first")
    rows = t["has_topic"].where((F.col("item_type") == "FORUMEVENT") & (F.col("topic") == p.jihad)).join(events, "item").groupBy("forum").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("forum")
    local = t["has_topic"].where((F.col("item_type") == "FORUM") & (F.col("topic") == p.centre)).select(F.col("item").alias("forum")).distinct()
    repeat = repeat_authors(t, p).join(rows, "forum", "left_semi").join(local, "forum", "left_semi").select("person").distinct()
    wrote = t["author"].where(F.col("item_type") == "FORUMEVENT").select("person", "item").join(events.select("item", "forum"), "item").select("person", "forum").distinct()
    dated = wrote.join(forums, "forum").groupBy("person").agg(F.min("first").alias("first"))
    out = buyers.join(electronics_witness(t, p), "person", "left_semi").join(repeat, "person", "left_semi").join(dated, "person")
    return out.where("first < last").select("person")


def type_statistics(rows: DataFrame) -> DataFrame:
    """(type, n, share) of records by kind."""
    n = rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("type", "n", (F.col("n") / F.sum("n").over(_all())).alias("share"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))

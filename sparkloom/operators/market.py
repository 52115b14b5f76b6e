"""A product's market: traders, weighted edges of sales, friends, servers and traffic, and the loss of key traders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DISTRIBUTOR, PRODUCER, RETAILER


def market_sales(sale: DataFrame, product) -> DataFrame:
    """Sales of the product between two people; a sale to oneself is production."""
    return sale.where((F.col("product") == product) & (F.col("seller") != F.col("buyer")))


def traders(sale: DataFrame, product) -> DataFrame:
    """(id, sold, bought, desired, type): the type is the largest of a trader's roles."""
    own = sale.where(F.col("product") == product)
    zero, amount = F.lit(0.0), F.col("amount")
    made = own.where("seller = buyer").select(F.col("seller").alias("id"), zero.alias("sold"), amount.alias("bought"), zero.alias("desired"), F.lit(PRODUCER).alias("type"))
    sells = own.where("seller <> buyer").select("seller", amount, zero, zero, F.lit(DISTRIBUTOR))
    buys = own.where("seller <> buyer").select("buyer", zero, amount, amount, F.lit(RETAILER))
    return made.union(sells).union(buys).groupBy("id").agg(F.sum("sold").alias("sold"), F.sum("bought").alias("bought"), F.sum("desired").alias("desired"), F.max("type").alias("type"))


def sale_weights(sale: DataFrame, product) -> DataFrame:
    """(seller, buyer, date, amount, weight): each sale's part of what its seller sold."""
    total = market_sales(sale, product).groupBy("seller").agg(F.sum("amount").alias("total"))
    return market_sales(sale, product).join(total, "seller").select("seller", "buyer", "date", "amount", (F.col("amount") / F.col("total")).alias("weight"))


def friends(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(person1, person2, weight): friendships among traders, by the person's number of them."""
    ids = known.select("id")
    inside = pairs.join(ids.withColumnRenamed("id", "person1"), "person1", "left_semi").join(ids.withColumnRenamed("id", "person2"), "person2", "left_semi")
    degree = inside.groupBy("person1").agg(F.count(F.lit(1)).alias("d"))
    return inside.join(degree, "person1").select("person1", "person2", (1.0 / F.col("d")).alias("weight"))


def uses(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(person, server, weight) of traders."""
    inside = pairs.join(known.select(F.col("id").alias("person")), "person", "left_semi")
    degree = inside.groupBy("person").agg(F.count(F.lit(1)).alias("d"))
    return inside.join(degree, "person").select("person", "server", (1.0 / F.col("d")).alias("weight"))


def sends(flows: DataFrame, used: DataFrame) -> DataFrame:
    """(src_device, dst_device, weight) among the servers in use: a pair's part of its source's flows."""
    servers = used.select("server").distinct()
    inside = flows.join(servers.withColumnRenamed("server", "src_device"), "src_device", "left_semi").join(servers.withColumnRenamed("server", "dst_device"), "dst_device", "left_semi")
    pairs = inside.groupBy("src_device", "dst_device").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("src_device", "dst_device", (F.col("n") / F.sum("n").over(Window.partitionBy("src_device"))).alias("weight"))


def simple_edges(sale: DataFrame, product) -> DataFrame:
    return sale_weights(sale, product).select("seller", "buyer", "weight")


def complex_edges(sale: DataFrame, product) -> DataFrame:
    """(seller, seller_type, buyer, buyer_type, weight)."""
    kinds = traders(sale, product).select("id", "type")
    out = sale_weights(sale, product).join(kinds.select(F.col("id").alias("seller"), F.col("type").alias("seller_type")), "seller")
    out = out.join(kinds.select(F.col("id").alias("buyer"), F.col("type").alias("buyer_type")), "buyer")
    return out.select("seller", "seller_type", "buyer", "buyer_type", "weight")


def without_influencers(sale: DataFrame, product, influencers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The market's sales once the influencers are gone, and the new sales by which customers replaced theirs.

    Influencers lose all their sales and purchases. Each of their customers then asks its other suppliers, in the order
    (seller, date, amount), for what it lacks; a supplier gives no more than it bought and didn't sell. A supplier's
    stock is shared out among its askers in the order of their ids, as one running sum, so nothing is done one by one:
    a customer asks every supplier at once for the part of its need that the stock of those before it cannot cover.
    """
    sales = market_sales(sale, product)
    gone = influencers.select("id").distinct()
    kept = sales.join(gone.withColumnRenamed("id", "seller"), "seller", "left_anti").join(gone.withColumnRenamed("id", "buyer"), "buyer", "left_anti")
    lost = sales.join(gone.withColumnRenamed("id", "seller"), "seller", "left_semi").join(gone.withColumnRenamed("id", "buyer"), "buyer", "left_anti")
    need = lost.groupBy("buyer").agg(F.sum("amount").alias("need"))
    after = kept.select(F.col("seller").alias("id"), F.col("amount").alias("sold"), F.lit(0.0).alias("bought"))
    after = after.union(kept.select("buyer", F.lit(0.0), "amount"))
    made = sale.where((F.col("product") == product) & (F.col("seller") == F.col("buyer"))).select("seller", F.lit(0.0), "amount")
    stock = after.union(made).groupBy("id").agg((F.sum("bought") - F.sum("sold")).alias("slack")).where("slack > 0").select(F.col("id").alias("seller"), "slack")
    asks = kept.join(need, "buyer").groupBy("buyer", "seller", "need").agg(F.min(F.struct("date", "amount")).alias("o")).join(stock, "seller")
    order = Window.partitionBy("buyer").orderBy("seller", "o")
    asks = asks.withColumn("want", F.least("slack", F.col("need") - F.coalesce(F.sum("slack").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))).where("want > 0")
    queue = Window.partitionBy("seller").orderBy("buyer").rowsBetween(Window.unboundedPreceding, -1)
    given = asks.withColumn("left", F.col("slack") - F.coalesce(F.sum("want").over(queue), F.lit(0.0)))
    new = given.select("seller", "buyer", F.least("want", "left").alias("amount")).where("amount > 0")
    return kept, new


def adjusted(sale: DataFrame, product, influencers: DataFrame) -> DataFrame:
    """(seller, buyer, date, amount): the market afterwards; new sales have no date."""
    kept, new = without_influencers(sale, product, influencers)
    return kept.select("seller", "buyer", "date", "amount").union(new.select("seller", "buyer", F.lit(None).cast("date"), "amount"))


def cancel_one(sales: DataFrame, cancelled: DataFrame) -> DataFrame:
    """sales less one row for each row of cancelled with equal seller, buyer, date and amount."""
    keys = ["seller", "buyer", "date", "amount"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    left, right = sales.withColumn("nth", nth), cancelled.select(*keys).withColumn("nth", nth)
    cond = [left[k].eqNullSafe(right[k]) for k in [*keys, "nth"]]
    return left.join(right, cond, "left_anti").drop("nth")


def influential(edges: DataFrame, k: int, samples: int = 400, seed: int = 3) -> list[int]:
    """k seeds by reverse-reachable sets under independent cascades; edges (src, dst, weight).

    Sets grow backward from drawn targets, all samples at once; greedy cover is then k aggregations, each over the sets
    that no seed has met so far.
    """
    ids = edges.select(F.col("dst").alias("node")).distinct()
    n = ids.count()
    if not n:
        return []
    draw = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    ranked = ids.withColumn("u", draw(F.col("node"), F.lit("t"))).orderBy("u", "node").limit(samples)
    front = ranked.select(F.xxhash64("node").alias("set"), "node")
    sets = front
    for _ in range(6):
        got = front.join(edges, front["node"] == edges["dst"]).where(draw(F.col("set"), F.col("src"), F.col("dst")) < F.col("weight"))
        front = got.select("set", F.col("src").alias("node")).distinct().join(sets, ["set", "node"], "left_anti")
        sets = sets.union(front)
    sets = sets.cache()
    out: list[int] = []
    left = sets
    for _ in range(k):
        best = left.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").first()
        if best is None:
            break
        out.append(best["node"])
        left = left.join(sets.where(F.col("node") == best["node"]).select("set"), "set", "left_anti")
    sets.unpersist()
    return out

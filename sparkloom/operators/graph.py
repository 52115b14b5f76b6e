"""Uniform typed graphs: dense ids, compressed adjacency, structural features, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import checkpointed
from ..schema import EDGE_TYPES, VERTEX_TYPES

BUCKETS = 1024


def running(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows with a smaller `order`, a unique number.

    Rows are summed in ranges of the number, and only the ranges' totals, of which there are BUCKETS, along the whole.
    """
    ends = df.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    width = F.floor((F.col("__hi") - F.col("__lo")) / BUCKETS) + 1
    placed = df.withColumn("__v", value).join(F.broadcast(ends)).withColumn("__b", F.floor((F.col(order) - F.col("__lo")) / width))
    totals = placed.groupBy("__b").agg(F.sum("__v").alias("__t"))
    before = totals.select("__b", (F.sum("__t").over(Window.orderBy("__b")) - F.col("__t")).alias("__before"))
    inner = F.sum("__v").over(Window.partitionBy("__b").orderBy(order)) - F.col("__v")
    return placed.join(F.broadcast(before), "__b").withColumn(name, (inner + F.col("__before")).cast("long")).drop("__v", "__lo", "__hi", "__b", "__before")


def vertices(edges: DataFrame) -> DataFrame:
    """(gid, id, vtype, degree, start): dense ids in the order of ids, out-degrees and the places of the first edges."""
    ends = edges.select(F.col("src").alias("id"), F.col("src_type").alias("vtype"), F.lit(1).alias("d")).union(edges.select("dst", "dst_type", F.lit(0)))
    unique = ends.groupBy("id").agg(F.min("vtype").alias("vtype"), F.sum("d").cast("long").alias("degree"))
    return running(running(unique, "id", F.lit(1), "gid"), "id", F.col("degree"), "start").select("gid", "id", "vtype", "degree", "start")


def csr_edges(edges: DataFrame) -> DataFrame:
    """(pos, src_gid, dst_gid, type): edges by source, then target and kind; equal edges lie side by side."""
    v = vertices(edges)
    src = v.select(F.col("id").alias("src"), F.col("gid").alias("src_gid"), "start")
    dst = v.select(F.col("id").alias("dst"), F.col("gid").alias("dst_gid"))
    joined = edges.join(src, "src").join(dst, "dst")
    nth = F.row_number().over(Window.partitionBy("src_gid").orderBy("dst_gid", "type"))
    return joined.select((F.col("start") + nth - 1).alias("pos"), "src_gid", "dst_gid", "type")


def one_hop(edges: DataFrame) -> DataFrame:
    """(id, f0 .. f14): of each source its edges by kind and by the kind of their target."""
    bins = [F.sum((F.col("type") == t).cast("long")).alias(f"f{i}") for i, t in enumerate(EDGE_TYPES)]
    bins += [F.sum((F.col("dst_type") == t).cast("long")).alias(f"f{len(EDGE_TYPES) + i}") for i, t in enumerate(VERTEX_TYPES)]
    return edges.groupBy(F.col("src").alias("id")).agg(*bins)


def two_hop(edges: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(id, g0 .. g14): the sum of the neighbours' one-hop features, a neighbour counting once for each edge.

    Parallel edges are counted before the join, so a hub's neighbours meet it once.
    """
    first = one_hop(edges) if first is None else first
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    joined = pairs.join(first.withColumnRenamed("id", "dst"), "dst")
    return joined.groupBy(F.col("src").alias("id")).agg(*[F.sum(F.col(f"f{i}") * F.col("m")).cast("long").alias(f"g{i}") for i in range(15)])


def features(edges: DataFrame) -> DataFrame:
    """(id, vtype, features): thirty numbers divided by the number of vertices; vertices without edges have zeros."""
    v = vertices(edges).select("id", "vtype")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    first = one_hop(edges)
    rows = v.join(first, "id", "left").join(two_hop(edges, first), "id", "left").join(F.broadcast(n))
    return rows.select("id", "vtype", F.array(*[F.coalesce(F.col(f"{p}{i}"), F.lit(0)) / F.col("n") for p in "fg" for i in range(15)]).alias("features"))


def draws(column: Column, seed: int, *more: Column) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone, so that a lost task draws the same again."""
    return F.pmod(F.xxhash64(column, *more, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def ego_sampled(edges: DataFrame, roots: DataFrame, fanouts: tuple[int, ...] = (3, 2, 1), seed: int = 1) -> DataFrame:
    """(root, src, dst): neighbourhoods with fan-out sampled with replacement; self-loops, and edges both ways once."""
    ranked = edges.select("src", "dst").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    ranked = checkpointed(ranked)
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    nodes, picked = front, None
    for hop, fan in enumerate(fanouts):
        asked = front.join(degree, front["node"] == degree["src"]).select("root", "node", "d", F.explode(F.sequence(F.lit(1), F.lit(fan))).alias("i"))
        asked = asked.withColumn("k", F.floor(draws(F.col("root"), seed, F.col("node"), F.col("i"), F.lit(hop)) * F.col("d")).cast("int"))
        got = asked.select("root", F.col("node").alias("src"), "k").join(ranked, ["src", "k"]).select("root", "src", "dst").distinct()
        got = checkpointed(got)  # each hop is read several times
        picked = got if picked is None else picked.union(got)
        front = checkpointed(got.select("root", F.col("dst").alias("node")).distinct().join(nodes, ["root", "node"], "left_anti"))
        nodes = nodes.union(front)
    loops = nodes.select("root", F.col("node").alias("src"), F.col("node").alias("dst"))
    return picked.union(picked.select("root", "dst", "src")).union(loops).distinct()


def ego_induced(edges: DataFrame, roots: DataFrame, levels: tuple[int, ...] = (4, 2)) -> DataFrame:
    """(root, src, dst): the first levels[l] neighbours of each node by id, hop by hop, and all edges among those found."""
    distinct = edges.select("src", "dst").distinct()
    ranked = distinct.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    nodes = front = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    for most in levels:
        got = front.join(ranked.where(F.col("k") <= most), front["node"] == ranked["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = checkpointed(got.join(nodes, ["root", "node"], "left_anti"))
        nodes = nodes.union(front)
    left, right = nodes.withColumnRenamed("node", "src"), nodes.withColumnRenamed("node", "dst")
    return left.join(distinct, "src").join(right, ["root", "dst"]).select("root", "src", "dst")


def true_edges(edges: DataFrame) -> DataFrame:
    """(a, b): undirected edges once, the smaller id first; loops are left out."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def edge_split(pairs: DataFrame, train: float = 0.85, validate: float = 0.05) -> DataFrame:
    """(a, b, part): pairs in the order of a digest of their ids; the first go to training, the next to validation."""
    key = F.md5(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    placed = pairs.withColumn("u", F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))
    return placed.select("a", "b", F.when(F.col("u") < train, "train").when(F.col("u") < train + validate, "validate").otherwise("test").alias("part"))


def false_edges(edges: DataFrame, per_vertex: int = 1, modulus: int = 7919) -> DataFrame:
    """(a, b): pairs of vertices that no edge joins, drawn by arithmetic on dense ids; each pair once."""
    v = vertices(edges).select("gid", "id")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    drawn = v.join(F.broadcast(n)).select("id", "n", "gid", F.explode(F.sequence(F.lit(1), F.lit(per_vertex))).alias("i"))
    drawn = drawn.select("id", ((F.col("gid") * modulus + F.col("i") * 104729 + 1) % F.col("n")).alias("gid"))
    pairs = drawn.join(v.withColumnRenamed("id", "other"), "gid").where("id <> other")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return pairs.join(true_edges(edges), ["a", "b"], "left_anti")


def batched(subgraphs: DataFrame, per_batch: int) -> DataFrame:
    """(batch, root, offset) of subgraphs (root, nodes): each one's first node number in its block-diagonal batch."""
    placed = running(subgraphs, "root", F.lit(1), "nth").withColumn("batch", F.floor(F.col("nth") / per_batch))
    return placed.select("batch", "root", (F.sum("nodes").over(Window.partitionBy("batch").orderBy("root")) - F.col("nodes")).alias("offset"))

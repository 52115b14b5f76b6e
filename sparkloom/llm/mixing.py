"""Mixing sources to target weights by temperature, with DataFrame functions only.

Each source's share of all tokens is raised to an exponent and the results are normalised. The exponent is bisected: the
smallest one (the flattest mixture) at which, with the best covered source seen once, no source is repeated more than
`repeats` times; or the one that gives a wanted entropy. The weights times the budget are the sources' quotas of tokens.

Quotas are realised as block permutations: a document's digest gives it a block of its source and a place in it. Whole
passes over a source take every document; the rest of a quota takes blocks in order, and of the block in which it ends
the documents in order, up to the one that would go beyond it. Blocks bound what is ordered in one place, so a source
with a third of all rows is no hot spot: only block totals are added up along a source.

Cases: a null source is a source of its own; null text or no words count 0 tokens and follow their source's whole passes;
rows with a null doc_id are placed by the digest of the empty string; repeated rows are taken or left alike but counted
each. An empty table gives an empty result. With one source the weight is 1. Extra columns of any name are kept by `mix`;
it replaces columns named tokens or copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 50
BLOCKS = 1024
REPEATS = 4.0


def tokens(column: str = "text") -> Column:
    """Words of `[^\\x20\\x09-\\x0D]+`, counted without making an array of them."""
    squeezed = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def weights(totals: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None) -> DataFrame:
    """(source, tokens, share, exponent, weight) of a table of (source, tokens), one row for each source.

    The bisection is a fold over a fixed number of steps inside one expression over the sources' shares.
    """
    held = totals.where("tokens > 0")
    listed = held.agg(F.sort_array(F.collect_list(F.col("tokens").cast("double"))).alias("all"))
    # exponents are searched in [0, 1]; `fits` tells whether an exponent is high enough
    if entropy is None:
        fits = f"pow(all[size(all) - 1] / all[0], 1 - (s.lo + s.hi) / 2) <= {float(repeats)}D"
    else:
        total = "aggregate(all, 0D, (a, x) -> a + pow(x / all[size(all) - 1], (s.lo + s.hi) / 2))"
        fits = (
            f"ln({total}) - aggregate(all, 0D, (a, x) -> a + pow(x / all[size(all) - 1], (s.lo + s.hi) / 2)"
            f" * ((s.lo + s.hi) / 2) * ln(x / all[size(all) - 1])) / {total} <= {float(entropy)}D"
        )
    found = listed.select(
        "all",
        F.expr(
            f"aggregate(sequence(1, {STEPS}), struct(0D AS lo, 1D AS hi),"
            f" (s, i) -> IF({fits}, struct(s.lo AS lo, (s.lo + s.hi) / 2 AS hi), struct((s.lo + s.hi) / 2 AS lo, s.hi AS hi)), s -> s.hi)"
        ).alias("exponent"),
    )
    scaled = found.select("exponent", F.expr("all[size(all) - 1]").alias("most"), F.expr("aggregate(all, 0D, (a, x) -> a + x)").alias("total"), F.expr("aggregate(all, 0D, (a, x) -> a + pow(x / all[size(all) - 1], exponent))").alias("norm"))
    # one row, so this broadcast has a fixed size
    return totals.join(F.broadcast(scaled)).select(
        "source", "tokens", (F.col("tokens") / F.col("total")).alias("share"), "exponent", "most",
        F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("most"), F.col("exponent")) / F.col("norm")).otherwise(0.0).alias("weight"),
    )


def mix(docs: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """docs with `copies`, how often each document is to be seen; those with none are left out.

    budget: tokens to be dealt; without it, as many as let the source with the least coverage be seen once.
    """
    # the columns of docs go by their places, so that no name of theirs meets one of ours
    name = {c: f"__mix_column_{k}" for k, c in enumerate(docs.columns)}
    keyed = docs.toDF(*name.values())
    keyed = keyed.select(
        "*", tokens(name["text"]).alias("__mix_tokens"), F.coalesce(F.col(name["source"]), F.lit("\x00")).alias("__mix_source"),
        F.md5(F.coalesce(F.col(name["doc_id"]).cast("string"), F.lit(""))).alias("__mix_key"),
    ).withColumn("__mix_block", (F.conv(F.substring("__mix_key", 1, 6), 16, 10).cast("long") % BLOCKS).cast("int"))
    blocks = keyed.groupBy("__mix_source", "__mix_block").agg(F.sum("__mix_tokens").alias("n"))
    totals = blocks.groupBy(F.col("__mix_source").alias("source")).agg(F.sum("n").alias("tokens"))
    weighed = weights(totals, repeats, entropy)
    if budget is None:
        most = F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).over(Window.partitionBy(F.lit(0)))
        quota = F.floor(F.col("weight") * most + 1e-6)
    else:
        quota = F.floor(F.col("weight") * F.lit(float(budget)))
    plan = weighed.select(F.col("source").alias("s"), "tokens", quota.cast("long").alias("quota"))
    plan = plan.select("s", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1).cast("long").alias("passes"), F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0).alias("rest"))
    before = F.sum("n").over(Window.partitionBy("__mix_source").orderBy("__mix_block")) - F.col("n")
    placed = blocks.withColumn("__mix_before", before).join(plan, F.col("__mix_source") == F.col("s"))
    placed = placed.select(F.col("__mix_source").alias("s"), F.col("__mix_block").alias("b"), "passes", (F.col("rest") - F.col("__mix_before")).alias("left"))
    joined = keyed.join(placed, (F.col("__mix_source") == F.col("s")) & (F.col("__mix_block") == F.col("b")))
    within = F.sum("__mix_tokens").over(Window.partitionBy("__mix_source", "__mix_block").orderBy("__mix_key").rangeBetween(Window.unboundedPreceding, 0))
    copies = F.col("passes") + F.when((F.col("__mix_tokens") > 0) & (within <= F.col("left")), 1).otherwise(0)
    kept = [F.col(held).alias(c) for c, held in name.items() if c not in ("tokens", "copies")]
    return joined.select(*kept, F.col("__mix_tokens").alias("tokens"), copies.cast("long").alias("copies")).where("copies > 0")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: how often each document is seen when no source is repeated more than four times."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "tokens", "copies")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, coalesce(source, chr(1)) AS s,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
b AS (SELECT *, CAST(('0x' || substr(k, 1, 6)) AS BIGINT) % 1024 AS blk FROM d),
t AS (SELECT s, sum(tokens)::BIGINT AS n FROM b GROUP BY s),
m AS (SELECT max(n)::DOUBLE AS most, min(n)::DOUBLE AS least FROM t WHERE n > 0),
e AS (
  SELECT 0 AS i, 0::DOUBLE AS lo, 1::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= 4 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(most / least, 1 - (lo + hi) / 2) <= 4 THEN (lo + hi) / 2 ELSE hi END
  FROM e, m WHERE i < 50),
x AS (SELECT hi AS exponent FROM e WHERE i = 50),
norm AS (SELECT sum(pow(n / most, exponent)) AS z FROM t, m, x WHERE n > 0),
w AS (SELECT s, n, CASE WHEN n > 0 THEN pow(n / most, exponent) / z ELSE 0 END AS weight FROM t, m, x, norm),
q AS (SELECT s, n, CAST(floor(weight * (SELECT max(n / weight) FROM w WHERE weight > 0) + 1e-6) AS BIGINT) AS quota FROM w),
p AS (SELECT s, CASE WHEN n > 0 THEN quota // n ELSE 1 END AS passes, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest FROM q),
c AS (
  SELECT b.*, passes, rest, sum(tokens) OVER (PARTITION BY b.s ORDER BY blk, k RANGE UNBOUNDED PRECEDING) AS upto
  FROM b JOIN p ON b.s = p.s)
SELECT doc_id, source, tokens::BIGINT AS tokens, (passes + CASE WHEN tokens > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM c WHERE passes + CASE WHEN tokens > 0 AND upto <= rest THEN 1 ELSE 0 END > 0
"""


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: docs with their tokens and copies under the same mixture."""
    return mix(docs)

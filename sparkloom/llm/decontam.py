"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are `[^\\x20\\x09-\\x0D]+`, lower-cased over A-Z. For each benchmark item of `size` words or more, windows of as many words
are taken from the documents, wherever one of the item's `size`-word shingles occurs: the window in which the shingle
stands where it stands in the item. A window that would begin before the text or end after it is moved to the text's edge,
and a text shorter than the item is one window as a whole. A window without any such shingle has similarity 0 with every item.

Windows and items get 64-bit SimHash fingerprints over their weighted shingles. A multi-index finds every item whose
fingerprint is within `radius` bits: fingerprints are cut in four blocks of 16 bits, one of which differs in at most
radius // 4 bits, and items are listed under all such neighbours of each block. Candidates within the radius are verified
by exact weighted similarity, the sum of the smaller over the sum of the larger shingle counts, at `least` or more.

Sizes: what grows with the documents is exploded into rows once and joined to the benchmark's shingles; what is made from
the benchmark (its shingles, and about 2800 index rows for an item) is a shuffled or broadcast side as Spark's own size
threshold decides. Windows are grouped by document, item length and start, so a passage in a third of the documents is
spread over them.

Cases: null or short texts are never contaminated; items with fewer words than `size` are one shingle, their whole
sequence, and match it as a run of words. Items without words match nothing. Repeated documents are each found. Rows with
a null doc_id or item_id are left out of the search. Empty tables give no findings. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 15
BLOCKS = 4


def words(column: str = "text") -> Column:
    """Words, lower-cased over A-Z only."""
    low = F.translate(F.coalesce(F.col(column), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(array: str, size: int) -> str:
    """SQL for the hashes of all `size`-word runs of an array of word hashes."""
    parts = ", ".join(f"{array}[i + {k}]" for k in range(size))
    return f"IF(size({array}) < {size}, CAST(array() AS array<bigint>), transform(sequence(0, size({array}) - {size}), i -> xxhash64({parts})))"


def fingerprint(rows: DataFrame, keys: list[str], hash_: str = "h") -> DataFrame:
    """SimHash of the hashes in each group: bit i is set when more than half of them have it, repeats counting.

    Four bits are counted in one sum, 16 bits apart.
    """
    sums = [F.sum(F.expr(f"shiftrightunsigned({hash_}, {i}) & 281479271743489L")).alias(f"__s{i}") for i in range(16)]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    bits = [f"shiftleft(CAST((shiftrightunsigned(__s{i}, {16 * k}) & 65535) * 2 > n AS bigint), {i + 16 * k})" for i in range(16) for k in range(4)]
    halves = [" | ".join(bits[a : a + 16]) for a in range(0, 64, 16)]
    return counted.select(*keys, "n", F.expr(" | ".join(f"({h})" for h in halves)).alias("f"))


def found(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, similarity): for each document and item the most similar window, the first of equals."""
    item = benchmark.where("item_id is not null").select("item_id", words().alias("w"))
    item = item.select("item_id", F.expr("transform(w, x -> xxhash64(x))").alias("w")).where("size(w) > 0").distinct()
    item = item.select("item_id", F.expr("size(w)").alias("len"), F.expr(f"IF(size(w) < {size}, array(aggregate(w, 42L, (a, x) -> xxhash64(a, x))), {shingles('w', size)})").alias("hs"))
    grams = item.select("item_id", "len", F.posexplode("hs").alias("p", "h"))
    # one row for each hash, item length and place: what a window needs to know
    wanted = grams.where(f"len >= {size}").select("h", "len", "p").distinct()
    text = docs.where("doc_id is not null").select("doc_id", F.transform(words(), lambda x: F.xxhash64(x)).alias("w"))
    runs = text.select("doc_id", F.expr("size(w)").alias("nw"), F.posexplode(F.expr(shingles("w", size))).alias("i", "h"))
    # a text shorter than the item is at most as similar as their numbers of shingles are
    hits = runs.join(wanted, "h").where(f"nw >= len OR CAST(nw - {size - 1} AS double) / (len - {size - 1}) >= {least}D")
    hits = hits.select("doc_id", "len", F.expr("greatest(0, least(i - p, nw - len))").alias("start")).distinct()
    # the windows' shingles: only documents with hits are cut again
    cut = hits.groupBy("doc_id").agg(F.collect_set(F.struct("len", "start")).alias("ws"))
    windows = text.join(cut, "doc_id").select("doc_id", F.expr(shingles("w", size)).alias("hs"), F.explode("ws").alias("x"))
    windows = windows.select("doc_id", F.col("x.len").alias("len"), F.col("x.start").alias("start"), F.expr(f"slice(hs, x.start + 1, x.len - {size} + 1)").alias("ws")).distinct()
    rows = windows.select("doc_id", "len", "start", F.explode("ws").alias("h"))
    prints = fingerprint(rows, ["doc_id", "len", "start"])
    near = radius // BLOCKS
    masks = f"filter(transform(sequence(0, 65535), x -> CAST(x AS bigint)), x -> bit_count(x) <= {near})"
    own = fingerprint(grams.where(f"len >= {size}"), ["item_id", "len"])
    index = own.select("item_id", "len", F.col("f").alias("g"), F.posexplode(F.expr("array(f & 65535, shiftrightunsigned(f, 16) & 65535, shiftrightunsigned(f, 32) & 65535, shiftrightunsigned(f, 48))")).alias("block", "v"))
    index = index.select("item_id", "len", "g", "block", F.explode(F.expr(f"transform({masks}, x -> x ^ v)")).alias("v"))
    asked = prints.select("doc_id", "len", "start", "f", F.posexplode(F.expr("array(f & 65535, shiftrightunsigned(f, 16) & 65535, shiftrightunsigned(f, 32) & 65535, shiftrightunsigned(f, 48))")).alias("block", "v"))
    pairs = asked.join(index, ["block", "v", "len"]).where(f"bit_count(f ^ g) <= {radius}").select("doc_id", "len", "start", "item_id").distinct()
    # exact weighted similarity of the candidates
    both = pairs.join(windows, ["doc_id", "len", "start"]).join(item.select("item_id", F.col("hs").alias("want")), "item_id")
    distinct = "array_union(ws, want)"
    count = lambda a: f"size(filter({a}, y -> y = x))"
    low = f"aggregate({distinct}, 0, (a, x) -> a + least({count('ws')}, {count('want')}))"
    high = f"aggregate({distinct}, 0, (a, x) -> a + greatest({count('ws')}, {count('want')}))"
    exact = both.select("doc_id", "item_id", "start", F.expr(f"CAST({low} AS double) / {high}").alias("similarity")).where(F.col("similarity") >= least)
    short = item.where(f"len < {size}").select("item_id", "len", F.col("hs")[0].alias("h"))
    brief = None
    for n in range(1, size):
        run = text.select("doc_id", F.posexplode(F.expr(f"IF(size(w) < {n}, CAST(array() AS array<bigint>), transform(sequence(0, size(w) - {n}), i -> aggregate(slice(w, i + 1, {n}), 42L, (a, x) -> xxhash64(a, x))))")).alias("start", "h"))
        got = run.join(short.where(F.col("len") == n), "h").select("doc_id", "item_id", "start", F.lit(1.0).alias("similarity"))
        brief = got if brief is None else brief.unionByName(got)
    if brief is not None and not short.isEmpty():
        exact = exact.unionByName(brief)
    return exact.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.similarity").alias("similarity"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: documents with a benchmark item in them, the item, the first word of it and the similarity."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    bad = found(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)

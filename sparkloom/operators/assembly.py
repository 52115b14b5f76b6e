"""Contig assembly: k-mers, their abundance cutoff, macro nodes, wiring, compaction and contigs.

A macro node is a (k-1)-mer with affixes: what may stand before it (prefixes) and after it (suffixes), each with a count
and a number of visits; an affix that ends there is terminal. Wires pair the visits of prefixes with those of suffixes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import code_order, kmers, visits

ROW = "key string, is_prefix boolean, affix string, terminal boolean, n long, visits long"
CODE = str.maketrans("ACTG", "0123")
PACKED_BYTES = 4 << 20  # reads that are counted together before the shuffle; a longer read is counted as a whole
BASES = np.full(256, 4, np.uint8)
BASES[np.frombuffer(b"ACTG", np.uint8)] = range(4)


def packed_kmers(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-mers of texts with two bits a base, and their counts; the work grows with the length, not its square."""
    base = BASES[np.frombuffer(b"\n".join(texts), np.uint8)]
    known = base < 4
    code, width = np.where(known, base, 0).astype(np.uint64), 1
    whole, have = None, 0
    while width <= k:  # codes of 1, 2, 4, ... bases; those that add up to k are put one after the other
        if k & width:
            rest = code[have:]
            whole = rest if whole is None else (whole[: len(rest)] << np.uint64(2 * width)) | rest[: len(whole)]
            have += width
        if width * 2 <= k:
            code = (code[:-width] << np.uint64(2 * width)) | code[width:] if len(code) > width else code[:0]
        width *= 2
    n = max(0, len(base) - k + 1)
    bad = np.concatenate(([0], np.cumsum(~known)))
    return np.unique(whole[:n][bad[k : k + n] == bad[:n]], return_counts=True)


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, n): occurrences of each k-mer of A, C, T and G; one with another letter is left out, and a null read is empty.

    Up to 32 bases are packed in one number and counted batch by batch before the one shuffle, by number.
    """
    if k > 32:
        return reads.select(F.explode(kmers(F.col("read"), k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        for batch in batches:
            texts, size = [], 0
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                texts.append(text or b"")
                size += len(texts[-1])
                if size > PACKED_BYTES:
                    yield packed(texts)
                    texts, size = [], 0
            if texts:
                yield packed(texts)

    def packed(texts):
        code, n = packed_kmers(texts, k)
        return pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    counted = reads.select("read").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    digits = F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0")
    return counted.select(F.translate(digits, "0123", "ACTG").alias("kmer"), "n")


def count_histogram(counts: DataFrame, most: int) -> DataFrame:
    """(n, kmers) for counts below `most`; a count that no k-mer has is there with 0."""
    spark = counts.sparkSession
    seen = counts.where(F.col("n") < most).groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))
    return spark.range(1, most).withColumnRenamed("id", "n").join(seen, "n", "left").select("n", F.coalesce("kmers", F.lit(0).cast("long")).alias("kmers"))


def cutoff(counts: DataFrame, most: int) -> DataFrame:
    """(cutoff): the count that the fewest k-mers have, the smallest of equals."""
    return count_histogram(counts, most).agg(F.min(F.struct("kmers", "n")).alias("b")).select(F.col("b.n").alias("cutoff"))


def macro_nodes(counts: DataFrame, least: DataFrame | int, coverage: float) -> DataFrame:
    """ROW for each affix of each node, without the ends."""
    if isinstance(least, int):
        kept = counts.where(F.col("n") >= least)
    else:
        kept = counts.join(F.broadcast(least)).where(F.col("n") >= F.col("cutoff"))
    v = visits(F.col("n"), coverage)
    size = F.length("kmer")
    after = kept.select(F.expr("substring(kmer, 1, length(kmer) - 1)").alias("key"), F.lit(False).alias("is_prefix"), F.expr("right(kmer, 1)").alias("affix"), F.lit(False).alias("terminal"), "n", v.alias("visits"))
    before = kept.select(F.substring("kmer", F.lit(2), size - 1), F.lit(True), F.substring("kmer", 1, 1), F.lit(False), "n", v)
    return after.union(before)


def affix_order(a: tuple) -> tuple:
    return -a[3], -a[2], -len(a[0]), tuple(-int(c) for c in a[0].translate(CODE))


def with_ends(affixes: list[tuple]) -> tuple[list, list]:
    """Prefixes and suffixes of a node, each with an end that takes up what the other side has more, in wiring order.

    An affix is (text, terminal, n, visits).
    """
    before, after = ([a[1:] for a in affixes if a[0] is side] for side in (True, False))
    more = sum(a[3] for a in after) - sum(a[3] for a in before)
    before.append(("", True, 1, max(more, 0)))
    after.append(("", True, 1, max(-more, 0)))
    return sorted(before, key=affix_order), sorted(after, key=affix_order)


def wires(before: list, after: list) -> list[tuple[int, int, int, int]]:
    """(prefix, suffix, offset in the suffix, visits) where the running sums of both sides overlap."""
    edges = lambda side: [0, *pd.Series([a[3] for a in side]).cumsum().tolist()]
    p, s = edges(before), edges(after)
    out, i, j = [], 0, 0
    while i < len(before) and j < len(after):
        low, high = max(p[i], s[j]), min(p[i + 1], s[j + 1])
        if high > low:
            out.append((i, j, low - s[j], high - low))
        if p[i + 1] <= s[j + 1]:
            i += 1
        else:
            j += 1
    return out


def _rows(df: pd.DataFrame) -> list[tuple]:
    return [(bool(a), b, bool(c), int(d), int(e)) for a, b, c, d, e in zip(df["is_prefix"], df["affix"], df["terminal"], df["n"], df["visits"], strict=True)]


def macro_wires(nodes: DataFrame) -> DataFrame:
    """(key, prefix, suffix, offset, visits) of every node.

    Affixes are laid along their side in wiring order, by running sums within the node, and pairs that overlap are wired.
    A node has few affixes, so its pairs are few; a node's ends come from the same shuffle as the sums.
    """
    sides = Window.partitionBy("key")
    more = F.sum(F.when(F.col("is_prefix"), -F.col("visits")).otherwise(F.col("visits"))).over(sides)
    first = F.row_number().over(sides.orderBy("is_prefix", "affix")) == 1
    with_more = nodes.select("key", "is_prefix", "affix", "n", "visits", more.alias("more"), first.alias("first"))
    own = F.struct("is_prefix", "affix", "n", "visits")
    ends = [F.struct(F.lit(side).alias("is_prefix"), F.lit("").alias("affix"), F.lit(1).cast("long").alias("n"), F.greatest(sign * F.col("more"), F.lit(0)).cast("long").alias("visits")) for side, sign in ((True, 1), (False, -1))]
    every = with_more.select("key", F.explode(F.when(F.col("first"), F.array(own, *ends)).otherwise(F.array(own))).alias("a")).select("key", "a.*")
    order = Window.partitionBy("key", "is_prefix").orderBy(F.desc("visits"), F.desc("n"), F.desc(F.length("affix")), F.desc(code_order(F.col("affix")))).rowsBetween(Window.unboundedPreceding, 0)
    placed = every.select("key", "is_prefix", "affix", F.sum("visits").over(order).alias("high"), "visits").withColumn("low", F.col("high") - F.col("visits")).where("visits > 0")
    held = placed.groupBy("key").agg(*[F.collect_list(F.when(F.col("is_prefix") == side, F.struct("affix", "low", "high"))).alias(name) for side, name in ((True, "p"), (False, "s"))])
    pairs = held.select("key", F.explode("p").alias("p"), "s").select("key", "p", F.explode("s").alias("s"))
    low, high = F.greatest("p.low", "s.low"), F.least("p.high", "s.high")
    return pairs.where(high > low).select("key", F.col("p.affix").alias("prefix"), F.col("s.affix").alias("suffix"), (low - F.col("s.low")).alias("offset"), (high - low).alias("visits"))


STEP = "kind string, key string, is_prefix boolean, old string, affix string, terminal boolean, n long, visits long"


def _process(key: str, affixes: list[tuple]) -> list[tuple] | None:
    """The contigs and changes that a node gives when it goes; None where a neighbour is greater."""
    size, code = len(key), key.translate(CODE)
    before, after = with_ends(affixes)
    for text, terminal, _, _ in before:
        if not terminal and (text + key)[:size].translate(CODE) > code:
            return None
    for text, terminal, _, _ in after:
        if not terminal and (key + text)[-size:].translate(CODE) > code:
            return None
    out = []
    for i, j, _, v in wires(before, after):
        (pre, pre_end, pre_n, _), (suf, suf_end, suf_n, _) = before[i], after[j]
        if pre_end and suf_end:
            out.append(("c", "", False, "", pre + key + suf, True, min(pre_n, suf_n), v))
            continue
        left, right = pre + key, key + suf
        to_left, to_right = left[:size], right[-size:]
        loop_left, loop_right = not pre_end and to_left == key, not suf_end and to_right == key
        if not pre_end and not loop_left:
            out.append(("m", to_left, False, left[size:], left[size:] + suf, suf_end or loop_right, min(pre_n, suf_n), v))
        if not suf_end and not loop_right:
            out.append(("m", to_right, True, right[:-size], pre + right[:-size], pre_end or loop_left, min(pre_n, suf_n), v))
    return out


def _changed(affixes: list[tuple], changes: list[tuple]) -> list[tuple]:
    """Each change replaces the first open affix that it names; where there is none it is added."""
    rows = list(affixes)
    for is_prefix, old, new, terminal, n, v in sorted(changes):
        for k, a in enumerate(rows):
            if a[0] == is_prefix and a[1] == old and not a[2]:
                rows[k] = (is_prefix, new, terminal, n, v)
                break
        else:
            rows.append((is_prefix, new, terminal, n, v))
    return rows


def _walk(nodes: dict[str, list[tuple]]) -> list[str]:
    """Contigs of what is left, followed from each open start along the wires."""
    ready = {k: (*(sides := with_ends(a)), wires(*sides)) for k, a in nodes.items()}
    out = []
    for key, (before, _, _) in ready.items():
        for i, (text, terminal, _, v) in enumerate(before):
            if not terminal or not v:
                continue
            stack = [(text + key, key, i, 0, v)]
            while stack:
                line, at, p, skip, freq = stack.pop()
                _, after, wired = ready[at]
                offset = 0
                for a, s, start, n in wired:
                    if a != p:
                        continue
                    low, high = max(skip, offset), min(skip + freq, offset + n)
                    if high > low:
                        suf, end, _, _ = after[s]
                        longer = line + suf
                        nxt = (at + suf)[-len(at) :]
                        if end or nxt not in ready or len(longer) > 10_000_000:
                            out.append(longer)
                        else:
                            want = (at + suf)[: -len(at)]
                            match = next((q for q, b in enumerate(ready[nxt][0]) if b[0] == want and not b[1]), None)
                            if match is None:
                                out.append(longer)
                            else:
                                stack.append((longer, nxt, match, start + low - offset, high - low))
                    offset += n
    return out


def contigs(nodes: DataFrame, checkpoint, threshold: int = 1, longer_than: int = 400, rounds: int = 200) -> DataFrame:
    """(contig): nodes greater than all their neighbours go round by round, until fewer than `threshold` are left.

    Each round is one shuffle by key. checkpoint cuts the lineage; at 1 or less everything is compacted and nothing walked.
    """
    spark = nodes.sparkSession
    state = checkpoint(nodes.select(F.lit("n").alias("kind"), "key", "is_prefix", F.lit("").alias("old"), "affix", "terminal", "n", "visits"))
    done = None
    threshold = max(1, threshold)
    columns = [f.split()[0] for f in STEP.split(", ")]

    def settle(key: str, held: list[tuple]) -> list[tuple]:
        rows = _changed([(p, a, t, n, v) for kind, _, p, _, a, t, n, v in held if kind == "n"], [(p, o, a, t, n, v) for kind, _, p, o, a, t, n, v in held if kind == "m"])
        out = _process(key, rows)
        return [("n", key, p, "", a, t, n, v) for p, a, t, n, v in rows] if out is None else out

    def step(batches):
        """Rows come sorted by key; a node is settled when the next one begins, so thousands share a data frame."""
        key, held, out = None, [], []
        for df in batches:
            for row in df[columns].itertuples(index=False, name=None):
                if row[1] != key:
                    if held:
                        out += settle(key, held)
                    key, held = row[1], []
                held.append(row)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if held:
            out += settle(key, held)
        yield pd.DataFrame(out, columns=columns)

    for _ in range(rounds):
        if state.select("key").distinct().limit(threshold).count() < threshold:
            break
        after = checkpoint(state.repartition("key").sortWithinPartitions("key").mapInPandas(step, STEP))
        found = after.where("kind = 'c'").select(F.col("affix").alias("contig"))
        done = found if done is None else done.union(found)
        state = after.where("kind <> 'c'")
    empty = spark.createDataFrame([], "contig string")
    done = empty if done is None else done
    if threshold > 1:

        def walk(batches):
            df, held = pd.concat(list(batches)), {}
            for key, part in df.groupby("key"):
                new = part[part["kind"] == "m"]
                changes = [(bool(a), b, c, bool(d), int(e), int(f)) for a, b, c, d, e, f in zip(new["is_prefix"], new["old"], new["affix"], new["terminal"], new["n"], new["visits"], strict=True)]
                held[key] = _changed(_rows(part[part["kind"] == "n"]), changes)
            yield pd.DataFrame({"contig": _walk(held)})

        # fewer nodes than the threshold are left, so one task holds them
        done = done.union(state.repartition(1).mapInPandas(walk, "contig string"))
    return done.where(F.length("contig") > longer_than)


def nth_affix(nodes: DataFrame) -> DataFrame:
    """Places of the affixes in wiring order, without the ends."""
    code = F.translate("affix", "ACTG", "0123")
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("key", "is_prefix").orderBy(F.desc("visits"), F.desc("n"), F.desc(F.length("affix")), F.desc(code))))

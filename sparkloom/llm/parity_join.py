"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct `size`-word shingles, lower-cased over A-Z; a shorter text is one shingle
as a whole. Two documents link when 100 * intersection >= percent * union.

Documents with equal sets are one class from the start. For each size band, sketches of 64-bit blocks are made: a
shingle's hash picks a block and bits in it, and toggles those. Sketches of two sets differ in at most as many bits
as the sets' symmetric difference has members, which a link bounds by d; with k > d blocks, linked sets agree in at least
k - d blocks as a whole, and of the m blocks with members of either in m - d. Blocks without members are left out by sets
that have more than d others, and sets too small to link with any other take no part.

Classes that share a block are a group. Groups are counted twice. First only the smallest class of a group against each
other one, which is linear: those that share half of their blocks are tied, and what is tied gets one label. So near copies,
which share most of their blocks, become one label. Then labels are counted pair by pair: labels that
hold a link share at least as many blocks. Pairs whose sizes or whose sketches of 256 bits rule a link out aren't sent; a
label stands in a group with one of its sketches and the largest Hamming distance from it. A class leaves as many groups of
more than GROUP classes as it can spare by its number of blocks. If more than GROUP labels are left in a group, they are
tied to its smallest without counting, so no group compares more than GROUP / 2 pairs for each of its members.
What is tied forms clusters that hold every link. Clusters are dealt in tiles of bounded size; there the sketches' Hamming
distance rules pairs out and exact intersections decide the rest. Large clusters are first thinned by pivots: a set that
links with the pivot is done, unless it may link with one that doesn't by the triangle inequality of Jaccard distances;
what is then left goes to pairs of tiles. A tile sends a spanning forest of its links, never all pairs, and components
put the forests together.

Cases: a null or empty text, or one of white space, has an empty set (n_shingles 0), is linked with nothing and is its
own component. Repeated rows of a doc_id give a row each. Rows with a null doc_id are left out. An empty table gives an
empty result. Extra columns are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, by_bucket, checkpointed, chunks, components, corpus_size, mix, pack, prefix_sums, range_hash, ranges, tidy, unpack

TILE = 1 << 19  # shingles in a tile
HELD = 1 << 19  # entries that a task holds before it sends them
GROUP = 2048  # labels that share a block, up to which their pairs are compared
SKETCH = 4  # words of 64 bits of the sketch that each class carries
BUCKET_BYTES = 10 << 20  # a set's blocks in one bucket share what is sent of the set
PIVOTS = 8  # rounds that thin large clusters
ONE = np.uint64(1)


class Bands:
    """Size bands: linked sets lie in one band or in neighbouring ones."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        edges = [1]
        while edges[-1] <= most:
            edges.append(edges[-1] * 100 // percent + 1)
        edges += [edges[-1] * 100 // percent + 1, (edges[-1] * 100 // percent + 1) * 100 // percent + 1]
        self.edges = np.array(edges, np.int64)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, sizes, "right") - 1

    def apart(self, total):
        """Most members of the symmetric difference of linked sets whose sizes add up to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def lone(self, sizes: np.ndarray) -> np.ndarray:
        """Sets so small that any other set is too far from them, even the largest one that could link."""
        return self.apart(sizes + sizes * 100 // self.percent) < 1

    def blocks(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of the sketch for a band and its upper neighbour, and the difference that it allows."""
        d = self.apart(self.edges[band + 1] - 1 + self.edges[band + 2] - 1)
        return d + 1 + np.maximum(8, (d + 1) // 3), d


def shingle_sets(chunk, size: int):
    """(sorted distinct shingle hashes of all documents, where each document's begin, their counts)."""
    words, lo, hi, _, _ = chunk.words(fold=True)
    sums = prefix_sums(words)
    n = hi - lo
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = lo[doc] + place
    h = range_hash(sums, start, np.minimum(start + size, hi[doc]))
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[keep], doc[keep]
    counts = np.bincount(doc, minlength=len(n)).astype(np.int64)
    return h, np.cumsum(counts) - counts, counts


def set_keys(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; sums, as they don't ask for an order."""
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(seed)), out=sums[1:], dtype=np.uint64)
        out.append((sums[starts + counts] - sums[starts]).astype(np.int64))
    return out[0], out[1]


def parity(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, blocks: np.ndarray, wide: bool = False):
    """Sketches as their blocks with members: (set, block, value, members) arrays; blocks left out are zero.

    A member toggles one bit, so that sketches differ in no more bits than the sets have different members; with wide it
    toggles about half of the bits, so that blocks of few but different members aren't equal by chance.
    """
    who = np.repeat(np.arange(len(counts)), counts)
    block = ((h[ranges(starts, counts)] >> np.uint64(32)) * blocks.astype(np.uint64)[who] >> np.uint64(32)).astype(np.int64)
    bit = mix(h[ranges(starts, counts)]) if wide else ONE << (h[ranges(starts, counts)] & np.uint64(63))
    # sets are sorted by hash and the block grows with the hash, so a block's members lie together
    firsts = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (block[1:] != block[:-1]))) if len(who) else who
    value = np.bitwise_xor.reduceat(bit, firsts) if len(firsts) else bit
    return who[firsts], block[firsts], value, np.diff(np.append(firsts, len(who)))


def classes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, s0 ...): the size and the two hashes of each document's set, and a sketch of it."""
    sketch = [f"s{k}" for k in range(SKETCH)]

    def run(batches):
        for chunk in chunks(batches):
            h, starts, counts = shingle_sets(chunk, size)
            one, two = set_keys(h, starts, counts)
            who, block, value, _ = parity(h, starts, counts, np.full(len(counts), SKETCH))
            bits = np.zeros((SKETCH, len(counts)), np.uint64)
            bits[block, who] = value
            yield pa.RecordBatch.from_arrays([pa.array(chunk.ids), pa.array(counts), pa.array(one), pa.array(two), *(pa.array(b.view(np.int64)) for b in bits)], names=["doc_id", "n_shingles", "c1", "c2", *sketch])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long" + "".join(f", {c} long" for c in sketch))


def in_rows(pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([b for b, _ in pairs], pa.int32()), "payload": pa.array([x for _, x in pairs], pa.binary())})


DEALT = "bucket int, payload binary"


def groups_of(docs: DataFrame, size: int, bands: Bands, buckets: int) -> DataFrame:
    """DEALT: entries (key, class, band, half) of classes that share a block, sorted by key and class in each bucket of keys.

    A pair of a group and band links only if it shares as many blocks as its two halves add up to. A linked set of m blocks
    with members shares m - d of them at least, so (m - d) / 2 is its half. A set of d blocks with members, or fewer, sends
    the blocks without members as well, and its half is 0. A group of more than GROUP classes is marked in its band.
    """

    def send(batches):
        held, seen = [], set()

        def rows():
            key, cls, config, half = (np.concatenate([x[k] for x in held]) for k in range(4))
            out = []
            for bucket, at in by_bucket((key >> np.uint64(32)).astype(np.int64) % buckets):
                # entries come set by set; what belongs to a set and a band is sent once for all of its blocks in the bucket
                first = np.flatnonzero(np.append(True, (cls[at][1:] != cls[at][:-1]) | (config[at][1:] != config[at][:-1])))
                times = np.diff(np.append(first, len(at)))
                first = at[first]
                out.append((bucket, pack(key[at].astype(np.uint32), times.astype(np.uint32), cls[first], config[first], half[first])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "payload"])

        count = 0
        for chunk in chunks(batches):
            h, starts, counts = shingle_sets(chunk, size)
            cls, _ = set_keys(h, starts, counts)
            new = np.zeros(len(cls), bool)
            for i in np.flatnonzero((counts > 0) & ~bands.lone(counts)):
                if int(cls[i]) not in seen:
                    seen.add(int(cls[i]))
                    new[i] = True
            pick = np.flatnonzero(new)
            for lower in (0, 1):
                band = bands.of(counts[pick]) - lower
                use = pick[band >= 0]
                band = band[band >= 0]
                if not len(use):
                    continue
                k, d = bands.blocks(band)
                who, block, value, _ = parity(h, starts[use], counts[use], k, wide=True)
                spare = np.bincount(who, minlength=len(use)) - d
                sends = np.flatnonzero(spare <= 0)
                every, owner = ranges(np.zeros(len(sends), np.int64), k[sends]), np.repeat(sends, k[sends])
                free = ~np.isin(owner * (1 << 40) + every, who * (1 << 40) + block)
                who, block = np.concatenate([who, owner[free]]), np.concatenate([block, every[free]])
                value = np.concatenate([value, np.zeros(int(free.sum()), np.uint64)])
                key = mix(value ^ mix((band[who].astype(np.uint64) << np.uint64(40)) + block.astype(np.uint64)))
                half = (np.maximum(spare, 0) / 2).astype(np.float32)
                held.append((key, cls[use][who], band[who].astype(np.uint16), half[who]))
                count += len(key)
            if count >= HELD:
                yield from rows()
                held, count = [], 0
        if count:
            yield from rows()

    def meet(table: pa.Table) -> pa.Table:
        tidy()
        parts = [unpack(b.as_buffer(), np.uint32, np.uint32, np.int64, np.uint16, np.float32) for b in table["payload"]]
        key = np.sort(np.concatenate([p[0] for p in parts]))
        shared = np.unique(key[1:][key[1:] == key[:-1]])
        del key
        found = []  # few keys are shared, so only their entries are laid out
        for key, times, *rest in parts if len(shared) else []:
            at = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, key), len(shared) - 1)] == key)
            of = np.searchsorted(np.cumsum(times, dtype=np.int64), at, "right")
            found.append((key[at], *(x[of] for x in rest)))
        key, cls, config, half = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate(ENTRIES))
        order = np.lexsort((cls, config, key))
        key, cls, config, half = key[order], cls[order], config[order], half[order]
        keep = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (config[1:] != config[:-1])) if len(key) else np.zeros(0, bool)
        key, cls, config, half = key[keep], cls[keep], config[keep], half[keep]
        first = group_starts(key, config)
        sizes = np.diff(np.append(first, len(key)))
        config = config | np.repeat(np.where(sizes > GROUP, LARGE, 0).astype(np.uint16), sizes)
        return in_rows([(table["bucket"][0].as_py(), pack(key, cls, config, half))])

    return docs.mapInArrow(send, DEALT).groupBy("bucket").applyInArrow(meet, DEALT)


ENTRIES = (np.uint32, np.int64, np.uint16, np.float32)
LARGE = np.uint16(1 << 15)  # marks the band of a large group


def group_starts(key: np.ndarray, config: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (config[1:] != config[:-1]))) if len(key) else np.zeros(0, np.int64)


def spare_entries(at: np.ndarray, cls: np.ndarray, config: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which entries stay, the halves): of its entries in large groups a class leaves out as many as its half is above.

    Each of them lowers its half by one, so linked classes still share as many of the others as their halves add up to.
    """
    band, large = config & ~LARGE, config >= LARGE
    order = np.lexsort((at, ~large, cls, band))
    first = group_starts(cls[order], band[order])
    sizes = np.diff(np.append(first, len(cls)))
    many = np.add.reduceat(large[order], first, dtype=np.int64) if len(first) else sizes
    most = np.minimum(many, np.maximum(0, np.ceil(half[order][first]).astype(np.int64) - 1))
    stays, less = np.empty(len(cls), bool), np.empty(len(cls), np.float32)
    stays[order] = np.arange(len(cls)) - np.repeat(first, sizes) >= np.repeat(most, sizes)
    less[order] = np.repeat(most, sizes)
    return stays, half - less


def cut_like(arrays: tuple, sizes: list[int]) -> list[tuple]:
    return list(zip(*(np.split(a, np.cumsum(sizes)[:-1]) for a in arrays), strict=True))


def pair_rows(a, b, config, need, count, buckets: int) -> list[tuple[int, bytes]]:
    """Pairs of a bucket of keys, each once with its count and least need, dealt by a hash of the pair."""
    order = np.lexsort((config, b, a))
    a, b, config, need, count = (x[order] for x in (a, b, config, need, count))
    if not len(a):
        return []
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (config[1:] != config[:-1])))
    need, count = np.minimum.reduceat(need, first), np.add.reduceat(count, first)
    a, b, config = a[first], b[first], config[first]
    to = (mix(a.astype(np.uint64) ^ mix(b.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
    return [(x, pack(a[at], b[at], config[at], need[at], count[at].astype(np.int32))) for x, at in by_bucket(to)]


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that edges (a, b) connect each of n nodes with."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def enough(table: pa.Table) -> pa.Table:
    """(a, b): ties that connect what pairs connect that share as many blocks of a band as they need.

    Only components of ties count, so a bucket sends one for each node and not its pairs, which may grow with the square.
    """
    parts = [unpack(p.as_buffer(), np.int64, np.int64, np.uint16, np.float32, np.int32) for p in table["payload"]]
    a, b, c, need, count = (np.concatenate([p[k] for p in parts]) for k in range(5))
    order = np.lexsort((c, b, a))
    a, b, c, need, count = a[order], b[order], c[order], need[order], count[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
    ok = first[np.add.reduceat(count, first) >= np.minimum.reduceat(need, first)]
    node, ends = np.unique(np.concatenate([a[ok], b[ok]]), return_inverse=True)
    root = roots_of(len(node), ends[: len(ok)], ends[len(ok) :])
    out = np.flatnonzero(root != np.arange(len(node)))
    return pa.table({"a": pa.array(node[root[out]]), "b": pa.array(node[out])})


def shared_blocks(docs: DataFrame, unique: DataFrame, size: int, bands: Bands, total: int) -> DataFrame:
    """(a, b): ties of classes whose components hold every link; unique has c1, n and the sketch of each class."""
    sketch = [f"s{k}" for k in range(SKETCH)]
    buckets = bucket_count(total // 2, BUCKET_BYTES)
    groups = checkpointed(groups_of(docs, size, bands, buckets))

    half_of_band = (bands.blocks(np.arange(len(bands.edges) - 2))[0] / 2).astype(np.float32)

    def stars(batches):
        for batch in batches:
            for payload in batch.column(1):
                key, cls, config, half = unpack(payload.as_buffer(), *ENTRIES)
                config = config & ~LARGE
                first = group_starts(key, config)
                sizes = np.diff(np.append(first, len(key)))
                lead = np.repeat(first, sizes)  # a group is sorted by class
                at = np.flatnonzero(cls != cls[lead])
                most = half_of_band[config[at]]
                rows = pair_rows(cls[lead[at]], cls[at], config[at], most, np.ones(len(at), np.int64), buckets)
                del key, cls, config, half, lead, at, most
                yield from in_rows(rows).to_batches()
                tidy()

    ties = checkpointed(groups.mapInArrow(stars, DEALT).groupBy("bucket").applyInArrow(enough, "a long, b long"))
    labels = unique.join(components(ties), unique["c1"] == F.col("node"), "left")
    labels = labels.select(F.pmod("c1", F.lit(buckets)).cast("int").alias("bucket"), "c1", F.coalesce("root", "c1").alias("label"), F.col("n").cast("int").alias("n"), *sketch)

    def by_class(batches):
        for batch in batches:
            for home, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key, cls, config, half = unpack(payload.as_buffer(), *ENTRIES)
                rows = [(b, pack(np.array([home], np.int32), key[at], cls[at], config[at], half[at])) for b, at in by_bucket(np.mod(cls, buckets))]
                yield from in_rows(rows).to_batches()

    def labelled(sent: pa.Table, known: pa.Table) -> pa.Table:
        tidy()
        if not len(sent):
            return in_rows([])
        node = known["c1"].to_numpy()
        order = np.argsort(node)
        node, label, n = node[order], known["label"].to_numpy()[order], known["n"].to_numpy()[order]
        bits = np.stack([known[c].to_numpy()[order] for c in sketch], axis=1)
        rows, parts = [], [unpack(payload.as_buffer(), np.int32, *ENTRIES) for payload in sent["payload"]]
        place = np.concatenate([(p[0].astype(np.int64) << 32) + p[1] for p in parts])
        spared = spare_entries(place, *(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4)))
        del place
        for (home, key, cls, config, _), (keep, half) in zip(parts, cut_like(spared, [len(p[1]) for p in parts]), strict=True):
            key, cls, config, half = key[keep], cls[keep], config[keep] & ~LARGE, half[keep]
            if not len(key):
                continue
            own, ref = np.unique(np.searchsorted(node, cls), return_inverse=True)  # every class is known
            rows.append((int(home[0]), pack(key, ref.astype(np.uint32), config, half, label[own], n[own], bits[own])))
        return in_rows(rows)

    def pairs(table: pa.Table) -> pa.Table:
        tidy()
        parts = [unpack(p.as_buffer(), np.uint32, np.uint32, np.uint16, np.float32, np.int64, np.int32, np.uint64) for p in table["payload"]]
        key, config, half = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
        base = np.cumsum([0] + [len(p[4]) for p in parts])
        ref = np.concatenate([p[1].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
        label, n = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
        bits = np.concatenate([p[6] for p in parts]).reshape(-1, SKETCH)
        order = np.lexsort((label[ref], config, key))
        key, config, half, ref = key[order], config[order], half[order], ref[order]
        own = label[ref]
        # a label in a group: one of its sketches, how far its others are from it, its range of sizes and its least half
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]) | (config[1:] != config[:-1])))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        stray = np.bitwise_count(bits[ref] ^ bits[ref[first]][of]).sum(axis=1).astype(np.int64)
        radius, low, high = np.maximum.reduceat(stray, first), np.minimum.reduceat(n[ref], first).astype(np.int64), np.maximum.reduceat(n[ref], first).astype(np.int64)
        half = np.minimum.reduceat(half, first)
        key, config, own, ref = key[first], config[first], own[first], ref[first]
        start = group_starts(key, config)
        sizes = np.diff(np.append(start, len(key)))
        lead, many = np.repeat(start, sizes), np.repeat(sizes, sizes)
        place = np.arange(len(key)) - lead
        far = np.flatnonzero((many > GROUP) & (place > 0))
        rows = pair_rows(own[lead[far]], own[far], config[far], np.zeros(len(far), np.float32), np.ones(len(far), np.int64), buckets)
        # each label with those behind it in its group, a bounded number of pairs at a time
        behind = np.where(many > GROUP, 0, many - 1 - place)
        some = np.flatnonzero(behind)
        cut = np.searchsorted(np.cumsum(behind[some]), np.arange(1, 1 + int(behind.sum()) // HELD) * HELD)
        found = []
        for at in np.split(some, np.unique(cut)):
            if len(at):
                left, right = np.repeat(at, behind[at]), ranges(at + 1, behind[at])
                ok = (100 * high[left] >= bands.percent * low[right]) & (100 * high[right] >= bands.percent * low[left])
                left, right = left[ok], right[ok]
                near = np.bitwise_count(bits[ref[left]] ^ bits[ref[right]]).sum(axis=1).astype(np.int64) - radius[left] - radius[right]
                ok = near <= bands.apart(high[left] + high[right])
                found.append((left[ok], right[ok]))
        if found:
            left, right = (np.concatenate([f[k] for f in found]) for k in range(2))
            rows += pair_rows(own[left], own[right], config[left], half[left] + half[right], np.ones(len(left), np.int64), buckets)
        return in_rows(rows)

    back = groups.mapInArrow(by_class, DEALT).groupBy("bucket").cogroup(labels.groupBy("bucket")).applyInArrow(labelled, DEALT)
    met = back.groupBy("bucket").applyInArrow(pairs, DEALT).groupBy("bucket").applyInArrow(enough, "a long, b long")
    return ties.union(met)


class Forest:
    """A spanning forest of links among sets, built by comparing each new set with leaders.

    A set that links with a leader is held by it. A set that doesn't link with a leader may link with what the leader
    holds only if it is within twice the distance of a link (Jaccard distances keep the triangle inequality), so only
    then are those compared. Sets that are connected already are never compared.
    """

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.parent = list(range(len(ids)))
        self.edges: list[tuple[int, int]] = []
        bands = Bands(percent, 1)
        k = int(bands.apart(2 * int(self.sizes.max()))) + 1
        starts = np.cumsum(self.sizes) - self.sizes
        who, block, value, _ = parity(np.concatenate(sets), starts, self.sizes, np.full(len(ids), k))
        self.sketch = np.zeros((len(ids), k), np.uint64)
        self.sketch[who, block] = value

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def linked(self, i: int, j: int) -> bool:
        common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * common >= self.percent * (self.sizes[i] + self.sizes[j] - common)

    def within(self, i: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of others whose similarity to i can be `percent` or more, by sizes and by the sketches' Hamming distance."""
        both = self.sizes[others], self.sizes[i]
        others = others[100 * np.minimum(*both) >= percent * np.maximum(*both)]
        step = max(1, (1 << 21) // self.sketch.shape[1])
        near = [np.bitwise_count(self.sketch[others[at : at + step]] ^ self.sketch[i]).sum(axis=1) for at in range(0, len(others), step)]
        near = np.concatenate(near) if near else np.zeros(0, np.int64)
        return others[(100 + percent) * near <= (100 - percent) * (self.sizes[others] + self.sizes[i])]

    def join(self, i: int, others: np.ndarray, one: bool = False) -> int | None:
        """Connects i to those of others that it links with, or to one of them; gives the first of these, or None."""
        found = None
        for j in self.within(i, others, self.percent).tolist():
            a, b = self.root(i), self.root(j)
            if a != b and self.linked(i, j):
                self.parent[a] = b
                self.edges.append((int(self.ids[i]), int(self.ids[j])))
                found = j if found is None else found
                if one:
                    break
        return found

    def build(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges among all sets; with side, only between sets of different sides, as each side's own were another task's."""
        if side is not None:
            for i in np.flatnonzero(side == 0).tolist():
                self.join(i, np.flatnonzero(side == 1))
            return self.edges
        leaders: list[int] = []
        held: dict[int, list[int]] = {}
        for i in range(len(self.ids)):
            near = self.within(i, np.array(leaders, np.int64), max(1, 2 * self.percent - 100)) if leaders else np.zeros(0, np.int64)
            home = self.join(i, near)
            for leader in near.tolist():
                if held[leader] and self.root(leader) != self.root(i):  # what a leader holds is connected to it
                    self.join(i, np.array(held[leader], np.int64), one=True)
            if home is None:
                leaders.append(i)
                held[i] = []
            else:
                held[home].append(i)
        return self.edges


def sets_of(table: pa.Table, size: int) -> dict[int, np.ndarray]:
    """The sets of rows (c1, text) by class; another text under a repeated doc_id isn't the class's."""
    sets: dict[int, np.ndarray] = {}
    for chunk in chunks(table.select(["c1", "text"]).to_batches()):
        h, starts, counts = shingle_sets(chunk, size)
        mine, _ = set_keys(h, starts, counts)
        for i, c in enumerate(chunk.ids.tolist()):
            if int(mine[i]) == c:
                sets[c] = h[starts[i] : starts[i] + counts[i]].copy()
    return sets


def thinned(texts: DataFrame, left: DataFrame, sized: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links with the pivots of the clusters in sized, what is left to compare) of classes (c1, root, rep, n, seen).

    A class that links with the pivot can link with one that doesn't only if their distances to the pivot differ by no
    more than a link's; classes for which there is no such one are done.
    """
    reach = (100 - percent) / 100 + 1e-9
    tile = F.pmod(F.xxhash64("c1"), F.col("tiles")).cast("int").alias("tile")
    large = left.join(sized.select("root", "tiles"), "root").select("root", "c1", "rep", "n", "seen", tile)
    rows = texts.join(large, "c1").select("root", "tile", "c1", "text")
    pivots = texts.join(sized, "c1").select(F.col("root").alias("to"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("at"), F.col("c1").alias("centre"), F.col("text").alias("body"))

    def compare(rows: pa.Table, pivot: pa.Table) -> pa.Table:
        centre = sets_of(pivot.select(["centre", "body"]).rename_columns(["c1", "text"]), size)
        (key, centre), out = next(iter(centre.items()), (0, np.zeros(0, np.uint64))), []
        for c, mine in sets_of(rows, size).items():
            common = int(np.isin(mine, centre, assume_unique=True).sum())
            union = len(mine) + len(centre) - common
            out.append((c, key, 1 - common / union, 100 * common >= percent * union))
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate((("c1", pa.int64()), ("pivot", pa.int64()), ("apart", pa.float64()), ("near", pa.bool_())))})

    seen = checkpointed(rows.groupBy("root", "tile").cogroup(pivots.groupBy("to", "at")).applyInArrow(compare, "c1 long, pivot long, apart double, near boolean"))
    judged = left.join(seen, "c1", "left")
    outside = judged.where("not near and apart <= %r" % (2 * reach)).groupBy("root").agg(F.min("apart").alias("edge"))
    kept = judged.join(outside, "root", "left").where(F.col("near").isNull() | ~F.col("near") | (F.col("apart") >= F.col("edge") - reach))
    return seen.where("near and c1 <> pivot").select(F.col("c1").alias("a"), F.col("pivot").alias("b")), checkpointed(kept.select("c1", "root", "rep", "n", (F.col("seen") | F.coalesce("near", F.lit(False))).alias("seen")))


def tile_links(docs: DataFrame, left: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links among classes (c1, root, rep, n), enough to connect all that are linked in a cluster."""
    sized = left.groupBy("root").agg(F.sum("n").alias("all")).withColumn("tiles", F.ceil(F.col("all") / TILE).cast("int"))
    weight = sized.agg(F.sum("all")).first()[0] or 0
    groups = bucket_count(int(weight), TILE // 2)
    placed = left.join(sized, "root").withColumn("tile", F.pmod(F.xxhash64("c1"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    # a class of tile t goes to every pair of tiles that holds t; small clusters share a task
    placed = placed.select("rep", "c1", "root", "tile", "tiles", other)
    placed = placed.select(
        "rep", "c1", "root", "tile",
        F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.col("root")).alias("part"),
        F.when(F.col("tiles") == 1, -1).otherwise(F.least("tile", "other")).alias("low"),
        F.when(F.col("tiles") == 1, -1).otherwise(F.greatest("tile", "other")).alias("high"),
    )
    # the same plan at every size: what is placed grows with the table, so it is never broadcast
    joined = docs.join(placed.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")

    def verify(table: pa.Table) -> pa.Table:
        tidy()
        cls, roots, tiles = table["c1"].to_numpy(), table["root"].to_numpy(), table["tile"].to_numpy()
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        sets = sets_of(table, size)
        edges = []
        held, first = np.unique(cls, return_index=True)
        here = np.array([int(c) in sets for c in held], bool)
        held, first = held[here], first[here]
        for _, where in by_bucket(np.unique(roots[first], return_inverse=True)[1]):
            if len(where) > 1:
                side = (tiles[first[where]] == high).astype(np.int8) if low != high else None
                edges += Forest(held[where], [sets[int(c)] for c in held[where]], percent).build(side)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return joined.select("c1", "root", "tile", "part", "low", "high", "text").groupBy("part", "low", "high").applyInArrow(verify, "a long, b long")


def linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Each row's (doc_id, n_shingles, c1, c2); and (c1, component, rep, first): first is the component's least class of those under its least doc_id."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    _, total = corpus_size(docs)
    known = checkpointed(classes(docs, size))
    unique = checkpointed(known.where("n_shingles > 0").groupBy("c1").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), *[F.max(f"s{k}").alias(f"s{k}") for k in range(SKETCH)]))
    most = unique.agg(F.max("n")).first()[0] or 1
    bands = Bands(percent, int(most))
    clusters = components(shared_blocks(docs, unique, size, bands, total))
    left = checkpointed(clusters.withColumnRenamed("node", "c1").join(unique, "c1").select("c1", "root", "rep", "n", F.lit(False).alias("seen")))
    links = texts = None
    for _ in range(PIVOTS):
        sized = left.groupBy("root").agg(F.sum("n").alias("all"), F.min(F.struct("seen", "c1")).alias("pivot")).where(F.col("all") > TILE)
        sized = checkpointed(sized.select("root", "pivot.c1", F.ceil(F.col("all") / TILE).cast("int").alias("tiles")))
        if sized.isEmpty():
            break
        if texts is None:  # of large clusters only, and once for all rounds
            wanted = left.join(sized.select("root"), "root", "left_semi").select(F.col("rep").alias("doc_id"), "c1")
            texts = checkpointed(docs.join(wanted.hint("merge"), "doc_id").select("c1", "text"))
        edges, left = thinned(texts, left, sized, size, percent)
        links = edges if links is None else links.union(edges)
    edges = tile_links(docs, left, size, percent)
    links = edges if links is None else links.union(edges)
    found = components(links)
    least = unique.join(found.withColumnRenamed("node", "c1"), "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    smallest = least.groupBy("root").agg(F.min(F.struct("rep", "c1")).alias("m"))
    named = least.join(smallest, "root").select("c1", F.col("m.rep").alias("component"), "rep", (F.col("c1") == F.col("m.c1")).alias("first"))
    return known, checkpointed(named)


def link(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs with a doc_id."""
    known, named = linked(docs, size, percent)
    out = known.join(named.select("c1", "component"), "c1", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_class(docs: DataFrame, size: int) -> DataFrame:
    """Rows of docs that have a doc_id, with the hash of their set as __class."""
    docs = docs.where("doc_id is not null").select("doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text")))

    def run(batches):
        for batch in batches:
            found = [set_keys(*shingle_sets(chunk, size))[0] for chunk in chunks([batch])]
            one = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one)], names=[*batch.schema.names, "__class"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__class long"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op2: components of documents by 4-word shingles with a similarity of 0.85 or more."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (five words, 0.8 or more); one row of it.

    A row is known by doc_id and the hash of its set, so another text under the same doc_id is judged by its own group.
    Texts without words are no copies of other documents. Rows with a null doc_id stay.
    """
    known, named = linked(docs, 5, 80)
    found = named.where("first").select(F.col("rep").alias("doc_id"), F.col("c1").alias("__class"))
    found = found.union(known.where("n_shingles = 0").select("doc_id", "c1").distinct())
    kept = with_class(docs, 5).join(found, ["doc_id", "__class"], "left_semi").dropDuplicates(["doc_id", "__class"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))

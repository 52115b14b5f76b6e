"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Each byte covered by a string of `least` bytes that also starts in a document with a smaller number is removed; matches
never cross documents, overlaps count, and strings are judged on the input.

The corpus is cut so that no transform spans more than a bucket. Every string of `least` bytes has an anchor, the
`least // 2 - 4` byte gram with the least hash among those it holds, so equal strings have equal anchors. A run of strings
with one anchor is a segment. Groups of documents count anchors in a merged count-min sketch (prefilter.py); only segments
whose anchor is estimated to occur twice are sent on, by bucket of the anchor. A group sends equal segments once, for the
smallest document; its other documents lose the whole segment at once. Segments are equal if their bytes are.

In a bucket the distinct segments are laid one after the other. Suffixes are sorted as deep as the threshold asks, which
gives a Burrows-Wheeler transform good for strings up to that depth. Beginning with the empty string, intervals of
suffixes are extended backward, breadth first; each round finds the borders with the next larger common prefix, and
the expansion stops at the threshold. Suffixes that no border parts share at least `least` bytes; the smallest document
of each such group keeps its string.

Balance: a gram that is common in a bounded sample of documents is taken as an anchor only where a string holds no other.
Then a very common line is an anchor only of strings inside of it, which are equal and combine before they are sent.
The sample changes where work is done, never the result.

Cases: a null text is empty and keeps its row; rows with a null doc_id take no part; rows that share a doc_id are one
document, whose strings don't remove each other. Texts shorter than the threshold stay whole. An empty table gives an
empty result. Extra columns are ignored. Bytes left over need not be valid UTF-8 where a cut falls inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, by_bucket, chunks, corpus_size, expanded, gram_hash, mix, pack, prefix_sums, range_hash, ranges, sliding_argmin, squeezed, tidy, unpack
from .prefilter import REMOVALS, SENT, applied, dealt, estimated_twice, group_chunks, met, repeated, sent, sketch_shape

SAMPLE_DOCS = 512  # documents in which common grams are looked for
COMMON = 0.01  # share of these from which on a gram counts as common
PIECE_BYTES = 3 << 19  # of segments that one transform spans
HIGH = np.uint64(1 << 63)
COMMON_BITS = 20


class Cutter:
    """Cuts chunks into segments: runs of strings of `least` bytes that have one anchor."""

    def __init__(self, least: int, common: np.ndarray):
        self.least, self.gram = least, max(1, least // 2 - 4)
        self.common = np.zeros(1 << COMMON_BITS, bool)
        self.common[(common >> np.uint64(64 - COMMON_BITS)).astype(np.int64)] = True

    def grams(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        sums = prefix_sums(BYTE_CODES[chunk.buf])
        return sums, gram_hash(sums, self.gram)

    def cut(self, chunk):
        """Prefix sums, gram hashes, and for each segment its anchor, document, start and end in the chunk."""
        sums, grams = self.grams(chunk)
        rank = grams >> np.uint64(1)
        rank[self.common[(grams >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]] |= HIGH
        best = sliding_argmin(rank, self.least - self.gram + 1)
        counts = np.maximum(0, chunk.sizes - self.least + 1)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = ranges(chunk.starts, counts)
        anchor = best[at]
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if len(at) else at
        last = np.append(first[1:], len(at))[: len(first)] - 1
        return sums, grams, anchor[first], doc[first], at[first], at[last] + self.least


def common_grams(docs: DataFrame, least: int) -> np.ndarray:
    """Hashes of the grams in at least a share COMMON of a sample of about SAMPLE_DOCS documents."""
    rows, _ = corpus_size(docs)
    part = max(1, rows // SAMPLE_DOCS)
    plain = Cutter(least, np.zeros(0, np.uint64))

    def count(batches):
        seen, n = [], 0
        for chunk in chunks(batches):
            _, grams = plain.grams(chunk)
            n += len(chunk.ids)
            seen += [np.unique(grams[s:e]) for s, e in zip(chunk.starts, np.maximum(chunk.starts, chunk.ends - plain.gram + 1), strict=True)]
        if n:
            found, times = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([found[times >= max(4, COMMON * n)].tobytes()], pa.binary())], names=["grams"])

    sample = docs.where(F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary")) % part == 0)
    got = sample.repartition(1).mapInArrow(count, "grams binary").collect()
    return np.concatenate([np.frombuffer(bytes(r[0]), np.uint64) for r in got]) if got else np.zeros(0, np.uint64)


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least; what lies beyond the end counts as 0."""
    n = len(text)
    held = np.zeros(n + 8, np.uint64)
    held[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | held[k : k + n]
    reach = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.append(False, ranked[1:] != ranked[:-1])
        if reach >= depth or new[1:].all():
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
        after = np.zeros(n, np.uint64)
        if reach < n:
            after[:-reach] = rank[reach:]
        key = (rank << np.uint64(32)) | after
        reach *= 2


def prefix_borders(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """border[i]: suffix order[i] shares fewer than `least` bytes with the one before it.

    Text ends each segment by 0, and no string that is expanded holds a 0. Expansion is breadth first: after round r
    exactly the borders with a common prefix of at most r bytes are known.
    """
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix goes when it is extended by the byte before it
    step[by_byte] = np.arange(n)
    plain = bwt != 0
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    owner = np.full(n + 1, -1, np.int64)
    for _ in range(least):
        if not len(low):
            break
        sizes = high - low
        at = ranges(low, sizes)
        who = np.repeat(np.arange(len(low)), sizes)
        ok = plain[at]
        at, who = at[ok], who[ok]
        if not len(at):
            break
        to = step[at]
        owner[to] = who * 256 + bwt[at]
        to.sort()
        mine = owner[to]
        new = np.append(True, (mine[1:] != mine[:-1]) | (to[1:] != to[:-1] + 1))
        first = np.flatnonzero(new)
        low, high = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~border[high]
        border[high[fresh]] = True
        # an interval whose right border was known before can extend only to borders that are known as well
        low, high = low[fresh], high[fresh]
    return border[:n]


def smallest_owner(lengths: np.ndarray, data: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments laid end to end, one owner each: for each string of `least` bytes its segment, and the smallest owner."""
    text = np.zeros(len(data) + len(lengths), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    text[ranges(starts, lengths)] = data + np.uint8(1)  # 255 occurs in no UTF-8
    order = sorted_suffixes(text, least)
    border = prefix_borders(text, order, least)
    counts = lengths - least + 1
    where = ranges(starts, counts)
    valid = np.zeros(len(text), bool)
    valid[where] = True
    segment = np.zeros(len(text), np.int64)
    segment[where] = np.repeat(np.arange(len(lengths)), counts)
    group = np.cumsum(border) - 1
    held = valid[order]
    group, place = group[held], order[held]
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least_owner = np.minimum.reduceat(owners[segment[place]], firsts)
    out = np.zeros(len(text), np.int64)
    out[place] = np.repeat(least_owner, np.diff(np.append(firsts, len(group))))
    return segment[where], out[where]


def equal_runs(lengths: np.ndarray, data: np.ndarray, order: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For segments laid end to end and sorted by hash: whether each differs from the first one of its hash.

    The bytes are compared, so that segments whose hashes collide are taken for different ones.
    """
    offset = np.cumsum(lengths) - lengths
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    lead = order[new][np.cumsum(new) - 1]
    unlike = ~new & (lengths[order] != lengths[lead])
    check = np.flatnonzero(~new & ~unlike)
    if len(check):
        sizes = lengths[order[check]]
        same = data[ranges(offset[order[check]], sizes)] == data[ranges(offset[lead[check]], sizes)]
        unlike[check] = ~np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
    return new | unlike


def resolve(anchor, doc, start, lengths, data, least: int):
    """(segment, start, end) of the bytes to remove of the segments of a bucket."""
    offset = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    content = range_hash(prefix_sums(BYTE_CODES[data]), offset, offset + lengths)
    order = np.lexsort((doc, content, anchor))
    new_anchor = np.append(True, anchor[order][1:] != anchor[order][:-1])
    new = new_anchor | equal_runs(lengths, data, order, content ^ mix(anchor.astype(np.uint64)))
    firsts = np.flatnonzero(new)  # one for each distinct segment, of its smallest document
    of = np.cumsum(new) - 1
    owner = doc[order[firsts]]
    # a segment that smaller documents hold as well goes as a whole
    later = order[doc[order] > owner[of]]
    out = [(later, start[later], start[later] + lengths[later])]
    # segments that share an anchor but differ are compared string by string
    per_anchor = np.add.reduceat(new[:].astype(np.int64), np.flatnonzero(new_anchor))
    several = (per_anchor > 1)[np.cumsum(new_anchor) - 1]
    pick = np.flatnonzero(several[firsts])
    if len(pick):
        rows = order[firsts[pick]]
        segment, smallest = smallest_owner(lengths[rows], data[ranges(offset[rows], lengths[rows])], owner[pick], least)
        place = np.arange(len(segment)) - np.repeat(np.cumsum(lengths[rows] - least + 1) - (lengths[rows] - least + 1), lengths[rows] - least + 1)
        gone = smallest < owner[pick][segment]
        seg, at = segment[gone], place[gone]
        if len(seg):
            cut = np.append(True, (seg[1:] != seg[:-1]) | (at[1:] != at[:-1] + 1))
            head = np.flatnonzero(cut)
            tail = np.append(head[1:], len(seg)) - 1
            seg, low, high = seg[head], at[head], at[tail] + least
            # every occurrence in the smallest document itself loses these runs
            mine = np.flatnonzero(doc[order] == owner[of])
            holders = order[mine]
            spot = np.full(len(firsts), -1)
            spot[pick] = np.arange(len(pick))
            which = spot[of[mine]]
            holders, which = holders[which >= 0], which[which >= 0]
            by = np.argsort(which, kind="stable")
            holders, which = holders[by], which[by]
            left, right = np.searchsorted(which, seg), np.searchsorted(which, seg, "right")
            many = right - left
            h = holders[ranges(left, many)]
            out.append((h, start[h] + np.repeat(low, many), start[h] + np.repeat(high, many)))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def removals(groups: DataFrame, buckets: int, total: int, cutter: Cutter) -> DataFrame:
    """REMOVALS: the byte ranges to remove."""
    least, shape = cutter.least, sketch_shape(total // 14)
    shared = groups.sparkSession.sparkContext.broadcast(cutter)

    def anchors(chunk):
        _, grams, anchor, _, _, _ = shared.value.cut(chunk)
        return grams[anchor]

    def find(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tidy()
        if not len(rows):
            return sent(0, buckets, ([],), [])
        held = []
        for chunk in group_chunks(rows):
            sums, grams, anchor, doc, start, end = shared.value.cut(chunk)
            held.append((chunk, grams[anchor], doc, start, end, range_hash(sums, start, end)))
        known = np.unique(np.concatenate([h[1] for h in held])) if held else np.zeros(0, np.uint64)
        twice = estimated_twice(answers, known, shape)
        found = []
        for chunk, anchor, doc, start, end, content in held:
            pick = np.flatnonzero(twice[np.searchsorted(known, anchor)]) if len(anchor) else anchor
            lengths = end[pick] - start[pick]
            found.append((anchor[pick], content[pick], chunk.ids[doc[pick]], start[pick] - chunk.starts[doc[pick]], lengths, chunk.buf[ranges(start[pick], lengths)]))
        g = rows["g"][0].as_py()
        if not found or not sum(len(f[0]) for f in found):
            return sent(g, buckets, ([],), [])
        anchor, content, doc, start, lengths, data = (np.concatenate([f[k] for f in found]) for k in range(6))
        offset = np.cumsum(lengths) - lengths
        order = np.lexsort((doc, content))
        first = equal_runs(lengths, data, order, content)
        smallest = doc[order][first][np.cumsum(first) - 1]
        gone, kept = order[doc[order] > smallest], order[doc[order] == smallest]
        blobs = []
        for bucket, at in by_bucket((mix(anchor[kept]) % np.uint64(buckets)).astype(np.int32)):
            at = kept[at]
            ids, ref = np.unique(doc[at], return_inverse=True)
            # a group's anchors may share half of their hash; then more segments are compared by their bytes
            blobs.append((bucket, squeezed(pack(np.array([g], np.int32), ids, ref.astype(np.uint32), (anchor[at] >> np.uint64(16)).astype(np.uint32), start[at].astype(np.uint32), lengths[at].astype(np.uint32), data[ranges(offset[at], lengths[at])]))))
        return sent(g, buckets, (doc[gone], start[gone], start[gone] + lengths[gone]), blobs)

    def compared(blobs):
        tidy()
        parts = [unpack(expanded(b), np.int32, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8) for b in blobs]
        g = np.concatenate([np.full(len(p[2]), p[0][0]) for p in parts])
        doc = np.concatenate([p[1][p[2]] for p in parts])
        anchor, start, lengths, data = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
        start, lengths = start.astype(np.int64), lengths.astype(np.int64)
        offset = np.cumsum(lengths) - lengths
        out = []
        for _, at in by_bucket((mix(anchor.astype(np.uint64)) % np.uint64(1 + len(data) // PIECE_BYTES)).astype(np.int64)):
            which, low, high = resolve(anchor[at], doc[at], start[at], lengths[at], data[ranges(offset[at], lengths[at])], least)
            out.append((g[at][which], doc[at][which], low, high))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(4))

    answers = repeated(groups, anchors, shape)
    found = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(find, SENT)
    return found.groupBy("bucket").applyInArrow(lambda table: met(table, compared), REMOVALS)


def without_repeats(docs: DataFrame, least: int, finish, schema: str, keep: tuple[str, ...]) -> DataFrame:
    """(kept, found) of each row, as applied() gives them."""
    groups, buckets, total = dealt(docs, keep)
    cutter = Cutter(least, common_grams(docs.select("doc_id", "text").where("doc_id is not null"), least))
    return applied(groups, removals(groups, buckets, total, cutter), finish, schema)


def kept_bytes(data: bytes, starts, ends) -> bytes:
    out, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    """op3: bytes of documents covered by 50-byte strings of documents with smaller numbers."""

    def finish(data, starts, ends):
        kept = kept_bytes(data, starts, ends)
        return len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, 50, finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ("doc_id",)).select("kept.*", "found.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the repeated strings. A character that a cut divides goes as a whole; n_chars is set anew.

    Documents of which no letter or digit is left go. Returns the columns of docs.
    """

    def finish(data, starts, ends):
        return (kept_bytes(data, starts, ends).decode("utf-8", "ignore"),)

    out = without_repeats(docs, 50, finish, "text string", tuple(c for c in docs.columns if c != "text"))
    out = out.where(F.col("found.text").rlike(r"[\p{L}\p{N}]"))
    of = {"text": F.col("found.text")}
    if "n_chars" in docs.columns:
        of["n_chars"] = F.length("found.text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[of.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])

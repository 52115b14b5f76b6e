"""Removal of repeated runs of words behind a count-min prefilter.

Words are `[^\\x20\\x09-\\x0D]+`. A window is `window` consecutive words of one document; each word of a window whose word
sequence starts earlier (in a document with a smaller number, or earlier in the same one) is removed, judged on the input.

First pass: every window is counted under its anchor, the sub-window of `window // 2` words with the least hash. Equal
windows have equal anchors, so the count of an anchor is never below that of a window. Groups of documents sketch their
anchors' counts (saturating at two, the only count that matters); the partial sketches are merged cell by cell, slice by
slice (prefilter.py). Second pass: windows whose anchor is estimated to occur twice are grouped exactly, by a 96-bit hash,
in buckets of their anchors. The sketch overestimates, so no repeated window is lost.
A group sends only its first occurrence of a window, so a passage that a third of all documents share is a few rows; what
is to be removed goes back as one row for each group.

Cases: a null text is empty and keeps its row; rows with a null doc_id take no part and stay whole; rows that share a
doc_id count as one document whose equal starts are the same place. An empty table gives an empty result. Extra columns
are ignored. Memory follows the longest text and the size of a group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bucket, gram_hash, mix, pack, prefix_sums, range_hash, sliding_argmin, tidy, unpack
from .prefilter import REMOVALS, SENT, applied, dealt, estimated_twice, group_chunks, met, repeated, sent, sketch_shape

SECOND = np.uint64(0xD6E8FEB86659FD93)  # gives the same words other codes, for a second hash


def windows(chunk, size: int):
    """Word hashes, their prefix sums, the windows' starts and anchors, the grams' hashes, each window's document and place."""
    words, lo, hi, _, _ = chunk.words()
    sums = prefix_sums(words)
    sub = max(1, size // 2)
    grams = gram_hash(sums, sub)
    best = sliding_argmin(grams, size - sub + 1)
    counts = np.maximum(0, hi - lo - size + 1)
    doc = np.repeat(np.arange(len(lo)), counts)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = lo[doc] + place
    return words, sums, start, best[start], grams, doc, place


def window_anchors(size: int):
    def get(chunk) -> np.ndarray:
        _, _, _, best, grams, _, _ = windows(chunk, size)
        return grams[np.unique(best)]

    return get


def later_places(h1, h2, doc, place) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): windows that another place before them equals, and the first of each window."""
    order = np.lexsort((place, doc, h2, h1))
    a, b = h1[order], h2[order]
    first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    # the same place of one document, should a table hold its row twice, isn't earlier than itself
    lead = order[first][np.cumsum(first) - 1]
    return order[(doc[order] != doc[lead]) | (place[order] != place[lead])], order[first]


def removals(groups: DataFrame, buckets: int, total: int, size: int) -> DataFrame:
    """REMOVALS: the word ranges to remove."""
    shape = sketch_shape(total // 24)

    def find(rows: pa.Table, answers: pa.Table) -> pa.Table:
        tidy()
        if not len(rows):
            return sent(0, buckets, ([],), [])
        held = [(chunk, *windows(chunk, size)) for chunk in group_chunks(rows)]
        used = [grams[np.unique(best)] for _, _, _, _, best, grams, _, _ in held]
        anchors = np.unique(np.concatenate(used)) if used else np.zeros(0, np.uint64)
        twice = estimated_twice(answers, anchors, shape)
        found = []
        for chunk, words, sums, start, best, grams, doc, place in held:
            pick = np.flatnonzero(twice[np.searchsorted(anchors, grams[best])]) if len(best) else best
            h = range_hash(sums, start[pick], start[pick] + size)
            other = range_hash(prefix_sums(mix(words ^ SECOND)), start[pick], start[pick] + size)
            found.append((mix(grams[best[pick]]), h, (other >> np.uint64(32)).astype(np.uint32), chunk.ids[doc[pick]], place[pick]))
        g = rows["g"][0].as_py()
        if not found or not sum(len(f[0]) for f in found):
            return sent(g, buckets, ([],), [])
        anchor, h1, h2, doc, place = (np.concatenate([f[k] for f in found]) for k in range(5))
        gone, kept = later_places(h1, h2, doc, place)
        blobs = []
        for bucket, at in by_bucket((anchor[kept] % np.uint64(buckets)).astype(np.int32)):
            at = kept[at]
            ids, ref = np.unique(doc[at], return_inverse=True)
            blobs.append((bucket, pack(np.array([g], np.int32), ids, ref.astype(np.uint32), h1[at], h2[at], place[at].astype(np.uint32))))
        return sent(g, buckets, (doc[gone], place[gone], place[gone] + size), blobs)

    def resolve(blobs):
        tidy()
        parts = [unpack(b, np.int32, np.int64, np.uint32, np.uint64, np.uint32, np.uint32) for b in blobs]
        g = np.concatenate([np.full(len(p[2]), p[0][0]) for p in parts])
        doc = np.concatenate([p[1][p[2]] for p in parts])
        h1, h2, place = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        place = place.astype(np.int64)
        gone, _ = later_places(h1, h2, doc, place)
        return g[gone], doc[gone], place[gone], place[gone] + size

    answers = repeated(groups, window_anchors(size), shape)
    found = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(find, SENT)
    return found.groupBy("bucket").applyInArrow(lambda table: met(table, resolve), REMOVALS)


def kept_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    words, kept, at = data.split(), [], 0  # bytes.split() cuts at exactly the six white-space bytes
    for s, e in zip(starts, ends, strict=True):
        kept += words[at:s]
        at = e
    return words, kept + words[at:]


def without_repeats(docs: DataFrame, size: int, finish, schema: str, keep: tuple[str, ...]) -> DataFrame:
    groups, buckets, total = dealt(docs, keep)
    return applied(groups, removals(groups, buckets, total, size), finish, schema).select("kept.*", "found.*")


def dedup(docs: DataFrame, size: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each document with its words, those removed and the text of the words that stay, joined by one space."""

    def finish(data, starts, ends):
        words, kept = kept_words(data, starts, ends)
        return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")

    return without_repeats(docs, size, finish, "n_words long, n_removed long, kept_text string", keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: repeated windows of 20 words of documents."""

    def finish(data, starts, ends):
        words, kept = kept_words(data, starts, ends)
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 20, finish, "n_words long, n_removed long, kept_sha256 string", ("doc_id",))

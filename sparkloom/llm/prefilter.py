"""A count-min prefilter over documents dealt in groups, and the removal of byte or word ranges from them.

Documents are dealt once, by a hash of doc_id, in groups of about GROUP_BYTES. All passes read that one exchange. In the
first pass each group sketches the hashes it is asked for: which cells of each row of a count-min sketch it counts, and
which of them twice or more. Cells are cut in slices of 2**SLICE_BITS; the partial sketches of a slice are merged cell by
cell in one task, which answers each group by one bit for each cell that the group had sent. No task, and never the driver,
holds more than a slice, so the sketch grows with the corpus: about eight cells for each expected hash at any size. The second pass
meets the group's texts with its answers. A sketch overestimates, so nothing that repeats is lost.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, by_bucket, byte_parts, chunks, corpus_size, merged_ranges, mix, pack, tidy, unpack

GROUP_BYTES = 4 << 20
SLICE_BITS = 23
ROWS = 2
SEEDS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
REMOVALS = "g int, payload binary"


def dealt(docs: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    """((g, id, text, kept), groups, bytes): rows by group, with the columns to keep in one struct; rows of a doc_id share a group."""
    _, total = corpus_size(docs)
    groups = bucket_count(total, GROUP_BYTES)
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"))  # rows without doc_id are spread as well
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    return docs.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").alias("id"), "text", kept.alias("kept")), groups, total


def group_chunks(table: pa.Table):
    """Chunks of a group's rows that have an id."""
    return chunks(table.filter(pc.is_valid(table["id"])).select(["id", "text"]).to_batches())


class Shape(NamedTuple):
    """A row of the sketch: 2**bits cells in slices of 2**width."""

    bits: int
    width: int


def sketch_shape(expected: int) -> Shape:
    """About eight cells for each expected hash, as a power of two."""
    bits = max(16, int(max(1, 8 * expected) - 1).bit_length())
    return Shape(bits, min(bits, SLICE_BITS))


def cells_of(hashes: np.ndarray, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct cells of hashes in ascending order, and each hash's place among them."""
    return np.unique(mix(hashes ^ SEEDS[row]) >> np.uint64(64 - bits), return_inverse=True)


def slice_ends(cells: np.ndarray, width: int):
    """(slice, first, end) of each slice that sorted cells lie in."""
    part = (cells >> np.uint64(width)).astype(np.int64)
    if not len(part):
        return ()
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True)


def repeated(groups: DataFrame, anchors, shape: Shape) -> DataFrame:
    """(g, slice, payload): for each group and slice, one bit for each of its cells: whether all groups together count two.

    anchors(chunk) gives a hash for each occurrence.
    """
    bits, width = shape
    slices = 1 << (bits - width)

    def partial(table: pa.Table) -> pa.Table:
        tidy()
        found = [anchors(c) for c in group_chunks(table)]
        keys, blobs = [], []
        if found:
            u, times = np.unique(np.concatenate(found), return_counts=True)
            for row in range(ROWS):
                cells, at = cells_of(u, row, bits)
                more = np.bincount(at, times, len(cells)) > 1
                for part, a, b in slice_ends(cells, width):
                    local = (cells[a:b] & np.uint64((1 << width) - 1)).astype(np.uint32)
                    step = np.diff(local, prepend=np.uint32(0))
                    keys.append(row * slices + part)
                    narrow = bool(step.max() < 65536)
                    blobs.append(bytes([narrow]) + pack(step.astype(np.uint16 if narrow else np.uint32), np.packbits(more[a:b])))
        return pa.table({"slice": pa.array(keys, pa.int64()), "g": pa.array([table["g"][0].as_py()] * len(keys), pa.int32()), "payload": pa.array(blobs, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        tidy()
        counts = np.zeros(1 << width, np.uint8)

        def read(blob):
            raw = blob.as_py()
            step, more = unpack(raw[1:], np.uint16 if raw[0] else np.uint32, np.uint8)
            return np.cumsum(step, dtype=np.int64), more

        for blob in table["payload"]:
            at, more = read(blob)
            counts[at] = np.minimum(2, counts[at] + 1 + np.unpackbits(more, count=len(at)))
        bits_of = [np.packbits(counts[read(blob)[0]] > 1).tobytes() for blob in table["payload"]]
        return pa.table({"g": table["g"], "slice": table["slice"], "payload": pa.array(bits_of, pa.binary())})

    parts = groups.groupBy("g").applyInArrow(partial, "slice long, g int, payload binary")
    return parts.groupBy("slice").applyInArrow(merge, "g int, slice long, payload binary")


def estimated_twice(answers: pa.Table, hashes: np.ndarray, shape: Shape) -> np.ndarray:
    """Which of a group's distinct sorted hashes repeated() counts twice or more."""
    bits, width = shape
    slices = 1 << (bits - width)
    blobs = dict(zip(answers["slice"].to_pylist(), answers["payload"], strict=True))
    out = np.ones(len(hashes), bool)
    for row in range(ROWS):
        cells, at = cells_of(hashes, row, bits)
        twice = np.zeros(len(cells), bool)
        for part, a, b in slice_ends(cells, width):
            twice[a:b] = np.unpackbits(np.frombuffer(blobs[row * slices + part].as_buffer(), np.uint8), count=b - a)
        out &= twice[at]
    return out


def runs_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges to remove, those of a document that touch put together where they follow each other."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])))
    return doc[at], start[at], np.maximum.reduceat(end, at)


def removal_payload(doc, start, end) -> bytes:
    doc, start, end = runs_of(np.asarray(doc, np.int64), np.asarray(start, np.int64), np.asarray(end, np.int64))
    ids, ref = np.unique(doc, return_inverse=True)
    return pack(ids, ref.astype(np.uint32), start.astype(np.uint32), (end - start).astype(np.uint32))


def removal_rows(g: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, bytes]]:
    """(g, payload): all ranges for the documents of a group in one row."""
    return [(group, removal_payload(doc[at], start[at], end[at])) for group, at in by_bucket(g)]


def met(table: pa.Table, resolve) -> pa.Table:
    """REMOVALS of a bucket: rows of tag 1 are removals already, resolve(blobs) gives (g, doc, start, end) of the others."""
    tags = table["tag"].to_pylist()
    rows = [(g, b.as_py()) for g, t, b in zip(table["g"].to_pylist(), tags, table["payload"], strict=True) if t]
    blobs = [b.as_buffer() for t, b in zip(tags, table["payload"], strict=True) if not t]
    if blobs:
        rows += removal_rows(*resolve(blobs))
    return pa.table({"g": pa.array([g for g, _ in rows], pa.int32()), "payload": pa.array([b for _, b in rows], pa.binary())})


SENT = "bucket int, tag int, g int, payload binary"


def sent(g: int, buckets: int, gone: tuple, blobs: list[tuple[int, bytes]]) -> pa.Table:
    """SENT of a group: (bucket, payload) pairs, and what the group's own documents lose by each other."""
    rows = [(b, 0, g, x) for b, x in blobs]
    if len(gone[0]):
        rows.append((g % buckets, 1, g, removal_payload(*gone)))
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("bucket", pa.int32()), ("tag", pa.int32()), ("g", pa.int32()), ("payload", pa.binary())))})


KINDS = {"long": pa.int64(), "string": pa.string()}


def applied(groups: DataFrame, removals: DataFrame, finish, schema: str) -> DataFrame:
    """(kept, found): of each row what finish(bytes, starts, ends) gives for its text and the maximal ranges to remove."""
    fields = [(n, KINDS[t]) for n, t in (f.strip().split() for f in schema.split(","))]

    def run(rows: pa.Table, gone: pa.Table) -> pa.Table:
        tidy()
        parts = [unpack(b.as_buffer(), np.int64, np.uint32, np.uint32, np.uint32) for b in gone["payload"]]
        doc = np.concatenate([p[0][p[1]] for p in parts]) if parts else np.zeros(0, np.int64)
        start = np.concatenate([p[2] for p in parts]).astype(np.int64) if parts else doc
        end = start + (np.concatenate([p[3] for p in parts]).astype(np.int64) if parts else doc)
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
        ids = rows["id"].to_pylist()
        none = np.zeros(0, np.int64)
        known = np.array([0 if i is None else i for i in ids], np.int64)
        lo, hi = np.searchsorted(doc, known), np.searchsorted(doc, known, "right")
        out = []
        for i, a, b, text in zip(ids, lo.tolist(), hi.tolist(), byte_parts(rows["text"]), strict=True):
            out.append(finish(bytes(text), *(merged_ranges(start[a:b], end[a:b]) if i is not None and b > a else (none, none))))
        found = pa.StructArray.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
        return pa.table({"kept": rows["kept"], "found": found})

    kept = groups.schema["kept"].dataType.simpleString()
    return groups.groupBy("g").cogroup(removals.groupBy("g")).applyInArrow(run, f"kept {kept}, found struct<{', '.join(f'{n}:{t}' for n, t in (f.strip().split() for f in schema.split(',')))}>".replace("long", "bigint"))

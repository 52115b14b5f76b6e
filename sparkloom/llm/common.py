"""What the text operators share: hashing of byte and word ranges, packed exchanges, checkpoints, components.

Text is worked on as numpy blocks of about half a megabyte. An exchange sends packed arrays keyed by a bucket of a
hash, so that Spark moves a few large rows and every bucket has a bounded share of the input.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 19
ARROW_BYTES = 4 << 20  # of a batch that goes to a Python worker
SCAN_ROWS = 512  # rows that a Parquet scan lays out at a time
_MASK = (1 << 64) - 1
_BASE = 0x9E6C63D0876A9A63  # odd, so that its powers can be inverted modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
LARGE_ROWS = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1"}  # rows of megabytes: each one a row group
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_allocation = getattr(ctypes.CDLL(None), "mallopt", None)


def tidy() -> None:
    """Gives freed memory back to the system; workers live on from stage to stage, and what they hold is the executor's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def steady() -> None:
    """From now on the process keeps at most 16 MB of freed memory at hand, and arrays of 4 MB and more go back at once.

    By default these bounds follow the arrays freed so far: a worker that met large ones holds on to more, and one that
    only met small ones gives them back and asks for them again at each step.
    """
    if _allocation is not None:
        _allocation(-1, 16 << 20)  # M_TRIM_THRESHOLD
        _allocation(-3, 4 << 20)  # M_MMAP_THRESHOLD


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ARROW_BYTES and its Parquet batches to SCAN_ROWS; a lower setting stays.

    Every task has a few such batches in the executor's memory at once, and by default they are 64 MB and 4096 whole texts.
    Rows are only cut into more batches, so results stay the same. Frames are planned when they are run, often by the
    caller, so the session keeps the setting.
    """
    conf = spark._jsparkSession.sessionState().conf()
    for key, now, most in (("execution.arrow.maxBytesPerBatch", conf.arrowMaxBytesPerBatch(), ARROW_BYTES), ("parquet.columnarReaderBatchSize", conf.parquetVectorizedReaderBatchSize(), SCAN_ROWS)):
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.{key}", str(most))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(which: str, base: int, n: int) -> np.ndarray:
    if which not in _powers or len(_powers[which]) < n:
        size = max(1 << int(n).bit_length(), 1 << 19)
        steps = np.full(size, base & _MASK, np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps, dtype=np.uint64)
    return _powers[which][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes times powers of a base; with range_hash they hash any range in constant time."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power_table("up", _BASE, len(codes)), out=out[1:], dtype=np.uint64)
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] that doesn't depend on where the range lies."""
    return mix((sums[end] - sums[start]) * _power_table("down", _INVERSE, len(sums))[start])


def gram_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ranges of one size."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[size:] - sums[:-size]) * _power_table("down", _INVERSE, n))


def byte_parts(column: pa.Array | pa.ChunkedArray) -> list[memoryview]:
    """The UTF-8 bytes of each value without decoding; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        return [x for c in column.chunks for x in byte_parts(c)]
    if len(column) == 0:
        return []
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    view = memoryview(data) if data is not None else memoryview(b"")
    valid = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    return [view[at[i] : at[i + 1]] if valid is None or valid[i] else view[:0] for i in range(len(column))]


def strings(column: pa.Array) -> list[str | None]:
    """Values as strings; bytes that are no UTF-8 become replacement characters."""
    return [bytes(p).decode("utf-8", "replace") if ok else None for p, ok in zip(byte_parts(column), column.is_valid().to_pylist(), strict=True)]


class Chunk:
    """Documents laid one after the other, each followed by a line feed."""

    def __init__(self, ids: np.ndarray, parts: list):
        self.ids = ids
        self.sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        self.buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[:-1]
        self.ends = self.starts + self.sizes

    def words(self, codes: np.ndarray | None = None, fold: bool = False):
        """Hash of each word, and for each document its first word and the one past its last."""
        buf = self.buf
        if fold:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        letters = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
        edge = np.flatnonzero(np.diff(letters.astype(np.int8), prepend=np.int8(0)))
        first, last = edge[0::2], edge[1::2]
        hashes = range_hash(prefix_sums(BYTE_CODES[buf]), first, last)
        return hashes, np.searchsorted(first, self.starts), np.searchsorted(first, self.ends), first, last


def chunks(batches, limit: int = CHUNK_BYTES):
    """Chunks of (doc_id, text) record batches: about limit bytes each, or one document that is longer."""
    ids, parts, total = [], [], 0
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for key, part in zip(keys, byte_parts(batch.column(1)), strict=True):
            if parts and total + len(part) > limit:
                yield Chunk(np.array(ids, np.int64), parts)
                ids, parts, total = [], [], 0
            ids.append(key)
            parts.append(part)
            total += len(part) + 1
    if parts:
        yield Chunk(np.array(ids, np.int64), parts)
    ids, parts = [], []
    tidy()


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each range of width values the place of its smallest value, the leftmost among equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = max(24, int(len(values) - 1).bit_length())  # the same at any length, so that equal ranges agree
    low = np.uint64((1 << bits) - 1)
    held = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        held = np.minimum(held[:-size], held[size:])
        size *= 2
    if size < width:
        held = np.minimum(held[: len(held) - (width - size)], held[width - size :])
    return (held[:n] & low).astype(np.int64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all given ranges, one range after the other."""
    if len(starts) == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def by_bucket(bucket: np.ndarray):
    """(bucket, indices) for each bucket that occurs."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    for at, to in zip(cut, np.append(cut[1:], len(sorted_)), strict=True):
        yield int(sorted_[at]), order[at:to]


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    sizes = np.frombuffer(blob, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds, strict=True):
        item = np.dtype(kind).itemsize
        out.append(np.frombuffer(bytes(blob[at : at + size]) if at % item else blob, kind, size // item, 0 if at % item else at))
        at += int(size)
    return out


def squeezed(blob: bytes) -> bytes:
    """Compressed, for text that is sent; expanded() undoes it."""
    return np.int64(len(blob)).tobytes() + pa.compress(blob, codec="zstd", asbytes=True)


def expanded(blob) -> bytes:
    return pa.decompress(blob[8:], int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)


def merged_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open ranges; ranges that touch are one run."""
    if len(starts) == 0:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def corpus_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes, counted over all rows."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def bucket_count(size: int, target: int = 4 << 20) -> int:
    """Buckets of about target bytes; at least 16, so that small inputs are spread as well."""
    return max(16, -(-size // target))


def shared_path(spark: SparkSession) -> str:
    """A new name in the folder that the cluster names; only a session that names none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparkloom-table-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage by a table in the shared folder: computed once, compressed, and read again if an executor is lost."""
    path = path or shared_path(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) by alternating large-star and small-star steps.

    Returns (node, root) for each node that has an edge, root being the smallest node of its component. Each step is
    an aggregation with map-side combination and a join that adaptive execution can split, so a hub is no hot spot.
    No edges give no rows; loops, repeated edges and edges with a null end count as nothing.
    """
    spark = edges.sparkSession
    old: list[str] = []
    held: list[str] = []

    def kept(df: DataFrame, rows: int | None) -> DataFrame:
        held.append(shared_path(spark))
        # a step keeps about as many edges as the one before it; few edges need no more than a few tasks
        return checkpointed(df if rows is None else df.coalesce(max(6, rows // 250_000)), held[-1])

    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = kept(edges, None)
    before = None
    rows = edges.count()
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = kept(large, rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = kept(small, rows)
        drop_tables(spark, old)
        old, held = held[:-1], held[-1:]
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, rows = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def crc_remainder(column: str, modulus: int):
    """crc32 of the number as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def session_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

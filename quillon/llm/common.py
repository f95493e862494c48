"""Shared plumbing of the corpus operators: scratch tables, size-checked broadcasts, vectorised word hashing.

Scratch tables are Parquet folders below ``spark.checkpoint.dir`` (set here only where the session has none), so that
a lost executor costs a re-read, not the whole lineage. They are removed when superseded or when the driver exits.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to so many narrow rows; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Text is processed in runs of whole documents of about so many bytes, which bounds a worker's memory.
BLOCK_BYTES = 1 << 19
#: Scratch tables of a known number of narrow rows get a file for so many, but one for each core at least.
FILE_ROWS = 20_000

_scratch: list[tuple[SparkSession, str]] = []
#: Scratch tables whose files Spark hands out: an executor that starts later asks for them, so they stay until the exit.
_handed: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where the setting is absent (local tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = current or "file://" + tempfile.mkdtemp(prefix="quillon-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        try:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: the plan starts anew from durable files.

    ``rows`` bounds its rows, which are narrow: few rows then make few files, however many partitions they are dealt to. On
    a local file system without Hadoop's native library each file makes an executor start processes (chmod).
    """
    spark = df.sparkSession
    bounded_batches(spark)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{checkpoint_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._quillon_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_quillon_path", None)
        if path:
            _delete(df.sparkSession, path)
            _scratch[:] = [x for x in _scratch if x[1] != path]


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted ``rows`` of a narrow frame are within ``bound``; else leave it to shuffle."""
    return F.broadcast(df) if rows <= bound else df


def without(docs: DataFrame, rejected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``rejected`` does not name; each row has its own verdict, whatever its doc_id.

    ``rejected`` gets (doc_id, text) and returns the doc_ids that go. Rows without a doc_id, or with one that other rows
    have too, are written to a table of their own and named by their place in it, counted down from the largest long, so
    that of a group a row with an id of its own stays first. All other rows keep their doc_id and are not copied.
    """
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    n, nulls = shared.count(), docs.where("doc_id is null").count()
    key = f"row_{uuid.uuid4().hex}"
    own = docs.withColumn(key, F.col("doc_id").cast("long"))
    if n or nulls:
        shared = materialize(shared, "shared-ids")
        named = docs.where("doc_id is not null")
        odd = docs.where("doc_id is null").unionByName(named.join(small(shared, n), "doc_id", "left_semi").select(docs.columns))
        odd = materialize(odd.withColumn(key, F.lit((1 << 63) - 1) - F.monotonically_increasing_id()), "odd-rows")
        own = own.where("doc_id is not null").join(small(shared, n), "doc_id", "left_anti").select(*docs.columns, key).unionByName(odd)
    gone = rejected(own.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key)).distinct()
    return own.join(small(gone, gone.count()), key, "left_anti").select(docs.columns)


@contextlib.contextmanager
def scratch_until_written() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, ``keep`` names the table that stays; all other scratch tables made within it go at its end, but for models."""
    before, kept = {path for _, path in _scratch}, set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._quillon_path)
        return df

    yield keep
    for spark, path in [x for x in _scratch if x[1] not in before | kept | _handed]:
        _delete(spark, path)
        _scratch.remove((spark, path))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes, so that a Python worker's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_of_labels(labels: DataFrame, condition, bound: int) -> DataFrame:
    """At most ``bound`` labelled rows in an order drawn from a hash of doc_id: a fixed, bounded, unbiased sample."""
    return labels.where(condition & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def trimmed(run: Callable) -> Callable:
    """``run`` for mapInArrow, after which the worker, which waits for further tasks, gives freed memory back to the system."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return outer


class Fitted:
    """A model that a task has fitted: a file in the scratch folder that Spark hands to every executor that asks for it.

    Neither the sample nor the model passes through the driver. ``load`` works in tasks and in the driver.
    """

    def __init__(self, sample: DataFrame, fit: Callable[[pa.Table], Any], name: str):
        def run(batches):
            rows = [b for b in batches if b.num_rows]
            model = fit(pa.Table.from_batches(rows) if rows else None)
            data = pickle.dumps(model, protocol=5)
            for k in range(0, len(data), 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([data[k : k + (4 << 20)]], pa.binary())], ["at", "part"])

        self.table = materialize(sample.mapInArrow(trimmed(run), "at long, part binary").coalesce(1), name)
        _handed.add(self.table._quillon_path)
        self.file, self.without = "", fit(None)  # no task may run for an empty sample
        for path in self.table.inputFiles():
            sample.sparkSession.sparkContext.addFile(path)
            self.file = path.rsplit("/", 1)[-1]

    def load(self) -> Any:
        if not self.file:
            return self.without
        parts = pq.read_table(SparkFiles.get(self.file)).sort_by("at").column("part")
        return pickle.loads(b"".join(x.as_py() for x in parts)) if len(parts) else self.without

    def __getstate__(self) -> dict:
        return {"file": self.file, "without": self.without}


def in_one_task(rows: DataFrame, order: list, bound: int) -> DataFrame:
    """At most ``bound`` rows in ``order``, in one partition, whether there are any or not."""
    return rows.orderBy(*order).limit(bound).repartition(1).sortWithinPartitions(*order)


# ---------------------------------------------------------------------------------------------- words and hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.random.Generator(np.random.PCG64(911)).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK_BYTES + 4096)
        inverse = pow(_R, -1, 1 << 64)
        for key, base in (("up", _R), ("down", inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_blocks(column: pa.Array | pa.ChunkedArray, block: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents of about ``block`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.binary()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block, side="right")) - 1)
        last = min(last, n)
        lo, hi = offsets[first], offsets[last]
        yield first, last, data[lo:hi], offsets[first : last + 1] - lo
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words each document has; words are runs of bytes not ``between``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~between[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes with A-Z lower-cased, whatever its place."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and how many each document has; fewer words form one window."""
    ends = np.cumsum(counts)
    begins = ends - counts
    have = np.maximum(counts - size + 1, np.minimum(counts, 1))
    n = len(words)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    full = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        full += padded[k : k + n] * _MULT[k]
    full = mix(full)
    keep = np.zeros(n + 1, dtype=np.int32)
    np.add.at(keep, begins[have > 0], 1)
    np.add.at(keep, (begins + have)[have > 0], -1)
    out = full[np.cumsum(keep[:n]) > 0]
    places = np.cumsum(have) - have
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[begins[d] : ends[d]]
        out[places[d]] = mix((own * _MULT[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, have


def shingle_sets(column) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first, last, sorted distinct shingle hashes of each document of the run)."""
    for first, last, data, offsets in text_blocks(column):
        start, end, counts = words_of(data, offsets)
        shingles, have = shingle_hashes(word_hashes(data, start, end), counts)
        stops = np.cumsum(have)
        sets = []
        for lo, hi in zip(stops - have, stops, strict=True):
            own = np.sort(shingles[lo:hi])
            sets.append(own if len(own) < 2 else own[np.concatenate(([True], own[1:] != own[:-1]))])
        yield first, last, sets

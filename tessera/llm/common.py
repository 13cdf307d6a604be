"""What the operators of this subpackage share: staged tables, whole runs of a
sorted stream, and distributed connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir``
    names it. Only where that is unset and all tasks run in this process a folder of our
    own is made, which goes with the process; on a cluster it is an error."""
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="tessera_shared_")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return _own_root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once


def bound_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python workers in batches of at most BATCH_BYTES (or one
    row): a worker's memory follows from this, not from how long texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Return what a worker has freed to the system: workers outlive their tasks, and the
    next stage's may be others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """``run`` (batches to batches), giving back its memory at the end of each task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: it is
    computed once, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = new_path(spark, name)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    try:  # what the query shuffled goes as soon as its result is written
        spark.conf.set(cleanup, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def drop_staged(df: DataFrame | None) -> None:
    """Delete a staged table that a later staged table has superseded."""
    path = getattr(df, "staged_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, min_rows: int = 16384) -> Iterator[pa.Table]:
    """Regroup a stream sorted by ``key`` into tables that hold whole runs of
    equal keys, of at least ``min_rows`` rows but for the last. Memory is that of
    ``min_rows`` rows, one batch and one run."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        if rows >= min_rows:
            first = held[-1].column(key)[-1].as_py()
            cut = int(np.searchsorted(keys != first, True))
            if cut < len(keys):
                held.append(table.slice(0, cut))
                yield pa.concat_tables(held).combine_chunks()
                held, rows = [table.slice(cut)], len(keys) - cut
                continue
        held.append(table)
        rows += table.num_rows
    if held:
        yield pa.concat_tables(held).combine_chunks()


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def pairs_in_runs(bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions i < j that lie in one run of at most ``longest`` rows."""
    sizes = np.diff(bounds)
    starts, sizes = bounds[:-1][(sizes > 1) & (sizes <= longest)], sizes[(sizes > 1) & (sizes <= longest)]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # each row pairs with the rows that follow it in its run
    first = np.repeat(starts, sizes)
    place = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    follow = np.repeat(sizes, sizes) - place - 1
    i = np.repeat(first + place, follow)
    step = np.arange(len(i)) - np.repeat(np.cumsum(follow) - follow, follow)
    return i, i + step + 1


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest label reachable by the links i-j, starting from ``labels``
    (labels[k] <= k is a position with the same component)."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels


FEW = 1 << 14  # links up to which one task joins them


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches]
    nodes, place = np.unique(np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64), return_inverse=True)
    place = place.reshape(2, -1)
    labels = merge_labels(np.arange(len(nodes)), place[0], place[1])
    yield pa.record_batch({"node": pa.array(nodes), "component": pa.array(nodes[labels])})


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); component is the
    smallest node that its links reach.

    Large-star and small-star steps alternate; each round is written to the shared
    folder, so lineage stays short and nothing is collected. A node with very many
    links is pre-aggregated to its smallest neighbour before the shuffle, and the
    join that hands it back is one that adaptive execution splits. At most FEW links are
    joined by one task, with the same result. Nulls and loops are ignored."""
    spark = edges.sparkSession
    now = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "cc"
    )
    seen = None
    if now.count() <= FEW:
        return now.coalesce(1).mapInArrow(_joined, "node long, component long")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        after = stage(small, "cc")
        drop_staged(now)
        now = after
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(ends)

"""Shared helpers: tables, shared scratch storage, Arrow batches, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES, BATCH_ROWS, FILE_ROWS = 4 << 20, 1000, 1_000_000
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="polefold-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/polefold-{uuid.uuid4().hex}"


def own_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there goes with :func:`release`."""
    path = scratch_dir(spark)
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or own_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` narrow rows, in no more files than it needs: every file costs its writer a process or a call."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def release() -> None:
    """Delete the tables that :func:`materialise` has written in this process."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            discard(spark, path)
        except Exception:  # the session may have ended before the process
            return


def discard(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of steps whose results have been written."""
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that was freed back to the system: reused workers would keep it through later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def in_parts(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, one row at least."""
    for batch in batches:
        parts = max(1, min(batch.num_rows, -(-batch.nbytes // limit)))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, max(batch.num_rows, 1), step):
            yield batch.slice(at, step)


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str | T.StructType,
) -> DataFrame:
    """``mapInArrow`` over batches cut by bytes, in workers that give their memory back.

    Spark's default of 10,000 rows a batch holds tens of MB of texts on both sides; it is lowered
    unless the session names another number.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(in_parts(batches))
        finally:
            trim()

    return df.mapInArrow(lean, schema)


def unused(name: str, *taken: Iterable[str]) -> str:
    """``name``, with underscores before it until it clashes with no column (names ignore case)."""
    lowered = {c.lower() for names in taken for c in names}
    while name.lower() in lowered:
        name = "_" + name
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """Values of a binary column; null as empty."""
    return [x or b"" for x in column.to_pylist()]


def with_text_bytes(documents: DataFrame, *keep: str) -> DataFrame:
    """The named columns and ``raw``, the UTF-8 bytes of ``text``; other columns are not read."""
    return documents.select(*keep, F.col("text").cast("binary").alias("raw"))


def slices(values: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``limit`` bytes, one value at least."""
    start = size = 0
    for i, value in enumerate(values):
        if i > start and size + len(value) > limit:
            yield start, i
            start, size = i, 0
        size += len(value)
    if start < len(values):
        yield start, len(values)


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every node of ``edges`` (a, b: long): columns node, root.

    Alternates large-star and small-star steps until nothing changes. Every step is one aggregate of
    minima and one join, so a hub is pre-aggregated before its shuffle and its rows can be split by
    adaptive execution; only a row count reaches the driver. Nodes without an edge are not returned.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, rows = None, links.count()
    while rows:
        both = links.union(links.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.union(low.where("low < a").select("a", F.col("low").alias("b"))).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(down, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = materialise(compact(small.union(down.select("a", F.col("low").alias("b"))).where("a <> b").distinct(), rows))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, rows = state, state[0]
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()

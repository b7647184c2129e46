"""What the training-data operators share: written tables, ordered buckets and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts in a batch of a task's Python work; a longer text is a batch of its own.
BATCH_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only on one machine, as in tests, may it be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _own_dir()
    return path.rstrip("/")


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-checkpoints-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/gristmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage is cut, and the rows outlive any executor. options are the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**{"compression": "zstd", **(options or {})}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize wrote and nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the distinct non-null values of nodes.node; root is the smallest node reachable over edges (a, b).

    Each round takes the smallest label among neighbours, then a node's label's label, so that the number of rounds grows with
    the logarithm of the longest path. Both joins read two written tables: an adaptive skew join can split a hub's rows.
    Loops and repeated edges change nothing; edges must join listed nodes.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    linked = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
    labels = materialize(linked, "labels")
    while True:
        jumped = materialize(
            labels.alias("x").join(labels.alias("y"), F.col("x.root") == F.col("y.node")).select("x.node", F.col("y.root").alias("root")), "labels"
        )
        heard = both.join(jumped, both["a"] == jumped["node"]).select(F.col("b").alias("node"), "root", F.lit(False).alias("own"))
        own = jumped.select("node", "root", F.lit(True).alias("own"))
        after = materialize(
            heard.unionByName(own).groupBy("node").agg(F.min("root").alias("root"), F.min(F.when(F.col("own"), F.col("root"))).alias("before")), "labels"
        )
        moved = after.where("root <> before").limit(1).count()
        discard(labels)
        discard(jumped)
        labels = after
        if not moved:
            break
    discard(both)
    alone = nodes.select("node").where("node IS NOT NULL").select("node", F.col("node").alias("root"))
    return alone.unionByName(labels.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))


#: Rows of a batch that goes to a Python worker, where the session has Spark's default.
ARROW_ROWS = 1000


def long_rows(df: DataFrame) -> DataFrame:
    """df, whose rows hold texts: batches of Spark's default of ten thousand rows would be tens of megabytes on both sides. A session's own setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(ARROW_ROWS))
    return df


@contextlib.contextmanager
def short_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs that run meanwhile send batches of about this many bytes to Python workers, not Spark's default of 64 MB. A session's own setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key)


def clean_text(text: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(text, F.lit(""))


_HELD: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """A worker's object of this key, made when first asked for. Workers outlive tasks; what they held of another key is let go, so that memories never add up."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Gives back what a worker holds of earlier tasks."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, by rows and by bytes of their strings, so that a task holds Python values of few texts at a time."""
    for b in batches:
        used = np.zeros(len(b), np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                used += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(used), 0
        while start < len(b):
            before = total[start - 1] if start else 0
            end = min(start + rows, len(b), max(start + 1, int(np.searchsorted(total, before + size, "right"))))
            yield b.slice(start, end - start)
            start = end


def in_key_order(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (doc_id, text) dealt by ranges of doc_id, those without one first, and sorted; equal ids by their texts, whose beginnings also split them over partitions.

    Spark samples the ranges; their number is that of the tasks.
    """
    first = F.col("doc_id").asc_nulls_first()
    return docs.repartitionByRange(max(1, partitions), first, F.substring("text", 1, 64)).sortWithinPartitions(first, "text")


def partitions_of(docs: DataFrame, text_col: str, partition_bytes: int) -> int:
    """How many partitions of about partition_bytes of text docs make, by the sum of lengths."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return -(-int(total) // partition_bytes) or 1

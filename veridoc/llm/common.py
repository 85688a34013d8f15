"""What the operators share: shared scratch space, Arrow passes, joins on skewed keys, components."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Heaviest keys that a skewed join broadcasts. After them, no key holds more than 1/1000 of the rows.
HOT_KEYS = 1000

#: Where a thread notes the tables that it stages, if anybody asks.
_noted = threading.local()


@contextmanager
def staging() -> Iterator[list[str]]:
    """The paths of the tables that this thread stages meanwhile."""
    before, paths = getattr(_noted, "paths", None), []
    _noted.paths = paths
    try:
        yield paths
    finally:
        _noted.paths = before


def _note(path: str) -> None:
    if getattr(_noted, "paths", None) is not None:
        _noted.paths.append(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; set here only where unset in a session on one machine, as in tests."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        known = spark.sparkContext.getCheckpointDir()
        if known is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(known := tempfile.mkdtemp(prefix="checkpoint-"))
        return known
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation and rows can't change."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: columnar, so that later passes read only what they need."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """Write a table to the shared folder in buckets by a column: later groupings by it read it without a shuffle of its rows."""
    spark = df.sparkSession
    name, tasks = f"bucketed_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    df.repartition(tasks, column).write.bucketBy(tasks, column).option("path", path).option("compression", "zstd").saveAsTable(name)
    _note(path)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan knows them by now
    return out


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet, in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text alone, under fixed names; a null text counts as empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task, and what it keeps is missing to the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pack(values: np.ndarray) -> bytes:
    """Non-decreasing 64-bit values: differences, byte by byte, compressed."""
    steps = np.diff(values, prepend=values[:1] * 0).astype("<u8")
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def release_heaps(spark: SparkSession) -> None:
    """Have driver and executors give freed memory back to the system, by two small tasks a core: what a JVM keeps is missing to the Python beside it."""
    release()
    spark._jvm.System.gc()
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            release()
            yield out
            del out
        release()

    return df.mapInArrow(run, schema)


def join_skewed(left: DataFrame, right: DataFrame, key: str, rows: str, payload: list[str]) -> DataFrame:
    """Left outer join to a table with one row per key, where any key may hold a third of the left rows.

    rows: the column of right that says how heavy a key is. The HOT_KEYS heaviest keys are broadcast (a fixed bound); their
    left rows are salted over all tasks of the shuffled join that serves all other keys.
    """
    hot_key, salt, *hot = fresh(left, "hot_key", "hot_salt", *(f"hot_{c}" for c in payload))
    top = right.orderBy(F.desc(rows), F.col(key)).limit(HOT_KEYS).select(F.col(key).alias(hot_key), *(F.col(c).alias(h) for c, h in zip(payload, hot, strict=True)))
    hashed = [F.col(f.name) for f in left.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    # the same for a row however often its task runs
    spread = F.when(F.col(hot_key).isNull() & F.col(key).isNotNull(), F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(65536)).cast("int"))
    wide = left.join(F.broadcast(top), F.col(key) == F.col(hot_key), "left").withColumn(salt, spread)
    rest = right.select(F.col(key), F.lit(0).alias(salt), *payload)
    both = wide.join(rest, [key, salt], "left")
    return both.select(*left.columns, *(F.coalesce(F.col(c), F.col(h)).alias(c) for c, h in zip(payload, hot, strict=True)))


def first_runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins in a sorted array."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over edges (a, b); for edges that fit one task."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, jump := new[new]):
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) over an undirected edge table (a, b): alternating large-star and small-star rounds until nothing changes.

    Each round moves every edge toward the smallest node seen; rounds grow with the logarithm of a component's size. Hubs are
    joined by join_skewed. Nothing but a row count and a checksum of the edges comes to the driver.
    """

    def stars(adjacent: DataFrame) -> DataFrame:
        lows = adjacent.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("degree"))
        return join_skewed(adjacent, lows, "a", "degree", ["low"]).withColumn("low", F.least("low", "a"))

    now, seen = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stars(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        small = stars(large)
        now = cut(small.select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark


def first_of_each(rows: DataFrame) -> DataFrame:
    """own_row of one row of each component (column root): that of the smallest own_id, null ids last, then of the smallest own_row."""
    order = F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "own_row")
    return rows.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.own_row").alias("own_row"))


def unsigned(column: Column) -> Column:
    """A 64-bit value as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))

"""What the operators share: reading tables, shared folders, cutting lineage and joins that keep their size in bounds."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[2])
#: Measured bytes of a table that is sent to every executor at most; beyond it the same join shuffles.
BROADCAST_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers started by this session import the package."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a local one
    and a cluster an error. This session's part of it, with scratch tables and checkpoints, goes when the process ends."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="freshet-")
            atexit.register(lambda: os.path.isdir(folder) and not os.listdir(folder) and os.rmdir(folder))
        sc.setCheckpointDir(folder)
    if sc.getCheckpointDir() not in _to_delete:
        _to_delete.append(sc.getCheckpointDir())
    return sc.getCheckpointDir()


_to_delete: list[str] = []


def _delete(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


@atexit.register
def _delete_all() -> None:
    for path in _to_delete:
        try:
            _delete(path)
        except Exception:  # the JVM may have ended first; the folder's owner then has to empty it
            return


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def arrow_path(path: str) -> str:
    """The path as pyarrow's file systems write it; they know s3, and not Hadoop's names for it."""
    for name in ("s3a://", "s3n://"):
        if path.startswith(name):
            return "s3://" + path[len(name) :]
    return path


def settled(df: DataFrame) -> DataFrame:
    """The same rows read back from a reliable checkpoint, so later jobs neither recompute nor depend on lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled_alone(df: DataFrame) -> DataFrame:
    """``settled``, and the exchanges that made the rows are deleted at once, without waiting for the garbage collection;
    those under a broadcast wait for it.
    No other query may use this very ``df``; tables made from it, or that it was made from, have exchanges of their own."""
    found = settled(df)
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    left = [df._jdf.queryExecution().toRdd()] if cleaner.isDefined() else []
    while left:
        dependencies = left.pop().dependencies()
        for dependency in (dependencies.apply(i) for i in range(dependencies.size())):
            if dependency.getClass().getSimpleName() == "ShuffleDependency":
                cleaner.get().doCleanupShuffle(dependency.shuffleId(), True)
            left.append(dependency.rdd())
    return found


def released(*tables: DataFrame) -> None:
    """Deletes the files of ``settled`` tables of which everything that was made from them is settled itself."""
    for df in tables:
        path = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if path.isDefined():
            discard(df.sparkSession, path.get())


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs that nothing refers to any more; else they stay until the
    driver happens to collect its garbage. One round right after Python has given its tables up finds them still in use,
    so there is a second one a moment later."""
    gc.collect()
    for pause in (0.3, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand at most so many rows at once to Python, which bounds the memory that texts take there."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.greatest(F.size(value), F.lit(0)).cast("long") * _width(kind.elementType) + 16, F.lit(8).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda total, x: total + _bytes(x, kind.elementType)), F.lit(8).cast("long"))
    if isinstance(kind, T.StructType):
        total = F.lit(8).cast("long")
        for f in kind.fields:
            total = total + _bytes(value.getField(f.name), f.dataType)
        return total
    return F.lit(8).cast("long")


def _width(kind: T.DataType) -> int:
    """Bytes of an element in an array of plain values."""
    return 4 if isinstance(kind, (T.IntegerType, T.FloatType, T.DateType)) else 8


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all rows: 8 for a plain value, and what strings and arrays hold."""
    total = F.lit(8).cast("long")
    for f in df.schema.fields:
        total = total + _bytes(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def sent_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` (checkpointed), marked for broadcast where its measured bytes are within ``most`` (``BROADCAST_BYTES``)."""
    return F.broadcast(df) if measured_bytes(df) <= (BROADCAST_BYTES if most is None else most) else df


def joined_by(df: DataFrame, mapping: DataFrame, key: str, how: str = "left") -> DataFrame:
    """``df`` (checkpointed) joined with ``mapping``, which has at most one row of each ``key``.

    A key with more rows of ``df`` than a quarter of an even share of a partition's is hot. There are at most four times
    as many hot keys as partitions, so their part of ``mapping`` is sent to every executor and their rows stay where they are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    if (most or 0) <= max((total or 0) / (4 * parts), 8):
        return df.join(mapping, key, how)
    hot = counts.filter(F.col("count") > max(total / (4 * parts), 8)).select(key)
    hot = settled(hot)
    known = F.broadcast(mapping.join(F.broadcast(hot), key, "left_semi"))
    there = df.join(F.broadcast(hot), key, "left_semi").join(known, key, how)
    return there.unionByName(df.join(F.broadcast(hot), key, "left_anti").join(mapping, key, how))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """The rows over all shuffle partitions, for few rows that the next step turns into many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)

"""Cutting lineage in iterative jobs.

Everything is cut with a reliable ``checkpoint()``: the data lands in the shared folder, so a lost
executor costs a re-read and never a recomputation of earlier rounds.

What a finished step leaves on disk goes as soon as it can: Spark drops shuffles, broadcasts and checkpoints that
its driver no longer knows of, but only learns that from a collection of garbage, so every step asks for one. Tables
that a ``passing`` block stores for itself are deleted at its end.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_passing: list[list[str]] = []  # paths stored in the open blocks


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; a private one only when running in local mode."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised with its partition layout, and without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    # The plan that ran belongs to this step alone, so its shuffles end with it.
    done = df.select("*").checkpoint(eager=True)
    _release(df.sparkSession)
    return done


def _release(spark: SparkSession, at_once: bool = False) -> None:
    """Asks for a collection. Spark lets go of a job a moment after its end, so only a second one gets the last step's files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if at_once:
        time.sleep(0.1)
        spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end; what leaves the block must be ``stored(.., keep=True)``."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` materialised as compressed columns below the checkpoint folder, without its lineage and layout.

    For wide or long tables: a checkpoint holds whole rows as they are in memory. ``keep`` lets it outlive a ``passing`` block.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    if _passing and not keep:
        _passing[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    _release(spark, at_once=True)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, a stored or plain table, dealt by ``keys`` into parts of about ``rows`` rows.

    The session's shuffle partitions do where that many are enough; a larger table gets more, so that no task's
    share grows with it.
    """
    parts = -(-df.count() // rows)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*keys)
    return df.repartition(parts, *keys)

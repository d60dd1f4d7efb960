"""Session-level helpers: scratch tables in the shared folder, partition spreading, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.util import inheritable_thread_target

#: A side is broadcast only if it has been counted and its rows, at their schema's width, fit into this.
BROADCAST_BYTES = 8 << 20

_limit = threading.RLock()
_written: list[tuple[object, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only a local session may do without either (tests); on a cluster a machine's own folder is refused.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    own = spark.conf.get("calorgrid.shared.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="calorgrid-")
        spark.conf.set("calorgrid.shared.dir", own)
    return own.rstrip("/")


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.

    The table is removed by :func:`drop_scratch` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    back._scratch = (files, where)
    _written.append(back._scratch)
    return back


@contextmanager
def small_methods(spark: SparkSession):
    """Plans run inside generate no method that the JVM leaves uncompiled for its length (8,000 bytes); for very long expressions.

    The session's own setting holds again afterwards.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    with _limit:
        before = spark.conf.get(name)
        spark.conf.set(name, "8000")
        try:
            yield
        finally:
            spark.conf.set(name, before)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for frame in frames:
        held = getattr(frame, "_scratch", None)
        if held in _written:
            _written.remove(held)
            held[0].delete(held[1], True)


@atexit.register
def _clean() -> None:
    for files, where in _written:
        try:
            files.delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def row_bytes(df: DataFrame) -> int:
    """Width of a row by its schema: 8 bytes a field, 48 for texts, 256 for nested values."""
    width = {"string": 48, "binary": 48, "struct": 256, "array": 256, "map": 256}
    return 16 + sum(width.get(f.dataType.typeName(), 8) for f in df.schema.fields)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` prove the side small; otherwise leave the join to AQE."""
    return F.broadcast(df) if rows * row_bytes(df) <= BROADCAST_BYTES else df


def spread(df: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """Repartition by ``keys`` when a scan has too few partitions to keep all cores busy with costly per-row work; at scale it does nothing."""
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, *keys)


def side_by_side(spark: SparkSession, *builds):
    """Results of independent builders whose jobs may run at the same time."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [job.result() for job in [pool.submit(inheritable_thread_target(spark)(build)) for build in builds]]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have yet (names compare without case)."""
    taken, name, k = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

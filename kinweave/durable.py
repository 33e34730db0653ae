"""Tables that outlive executors: lineage is cut by writing to the shared folder of the cluster.

The folder is the session's ``spark.checkpoint.dir``, else the checkpoint folder of its context. Where neither is set a
local master (tests, laptops) gets a temporary folder of this process, and a cluster an error: its executors share no
temporary folder. Tables are removed at exit or by :func:`release`.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_local: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = at.get() if at.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.TemporaryDirectory(prefix="kinweave-"))
    return f"file://{_local[0].name}"


def durable(df: DataFrame, name: str = "t", partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    Unlike a cached or locally checkpointed DataFrame the result survives the loss of any executor,
    and unlike ``checkpoint`` it is columnar, so later readers still prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinweave/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._kinweave_path = path
    return out


def gathered(tables: list[DataFrame]) -> DataFrame:
    """One scan of several durable tables of one schema."""
    spark = tables[0].sparkSession
    out = spark.read.schema(tables[0].schema).parquet(*[t._kinweave_path for t in tables])
    out._kinweave_parts = tables
    return out


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the action that wrote them ends, not when the driver happens to collect its garbage.

    A DataFrame that is run twice in here makes its shuffles again, so what is used again should be durable.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def release(*tables: DataFrame | None) -> None:
    """Delete durable tables that no plan reads any more."""
    for t in tables:
        release(*getattr(t, "_kinweave_parts", ()))
        path = getattr(t, "_kinweave_path", None)
        if path:
            _delete(t.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        _delete(spark, path)
    _written.clear()

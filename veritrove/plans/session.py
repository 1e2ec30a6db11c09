"""Session helpers: the shared folder, and cutting lineage with written tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests, benches and examples."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veritrove")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("VERITROVE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def workers_import(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where
    the session has it, else (tests, one machine) a temporary one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    set_already = spark.sparkContext.getCheckpointDir()
    if set_already:
        return set_already
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="veritrove-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone when the interpreter ends
            return


@contextmanager
def released() -> Iterator[None]:
    """Tables that written() makes inside go at the end: for work whose result has been collected or written elsewhere by then."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        for spark, path in [x for x in _written if x[1] in mine]:
            _remove(spark, path)
            _written.remove((spark, path))


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind; else those stay until the driver's JVM collects what refers to them."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet in the shared folder (with the writer's options, if any) and reads it back.

    Lineage ends there, so what follows neither recomputes df nor depends on
    the executors that made it; files of shuffles on the way go as soon as it is written. The tables go when the driver ends, or at the end of released()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veritrove/{name}-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

"""Session settings the library relies on, and the shared scratch area for written intermediates."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar, Token
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings every job here expects; sizes (memory, partitions, cores) stay with the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; for a local master without one, a temporary folder that goes when the process ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="vigilog-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())


class Scratch:
    """What is materialized while this is entered. It goes when this is closed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self._entered: list[Token] = []

    def __enter__(self) -> Scratch:
        self._entered.append(_scopes.set((*_scopes.get(), self)))
        return self

    def __exit__(self, *_: object) -> None:
        _scopes.reset(self._entered.pop())

    def is_read_by(self, df: DataFrame) -> bool:
        return any(os.path.basename(path) in file for file in df.inputFiles() for path in self.paths)

    def close(self) -> None:
        jvm = self.spark._jvm
        for path in self.paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths.clear()


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """A query that runs in here has its shuffle files removed when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def materialize(df: DataFrame, name: str, outlasts: Scratch | None = None) -> DataFrame:
    """Write once to the shared scratch folder and read back.

    Cuts the lineage at a point that survives the loss of executors, so that costly steps (model
    calls, similarity search) run once although several later actions read their rows. What was shuffled for it
    goes once it is written. The files last as long as the scope that is open (``outlasts``: the one around that); without one, they stay.
    """
    path = scratch_path(df.sparkSession, name)
    scopes = _scopes.get()
    if outlasts is not None:
        scopes = scopes[: scopes.index(outlasts)]
    if scopes:
        scopes[-1].paths.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For a function whose first argument is a frame: its result is written, and all other intermediates go."""

    def wrap(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(function)
        def run(df: DataFrame, *args: object, **options: object) -> DataFrame:
            scope = Scratch(df.sparkSession)
            try:
                with scope:
                    return materialize(function(df, *args, **options), name, outlasts=scope)
            finally:
                scope.close()

        return run

    return wrap


def spread(stored: DataFrame, key: str) -> DataFrame:
    """A stored table in fewer splits than there are cores, spread by key before costly work per row.

    Larger tables stay as they are: nothing is shuffled.
    """
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored if stored.rdd.getNumPartitions() > cores else stored.repartition(cores, key)


def ship_code(*packages: ModuleType) -> None:
    """Send functions of these packages to the Python workers by value.

    Workers then need no copy of the packages; a cluster that has them installed can do without.
    """
    for package in packages:
        cloudpickle.register_pickle_by_value(package)

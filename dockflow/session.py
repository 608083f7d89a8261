"""Session set-up, shared scratch folders and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "dockflow", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings this library is written for.

    Adaptive execution re-plans joins and splits skewed shuffle partitions from measured sizes; UTC keeps the
    few zone-aware steps (offset timestamps) independent of the machine.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


#: Scratch folder of each application, made on first use and deleted at its end.
_FOLDERS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where that is unset and the master is local, as in a trial on one machine, a temporary folder serves: driver and
    executors are one process there. Anywhere else it is an error. The folder goes when Python ends, or with ``clean_up``.
    """
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not configured:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="dockflow-")
        _FOLDERS[context.applicationId] = f"{configured.rstrip('/')}/dockflow-{context.applicationId}"
        atexit.register(clean_up, spark)
    return _FOLDERS[context.applicationId]


def clean_up(spark: SparkSession) -> None:
    """Delete what this application has written to its scratch folder; its results can't be read any more."""
    try:
        folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
        if folder is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended already: nothing can be reached
        pass


#: Paths of the passing tables of the innermost ``passing`` that runs.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What ``settle`` writes inside is deleted at the end, unless it ``stays``: no table that is used later may read it."""
    paths: list[str] = []
    token = _PASSING.set(paths)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for written in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below this application's folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, stays: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; inside of ``passing`` it goes with that, unless it ``stays``.

    For tables that several later branches read: they are computed once, and a lost executor costs a re-read of
    files instead of a replay of the whole plan.
    """
    path = scratch_path(df.sparkSession, "settled")
    if not stays and _PASSING.get() is not None:
        _PASSING.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` by ``keys`` over all shuffle partitions.

    For small tables with costly groups: adaptive execution would merge their partitions by size into a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

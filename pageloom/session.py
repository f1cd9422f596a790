"""Sessions and table access shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # shuffle files go when their query has ended


def local_session(app: str = "pageloom", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for a single machine; on a cluster the submitter's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAGELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Catalyst pushes filters and columns into this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own machine and process."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: the one the session names in spark.checkpoint.dir.

    Only on a local master (tests, a laptop) a temporary folder is made where that setting is absent.
    On a cluster it would lie on one machine only, so there its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pageloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir("file://" + folder)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: the lineage ends there.

    The files outlive any executor, so a lost executor costs only the tasks it was running. They are
    deleted when the driver's process ends, or before that by ``release`` and, if not ``lasting``, at
    the end of ``scratch``. The write's shuffle files go at once, nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pageloom-{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    written = _written(spark)
    written.append(path)
    if lasting:
        spark.sparkContext._pageloom_lasting.add(path)
    return spark.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, other than lasting ones, are deleted at the end."""
    before = set(_written(spark))
    yield
    lasting = spark.sparkContext._pageloom_lasting
    release(spark, [p for p in _written(spark) if p not in before and p not in lasting])


def _written(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_pageloom_written"):
        context._pageloom_written, context._pageloom_lasting = [], set()
        stop = context.stop

        def clean_and_stop() -> None:
            release(spark)
            stop()

        context.stop = clean_and_stop
    return context._pageloom_written


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete the tables written so far, or some of them; results that still read them must be done."""
    context = spark.sparkContext
    written = getattr(context, "_pageloom_written", [])
    paths = list(written) if paths is None else paths
    for path in paths:
        written.remove(path)
    for path in paths:
        try:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - what can't be deleted now is the folder's owner's to clear
            continue


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started; once for each context.

    The archive lies in the shared folder where that is a mounted one; Spark copies it to every worker.
    """
    context = spark.sparkContext
    if getattr(context, "_pageloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shared = shared_dir(spark)
    folder = f"/{shared.removeprefix('file:').lstrip('/')}/pageloom-code-{uuid.uuid4().hex}" if shared.startswith("file:") else tempfile.mkdtemp(prefix="pageloom-code-")
    package = os.path.join(folder, "pageloom")
    shutil.copytree(os.path.join(root, "pageloom"), os.path.join(folder, "src", "pageloom"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(package, "zip", os.path.join(folder, "src")))
    context._pageloom_shipped = True

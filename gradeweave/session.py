"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_RUN: ContextVar[str] = ContextVar("gradeweave_run", default="shared")


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", scratch: str | None = None
) -> SparkSession:
    """Session for tests and the local bench. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gradeweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(CHECKPOINT_SETTING, scratch or _own_folder("session"))
        .getOrCreate()
    )


@cache
def _own_folder(_: str) -> str:
    """A folder of this process, removed at its end."""
    folder = tempfile.mkdtemp(prefix="gradeweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the session names none, only local mode has another choice: driver
    and tasks are one process there and share a folder of its own. The setting
    itself cannot be changed in a running session.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
    return _own_folder(spark.sparkContext.applicationId)


def _run_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/gradeweave/{spark.sparkContext.applicationId}/{_RUN.get()}"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """What is materialized within goes to one folder, which is given; see ``discard``."""
    token = _RUN.set(uuid.uuid4().hex)
    try:
        yield _run_folder(spark)
    finally:
        _RUN.reset(token)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder, once nothing that was read from it is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The JVM never compiles a longer method (in bytes of code). Spark then runs the operators of a stage one by one instead.
METHOD_BYTES = 8_000
METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"


def bound_methods(spark: SparkSession) -> None:
    """Where the session leaves Spark's default, keep generated code to what the JVM compiles. A sheet's many cells are
    cleaned and parsed by one method otherwise, which is then interpreted for every row."""
    if spark.conf.get(METHOD_SETTING, "65535") == "65535":
        spark.conf.set(METHOD_SETTING, METHOD_BYTES)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """Name of a new folder for tables written part by part."""
    return f"{_run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where a result feeds several consumers or the next round of a loop:
    it cuts the lineage, survives lost executors, and gives the planner true
    sizes, so that small sides are broadcast and large ones are not.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, label: str, column: str) -> DataFrame:
    """As ``materialize``, in one folder for each value of a text column, so that a filter on it reads only its own."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.partitionBy(column).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

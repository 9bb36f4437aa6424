"""Helpers that several of the corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts of the operators define it.
WHITE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WHITE}+"), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, close to ``name``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch where the session leaves Spark's default of 10,000, which is much memory for whole texts.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Make a session ready for the Python operators; once per application.

    Sends this package's modules to the Python workers, as ``--py-files`` does, and bounds Arrow batches.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    if getattr(context, "_gradeweave_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="gradeweave-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark keeps the copy that it serves
    archive = Path(folder) / "gradeweave.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for module in sorted(package.rglob("*.py")):
            z.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gradeweave_sent = True

"""Where results go."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refuse_overlap(output: str, *inputs: str) -> None:
    """Output is replaced, so it must neither hold an input nor lie within one."""

    def parts(path: str) -> list[str]:
        return [p for p in path.split("://")[-1].removeprefix("file:").split("/") if p]

    out = parts(output)
    for path in inputs:
        source = parts(path)
        shared = min(len(out), len(source))
        if out[:shared] == source[:shared]:
            raise ValueError(f"Output {output} overlaps input {path}")


def folders_of(df: DataFrame) -> list[str]:
    """The folders of the files that a table or view is read from."""
    return sorted({unquote(f).rpartition("/")[0] for f in df.inputFiles()})


#: Folders beside the tables of an output: what is written, and what it takes the place of, until all is in place.
STAGED, EARLIER = ".staged-", ".earlier-"


class _Folders:
    """Folders of a file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str = "") -> list[str]:
        at = self.path(f"{self.root}/{folder}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def move(self, source: str, target: str) -> None:
        to = self.path(f"{self.root}/{target}")
        self.fs.mkdirs(to.getParent())
        if not self.fs.rename(self.path(f"{self.root}/{source}"), to):
            raise OSError(f"{self.root}/{source} cannot be moved to {target}")

    def remove(self, folder: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{folder}"), True)


def recover(spark: SparkSession, output: str) -> None:
    """Put back the tables of a switch that was cut off, and remove what was staged."""
    at = _Folders(spark, output)
    for folder in at.names():
        if folder.startswith(EARLIER):
            for table in at.names(folder):
                at.remove(table)
                at.move(f"{folder}/{table}", table)
        if folder.startswith((EARLIER, STAGED)):
            at.remove(folder)


@contextmanager
def replaced_together(spark: SparkSession, output: str) -> Iterator[str]:
    """A folder to write tables to; at the end they take the place of those of the same name under ``output``.

    Nothing is replaced before all tables are written. The switch moves folders only; a failure in it undoes what was
    moved, and one that leaves no time for that is undone by the next writer. Tables that are not written stay.
    """
    recover(spark, output)
    at, run = _Folders(spark, output), uuid.uuid4().hex
    staged, earlier = STAGED + run, EARLIER + run
    try:
        yield f"{at.root}/{staged}"
        there, tables = at.names(), at.names(staged)
        for table in tables:
            if table in there:
                at.move(table, f"{earlier}/{table}")
        for table in tables:
            at.move(f"{staged}/{table}", table)
    except BaseException:
        recover(spark, output)
        raise
    at.remove(staged)
    at.remove(earlier)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path``."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_by_student(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64) -> None:
    """Replace the table at ``path``, in folders by a hash of the student: a
    report is found in one folder, without a folder per student. Rows of a
    bucket meet before they are written, so a folder has few files; adaptive
    execution splits a bucket that is much larger than the others."""
    bucket = F.pmod(F.xxhash64("student_identifier"), F.lit(buckets))
    df.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").format(fmt).save(path)

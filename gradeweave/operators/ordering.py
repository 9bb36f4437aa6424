"""Positions of students, semesters and assessments in the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import first_seen
from gradeweave.session import materialize

CLOSING_ASSESSMENT = "Overall Success"  # fixed value: reported last


def global_position(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """Number all rows from 1 by ``order``, which must tell rows apart.

    Rows are range-partitioned and numbered within partitions; only the
    partition sizes meet in one place.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One offset per shuffle partition.
    return (
        stored.withColumn("_place", place)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_place") + F.col("_offset"))
        .drop("_part", "_place", "_offset")
    )


def students(cells: DataFrame) -> DataFrame:
    """Students with the last name, term key and position of their first average."""
    by = ("semester_sort", "first_ord")
    head = F.struct("last_name", *by)
    grouped = cells.groupBy("student_identifier").agg(first_seen(head, *by).alias("head"))
    return grouped.select("student_identifier", "head.last_name", "head.semester_sort", "head.first_ord")


def students_by_last_name(cells: DataFrame, collation: str | None = None) -> DataFrame:
    """Students with ``student_pos``: by last name, ties by first appearance.

    Names are compared by code point; ``collation`` (such as ``UNICODE``)
    orders them as people do.
    """
    listed = materialize(students(cells), "students")  # the range partitioning reads them twice
    if collation is None:
        return global_position(listed, ["last_name", "semester_sort", "first_ord"], "student_pos")
    name = F.collate(F.col("last_name"), collation)
    return global_position(listed, [name, F.col("semester_sort"), F.col("first_ord")], "student_pos")


def student_semesters(cells: DataFrame) -> DataFrame:
    """Each student's semesters with ``semester_pos``: by term key, ties by
    first appearance."""
    listed = cells.groupBy("student_identifier", "semester", "semester_sort").agg(
        F.min("first_ord").alias("first_ord")
    )
    within = Window.partitionBy("student_identifier").orderBy("semester_sort", "first_ord")
    return listed.withColumn("semester_pos", F.row_number().over(within)).drop("first_ord")


def student_assessments(cells: DataFrame) -> DataFrame:
    """Each student's assessments with ``score_pos``: by first appearance, the
    closing one last."""
    listed = cells.groupBy("student_identifier", "score_name").agg(
        F.min(F.struct("semester_sort", "first_ord")).alias("first")
    )
    closing = F.when(F.col("score_name") == CLOSING_ASSESSMENT, 1).otherwise(0)
    within = Window.partitionBy("student_identifier").orderBy(closing, "first")
    return listed.withColumn("score_pos", F.row_number().over(within)).drop("first")

"""Student averages, cohort averages, and the choice of students."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import first_seen, per_key
from gradeweave.functions.numbers import format_mean, mean
from gradeweave.schema import AVERAGE_KEYS, COHORT_KEYS

NOT_AVAILABLE = "N/A"


def in_semester(semester: str) -> Column:
    return F.col("semester") == semester


def current_students(scores: DataFrame, semester: str | None) -> DataFrame:
    """All semesters of every student with a score in ``semester``; everything
    when no semester is given."""
    if semester is None or not semester.strip():
        return scores
    present = per_key(scores.where(in_semester(semester)), ["student_identifier"], F.count(F.lit(1)))
    return scores.join(present, "student_identifier", "left_semi")


def student_score_averages(cells: DataFrame) -> DataFrame:
    """Mean per student, semester and assessment, with the last name, standing
    and emphasis of the first score."""
    head = F.struct("last_name", "class_standing", "emphasis")
    grouped = cells.groupBy(*AVERAGE_KEYS).agg(
        F.sum("score_sum").alias("score_sum"),
        F.sum("score_count").alias("score_count"),
        F.min("first_ord").alias("first_ord"),
        first_seen(head, "first_ord").alias("head"),
    )
    return grouped.select(
        "student_identifier", F.col("head.last_name").alias("last_name"),
        "semester", "semester_sort", "score_name",
        F.col("head.class_standing").alias("class_standing"), F.col("head.emphasis").alias("emphasis"),
        "score_sum", "score_count",
        mean(F.col("score_sum"), F.col("score_count")).alias("average"),
        "first_ord",
    )


def cohort_average(cells: DataFrame) -> DataFrame:
    """Mean over everyone with the same term key, standing, emphasis and
    assessment. Missing attributes form cohorts of their own."""
    grouped = cells.groupBy(*COHORT_KEYS).agg(
        F.sum("score_sum").alias("score_sum"), F.sum("score_count").alias("score_count")
    )
    return grouped.withColumn("average", mean(F.col("score_sum"), F.col("score_count")))


def report_cells(averages: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Each student average beside that of the cohort, as text.

    Cohorts are few next to students, so the join is a broadcast whenever their
    measured size allows; a large cohort table meets the averages by hash, and
    a cohort that holds most of the students is split as a skewed key.
    """
    same = None
    for c in COHORT_KEYS:
        match = F.col(f"a.{c}").eqNullSafe(F.col(f"g.{c}"))
        same = match if same is None else same & match
    joined = averages.alias("a").join(cohorts.alias("g"), same, "left")
    return joined.select(
        "a.student_identifier", "a.last_name", "a.score_name", "a.semester", "a.semester_sort",
        format_mean(F.col("a.score_sum"), F.col("a.score_count")).alias("yours"),
        F.coalesce(format_mean(F.col("g.score_sum"), F.col("g.score_count")), F.lit(NOT_AVAILABLE)).alias("average"),
        "a.first_ord",
    )

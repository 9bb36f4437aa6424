"""Report tables: the grid, its pivot, and one document per student.

Everything here works on averages, so a student's report is bounded by the
assessments and semesters of the sheet, however many scores went into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.averages import NOT_AVAILABLE
from gradeweave.operators.ordering import CLOSING_ASSESSMENT, student_assessments, student_semesters

# The texts of a report.
TITLE = "Assessment Scores For "
NOTE = '"Average" is the average score for all students with the same Emphasis and Class Standing in a semester.'
ROW_LABELS = ("Yours:", "Average:")


def positioned_cells(cells: DataFrame, positions: DataFrame) -> DataFrame:
    """Report cells with the positions of their student, assessment and semester."""
    rows = student_assessments(cells).alias("r")
    # Assessments without a heading have a null name and still are one row.
    same = (F.col("k.student_identifier") == F.col("r.student_identifier")) & F.col("k.score_name").eqNullSafe(F.col("r.score_name"))
    return (
        cells.alias("k").join(rows, same).select("k.*", "r.score_pos")
        .join(positions.select("student_identifier", "student_pos"), "student_identifier")
        .join(student_semesters(cells).drop("semester_sort"), ["student_identifier", "semester"])
        .select(
            "student_identifier", "score_name", "semester", "yours", "average",
            "student_pos", "score_pos", "semester_pos",
        )
    )


def report_grid(cells: DataFrame) -> DataFrame:
    """The full table of each report: a student's assessments by the student's
    semesters, ``N/A`` where there is no score."""
    rows = student_assessments(cells)
    columns = student_semesters(cells).drop("semester_sort")
    frame = rows.join(columns, "student_identifier")
    known = cells.select("student_identifier", "score_name", "semester", "yours", "average")
    # Assessments without a heading have a null name and still are one row.
    same = (
        (F.col("f.student_identifier") == F.col("k.student_identifier"))
        & F.col("f.score_name").eqNullSafe(F.col("k.score_name"))
        & (F.col("f.semester") == F.col("k.semester"))
    )
    return (
        frame.alias("f").join(known.alias("k"), same, "left")
        .select(
            "f.student_identifier", "f.score_name", "f.semester", "f.score_pos", "f.semester_pos",
            F.coalesce("k.yours", F.lit(NOT_AVAILABLE)).alias("yours"), "k.average",
        )
    )


def cell_text() -> Column:
    """The lines of a cell: own and cohort average, or one ``N/A``."""
    return F.array_compact(F.array("yours", "average"))


def report_pivot(cells: DataFrame, semesters: list[str] | None = None) -> DataFrame:
    """Assessments down, semesters across: own average by student.

    The columns are ``semesters``, and any other semester is an error; or all
    that occur, of which Spark refuses more than ``spark.sql.pivotMaxValues``.
    """
    if semesters:
        semester = F.col("semester")
        unlisted = F.raise_error(F.concat(F.lit("Semester not listed: "), semester))
        cells = cells.withColumn("semester", F.when(semester.isin(semesters), semester).otherwise(unlisted))
    grouped = cells.groupBy("student_identifier", "score_name")
    pivoted = grouped.pivot("semester", semesters) if semesters else grouped.pivot("semester")
    wide = pivoted.agg(F.first("yours"))
    known = [c for c in wide.columns if c not in ("student_identifier", "score_name")]
    return wide.fillna(NOT_AVAILABLE, known)


def report_pivot_map(cells: DataFrame) -> DataFrame:
    """``report_pivot`` without a column for each semester, for any number of them: assessments down, and a map from
    semester to own average, the student's semesters in order."""
    entry = F.struct("semester_sort", "first_ord", "semester", "yours")
    listed = cells.groupBy("student_identifier", "score_name").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    pair = lambda e: F.struct(e["semester"], e["yours"])
    return listed.select("student_identifier", "score_name", F.map_from_entries(F.transform("entries", pair)).alias("semesters"))


def student_report(grid: DataFrame, positions: DataFrame) -> DataFrame:
    """One document per student: title, note, semesters, and the rows in order."""
    lines = grid.groupBy("student_identifier", "score_pos", "score_name").agg(
        F.array_sort(F.collect_list(F.struct("semester_pos", "semester", cell_text().alias("text")))).alias("cells")
    )
    line = F.struct(
        "score_pos",
        F.coalesce("score_name", F.lit("")).alias("assessment"),
        F.coalesce(F.col("score_name") == CLOSING_ASSESSMENT, F.lit(False)).alias("emphasised"),
        "cells",
    )
    documents = lines.groupBy("student_identifier").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    semesters = F.transform(F.col("lines")[0]["cells"], lambda c: c["semester"])
    rows = F.transform(
        "lines",
        lambda r: F.struct(
            r["assessment"].alias("assessment"),
            r["emphasised"].alias("emphasised"),
            F.transform(r["cells"], lambda c: c["text"]).alias("cells"),
        ),
    )
    labels = F.array(*[F.lit(x) for x in ROW_LABELS])
    return documents.join(positions.select("student_identifier", "student_pos"), "student_identifier").select(
        "student_identifier", "student_pos",
        F.concat(F.lit(TITLE), F.col("student_identifier")).alias("title"),
        F.lit(NOTE).alias("note"),
        semesters.alias("semesters"), labels.alias("row_labels"), rows.alias("rows"),
    )

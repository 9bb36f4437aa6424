"""The score record and the column groups the operators share.

Spark rows have no position, so ``ord`` carries the order of the sheet
(row, then column). It must be unique; every "first seen" rule is a minimum
over it.
"""

from __future__ import annotations

from pyspark.sql import types as T

COLUMNS_PER_ROW = 10000  # ord = row_no * columns_per_row(width) + col_no
SCORE_PRECISION, SCORE_SCALE = 28, 8


def columns_per_row(width: int) -> int:
    """Distance between the positions of two rows: more than any column number."""
    return max(COLUMNS_PER_ROW, 10 ** len(str(width)))


SCORE_SCHEMA = T.StructType(
    [
        T.StructField("ord", T.LongType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("student_identifier", T.StringType()),
        T.StructField("semester", T.StringType()),
        T.StructField("semester_sort", T.StringType()),
        T.StructField("class_standing", T.StringType()),
        T.StructField("emphasis", T.StringType()),
        T.StructField("score_name", T.StringType()),
        T.StructField("score", T.DecimalType(SCORE_PRECISION, SCORE_SCALE)),
    ]
)

SCORE_COLUMNS = SCORE_SCHEMA.names
IDENTITY = ["student_identifier", "first_name", "last_name"]
PROFILE = IDENTITY + ["semester", "class_standing", "emphasis"]
AVERAGE_KEYS = ["student_identifier", "semester", "semester_sort", "score_name"]
COHORT_KEYS = ["semester_sort", "class_standing", "emphasis", "score_name"]

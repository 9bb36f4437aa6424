"""Students with more than one standing or emphasis in a semester."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import commonest
from gradeweave.functions.text import fold

TERM = ["student_identifier", "semester"]
STANDING, EMPHASIS = "class_standing", "emphasis"


def attribute_conflicts(profiles: DataFrame, attributes: list[str]) -> DataFrame:
    """Terms of a student with several values of an attribute, and the
    commonest: student_identifier, semester, attribute, n_values, value.

    Values that differ only in case are one value for finding a conflict, but
    not for choosing; a missing value counts in both.
    """
    listed = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])
    values = profiles.select(*TERM, "n", "first_ord", F.inline(listed))
    keys = [*TERM, "attribute"]
    spelled = values.groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))
    folded = F.struct(fold(F.col("value")))  # a struct is counted even when its field is missing
    found = spelled.groupBy(*keys).agg(
        F.count_distinct(folded).alias("n_values"), commonest("value", "n", "first_ord").alias("value")
    )
    return found.where("n_values > 1")


def _of(profiles: DataFrame, attribute: str) -> DataFrame:
    return attribute_conflicts(profiles, [attribute]).select(*TERM, "n_values", F.col("value").alias(attribute))


def multiple_standings(profiles: DataFrame) -> DataFrame:
    return _of(profiles, STANDING)


def multiple_emphases(profiles: DataFrame) -> DataFrame:
    return _of(profiles, EMPHASIS)

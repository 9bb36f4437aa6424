"""What the repairs report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.text import semester_sort_key, text_or_empty

# The message texts, by kind.
TEXTS = {
    "flipped": "Student {winner} has potential flipped first and last name {found} in semester {semester}",
    "dash": "Student {winner} has potential missing dash {found} in semester {semester}",
    "misspelled": "Student {winner} has potential misspelled name {found} in semester {semester}; using {winner}",
    "standing": "Student {winner} has multiple class standings for semester {semester}; picking {found}",
    "emphasis": "Student {winner} has multiple emphases for semester {semester}; picking {found}",
}


def _fill(text: str, **values: Column) -> Column:
    parts = []
    for i, piece in enumerate(text.replace("{", "}").split("}")):
        parts.append(text_or_empty(values[piece]) if i % 2 else F.lit(piece))
    return F.concat(*parts)


def message_rows(findings: DataFrame, kind: str, winner: str | Column, found: str | Column) -> DataFrame:
    """Messages for rows with a ``semester`` column."""
    winner = F.col(winner) if isinstance(winner, str) else winner
    found = F.col(found) if isinstance(found, str) else found
    semester = F.col("semester")
    return findings.select(
        F.lit(kind).alias("kind"),
        winner.alias("student_identifier"),
        semester,
        F.concat(text_or_empty(semester), F.lit("_"), text_or_empty(winner)).alias("sort_value"),
        _fill(TEXTS[kind], winner=winner, found=found, semester=semester).alias("message"),
    )


def union_messages(parts: list[DataFrame]) -> DataFrame:
    """All messages once, with the key they are presented by."""
    together = reduce(DataFrame.unionByName, parts)
    once = together.groupBy("sort_value", "message").agg(
        *[F.min(c).alias(c) for c in ("kind", "student_identifier", "semester")]
    )
    return once.select(
        "kind", "student_identifier", "semester", "sort_value",
        semester_sort_key(F.col("sort_value")).alias("sort_key"), "message",
    )


def in_order(messages: DataFrame) -> DataFrame:
    """For presentation."""
    return messages.orderBy("sort_key", "message")

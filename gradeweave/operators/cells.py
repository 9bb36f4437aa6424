"""Pre-aggregation that all later steps share.

Scores are folded, map side first, to one row per identity, term, attributes
and assessment. However many rows one student, term or cohort holds, it enters
every later shuffle as its few distinct combinations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeweave.schema import IDENTITY, PROFILE

CELL_KEYS = PROFILE + ["semester_sort", "score_name"]


def score_cells(scores: DataFrame) -> DataFrame:
    return scores.groupBy(*CELL_KEYS).agg(
        F.sum("score").alias("score_sum"),
        F.count("score").alias("score_count"),
        F.min("ord").alias("first_ord"),
    )


def as_cells(scores: DataFrame) -> DataFrame:
    """Each score as a cell of its own, for a single fold that needs no cells
    between. The type is that of a folded sum, so results are alike."""
    kind = scores.schema["score"].dataType
    total = T.DecimalType(min(kind.precision + 10, 38), kind.scale)
    return scores.select(
        *CELL_KEYS,
        F.col("score").cast(total).alias("score_sum"), F.lit(1).cast("bigint").alias("score_count"),
        F.col("ord").alias("first_ord"),
    )


def merge_cells(cells: DataFrame) -> DataFrame:
    """Fold cells again after their attributes were repaired."""
    return cells.groupBy(*CELL_KEYS).agg(
        F.sum("score_sum").alias("score_sum"),
        F.sum("score_count").alias("score_count"),
        F.min("first_ord").alias("first_ord"),
    )


def profile(cells: DataFrame) -> DataFrame:
    """Score counts by identity, semester, standing and emphasis."""
    return cells.groupBy(*PROFILE).agg(
        F.sum("score_count").alias("n"), F.min("first_ord").alias("first_ord")
    )


def identities(profiles: DataFrame) -> DataFrame:
    """Score counts by identifier and name pair."""
    return profiles.groupBy(*IDENTITY).agg(F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"))

"""Order-aware aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(value: str | Column, *order: str) -> Column:
    """Value of the row that comes first by ``order``."""
    by = order[0] if len(order) == 1 else F.struct(*order)
    return F.min_by(value, by)


def per_key(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row per key, for joining back to rows of which one key may hold most.

    Grouping by the keys as one struct leaves a shuffle of its own between this
    result and the join. Only then can the adaptive skew join split a hot key of
    the other side; grouped by the join keys themselves, it could not.
    """
    grouped = df.groupBy(F.struct(*keys).alias("_key")).agg(*aggregates)
    values = [c for c in grouped.columns if c != "_key"]
    return grouped.select(*[F.col("_key")[k].alias(k) for k in keys], *values)


def commonest(value: str, count: str, order: str) -> Column:
    """Value with the largest count, the first-seen of equals, over counted values."""
    return F.max_by(value, F.struct(F.col(count), -F.col(order)))


def mode_first_seen(
    df: DataFrame, keys: list[str], value: str, count: str = "n", order: str = "first_ord"
) -> DataFrame:
    """Commonest ``value`` per key; a tie goes to the value seen first.

    Null is a value like any other and may win. Counting comes before the
    choice, so a key that holds most of the rows reaches the second step as
    one row per distinct value.
    """
    counted = df.groupBy(*keys, value).agg(F.sum(count).alias("_n"), F.min(order).alias("_ord"))
    return counted.groupBy(*keys).agg(
        commonest(value, "_n", "_ord").alias(value),
        F.sum("_n").alias(count),
        F.min("_ord").alias(order),
    )

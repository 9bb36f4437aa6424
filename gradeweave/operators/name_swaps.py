"""Names entered the wrong way round, and dashes lost from first names.

Both rules compare counts of the same scores under two readings of the name;
the reading with strictly more scores wins, a tie changes nothing. Both are
found on the data as it came; where both apply, the dash repair prevails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import first_seen, per_key
from gradeweave.functions.text import full_name


def reversed_name() -> Column:
    return full_name(F.col("last_name"), F.col("first_name"))


def undashed_first_name() -> Column:
    return F.replace(F.col("first_name"), F.lit("-"), F.lit(" "))


def _students(identities: DataFrame) -> DataFrame:
    """Score count and first-seen names per identifier."""
    return identities.groupBy("student_identifier").agg(
        F.sum("n").alias("n_student"),
        first_seen(F.struct("first_name", "last_name"), "first_ord").alias("head"),
    )


def flipped_names(identities: DataFrame, repair_names: bool = False) -> DataFrame:
    """Identifiers that are the reversal of a rarer name.

    The repaired rows take the identifier, but their names are the student's
    names swapped, so they stay flipped; ``repair_names`` copies them straight.
    """
    rarer = identities.groupBy(reversed_name().alias("reversed_name")).agg(F.sum("n").alias("n_reversed"))
    students = _students(identities)
    given, family = ("first_name", "last_name") if repair_names else ("last_name", "first_name")
    return (
        students.join(rarer, students.student_identifier == rarer.reversed_name)
        .where("n_student > n_reversed")
        .select(
            "reversed_name", "student_identifier", "n_student", "n_reversed",
            F.col(f"head.{given}").alias("first_name"), F.col(f"head.{family}").alias("last_name"),
        )
    )


def lost_dashes(identities: DataFrame, match: str = "first_name") -> DataFrame:
    """Identifiers equal to a rarer first name whose dashes became spaces.

    ``match="identifier"`` compares whole identifiers with the dashes taken
    out instead; undashed identifiers then stay as they are.
    """
    source = identities
    if match == "first_name":
        key = undashed_first_name()
    elif match == "identifier":
        key = F.replace(F.col("student_identifier"), F.lit("-"), F.lit(" "))
        source = identities.where(F.contains(F.col("student_identifier"), F.lit("-")))
    else:
        raise ValueError(f"match: {match}")
    rarer = source.groupBy(key.alias("undashed")).agg(F.sum("n").alias("n_undashed"))
    students = _students(identities)
    return (
        students.join(rarer, students.student_identifier == rarer.undashed)
        .where("n_student > n_undashed")
        .select(
            "undashed", "student_identifier", "n_student", "n_undashed",
            F.col("head.first_name").alias("first_name"), F.col("head.last_name").alias("last_name"),
        )
    )


def _apply(identities: DataFrame, fixes: DataFrame, key: str, source: Column, tag: str) -> DataFrame:
    values = F.struct(
        F.col("student_identifier").alias("id"), F.col("first_name").alias("first"),
        F.col("last_name").alias("last"),
    )
    fix = per_key(fixes, [key], F.max(values).alias(tag))  # keys are unique already
    return identities.join(fix, source == F.col(key), "left").drop(key)


def swap_map(
    identities: DataFrame,
    flips: bool = True,
    dashes: bool = True,
    repair_names: bool = False,
    match: str = "first_name",
) -> DataFrame:
    """Each identity with its repaired identifier and names (``*_1``).

    ``flip_id`` and ``dash_id`` are set where a rule fired.
    """
    out = identities
    blank = F.lit(None).cast("struct<id:string,first:string,last:string>")
    if flips:
        out = _apply(out, flipped_names(identities, repair_names), "reversed_name", reversed_name(), "flip")
    else:
        out = out.withColumn("flip", blank)
    if dashes:
        dashed = undashed_first_name()
        if match == "identifier":
            dashed = F.when(
                F.contains(F.col("student_identifier"), F.lit("-")),
                F.replace(F.col("student_identifier"), F.lit("-"), F.lit(" ")),
            )
        out = _apply(out, lost_dashes(identities, match), "undashed", dashed, "dash")
    else:
        out = out.withColumn("dash", blank)

    def repaired(part: str, original: str) -> Column:
        return (
            F.when(F.col("dash").isNotNull(), F.col(f"dash.{part}"))
            .when(F.col("flip").isNotNull(), F.col(f"flip.{part}"))
            .otherwise(F.col(original))
        )

    return out.select(
        "student_identifier", "first_name", "last_name", "n", "first_ord",
        F.col("flip.id").alias("flip_id"), F.col("dash.id").alias("dash_id"),
        repaired("id", "student_identifier").alias("student_identifier_1"),
        repaired("first", "first_name").alias("first_name_1"),
        repaired("last", "last_name").alias("last_name_1"),
    )

"""All repairs in one pass.

Every rule looks only at identities, terms and attributes, so the rules run on
the folded cells. Their findings become one table of corrections, and the
scores meet it in a single join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.operators.cells import as_cells, identities, profile
from gradeweave.operators.clusters import canonical_names, clusters_and_blocks, misspelled_pairs
from gradeweave.operators.conflicts import EMPHASIS, STANDING, attribute_conflicts
from gradeweave.operators.messages import message_rows, union_messages
from gradeweave.operators.name_swaps import swap_map
from gradeweave.schema import IDENTITY
from gradeweave.session import materialize

TERM_IDENTITY = IDENTITY + ["semester"]


@dataclass(frozen=True)
class Rules:
    """Which repairs run, and the two that have a second reading."""

    flips: bool = True
    dashes: bool = True
    misspellings: bool = True
    standings: bool = True
    emphases: bool = True
    repair_names: bool = False
    dash_match: str = "first_name"


@dataclass(frozen=True)
class Validation:
    scores: DataFrame
    messages: DataFrame


def null_safe(left: str, right: str, columns: list[str]) -> Column:
    condition = None
    for c in columns:
        same = F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
        condition = same if condition is None else condition & same
    return condition


def _swapped(profiles: DataFrame, rules: Rules) -> DataFrame:
    return swap_map(
        identities(profiles), rules.flips, rules.dashes, rules.repair_names, rules.dash_match
    )


def _repaired_identities(swaps: DataFrame) -> DataFrame:
    return swaps.select(
        F.col("first_name_1").alias("first_name"), F.col("last_name_1").alias("last_name"),
        "n", "first_ord",
    )


def _name_map(swaps: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame | None]:
    """Each identity with its final identifier and names (``*_2``) and, where
    the spelling changed, ``spelling_id``; and the blocks of names, if these were compared."""
    blocks = None
    if rules.misspellings:
        clusters, blocks = clusters_and_blocks(_repaired_identities(swaps))
        clusters = materialize(clusters, "name-clusters")
        wrong = misspelled_pairs(canonical_names(clusters)).select(
            F.col("first_name").alias("first_name_1"), F.col("last_name").alias("last_name_1"),
            F.col("canonical_first_name").alias("_first"), F.col("canonical_last_name").alias("_last"),
            F.col("canonical_identifier").alias("spelling_id"),
        )
        swaps = swaps.join(wrong, ["first_name_1", "last_name_1"], "left")
    else:
        for c in ("_first", "_last", "spelling_id"):
            swaps = swaps.withColumn(c, F.lit(None).cast("string"))
    named = swaps.select(
        *IDENTITY, "flip_id", "dash_id", "spelling_id",
        "student_identifier_1", "first_name_1", "last_name_1",
        F.coalesce("spelling_id", "student_identifier_1").alias("student_identifier_2"),
        F.coalesce("_first", "first_name_1").alias("first_name_2"),
        F.coalesce("_last", "last_name_1").alias("last_name_2"),
    )
    return named, blocks


def _name_messages(terms: DataFrame) -> list[DataFrame]:
    """Messages of the three name rules, from identities with their semesters."""
    spelled = F.concat(
        F.coalesce("first_name_1", F.lit("")), F.lit(" "), F.coalesce("last_name_1", F.lit(""))
    )
    return [
        message_rows(terms.where("flip_id is not null"), "flipped", "flip_id", "student_identifier"),
        message_rows(
            terms.where("dash_id is not null"), "dash", "dash_id",
            F.coalesce("flip_id", "student_identifier"),
        ),
        message_rows(terms.where("spelling_id is not null"), "misspelled", "spelling_id", spelled),
    ]


@dataclass(frozen=True)
class Findings:
    fixes: DataFrame  # identity and semester, their new values, one row where any differs
    messages: DataFrame
    blocks: DataFrame | None = None  # how crowded the blocks of names are, where these were compared

    @cached_property
    def corrections(self) -> DataFrame:
        """The fixes, written when first asked for: messages alone do not need them."""
        return materialize(self.fixes, "corrections")


def find_corrections(profiles: DataFrame, rules: Rules = Rules()) -> Findings:
    """Run the rules over profiles (see ``profile``)."""
    swaps = materialize(_swapped(profiles, rules), "swaps")
    names, blocks = _name_map(swaps, rules)

    renamed = profiles.alias("p").join(names.alias("m"), null_safe("p", "m", IDENTITY)).select(
        *[f"p.{c}" for c in IDENTITY], "p.semester", "p.class_standing", "p.emphasis", "p.n", "p.first_ord",
        "m.flip_id", "m.dash_id", "m.spelling_id",
        *[f"m.{c}_{k}" for k in (1, 2) for c in IDENTITY],
    )
    renamed = materialize(renamed, "renamed-profiles")

    final = renamed.select(
        F.col("student_identifier_2").alias("student_identifier"),
        "semester", "class_standing", "emphasis", "n", "first_ord",
    )
    messages = _name_messages(renamed)
    fixes = renamed.select(*TERM_IDENTITY, *[f"{c}_2" for c in IDENTITY]).distinct()
    active = {
        "standing": (STANDING, rules.standings),
        "emphasis": (EMPHASIS, rules.emphases),
    }
    attributes = [a for a, on in active.values() if on]
    conflicts = None
    if attributes:
        conflicts = materialize(attribute_conflicts(final, attributes), "conflicts")
    for kind, (attribute, on) in active.items():
        flag, value = f"fix_{attribute}", f"new_{attribute}"
        if not on:
            fixes = fixes.withColumn(flag, F.lit(None).cast("boolean"))
            fixes = fixes.withColumn(value, F.lit(None).cast("string"))
            continue
        here = conflicts.where(F.col("attribute") == attribute)
        messages.append(message_rows(here, kind, "student_identifier", "value"))
        found = here.select(
            F.col("student_identifier").alias("_id"), F.col("semester").alias("_semester"),
            F.col("value").alias(value), F.lit(True).alias(flag),
        )
        at = F.col("student_identifier_2").eqNullSafe(F.col("_id")) & F.col("semester").eqNullSafe(F.col("_semester"))
        fixes = fixes.join(found, at, "left").drop("_id", "_semester")

    changed = F.coalesce("fix_class_standing", F.lit(False)) | F.coalesce("fix_emphasis", F.lit(False))
    for c in IDENTITY:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return Findings(fixes.where(changed), union_messages(messages), blocks)


def apply_corrections(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rewrite identities and attributes of scores or cells.

    One left join against a table with one row per identity and semester, so
    rows are neither lost nor doubled. The planner broadcasts the corrections
    when their stored size allows; otherwise hot identities on the large side
    are split by the adaptive skew join.
    """
    joined = df.alias("d").join(corrections.alias("c"), null_safe("d", "c", TERM_IDENTITY), "left")
    hit = F.col("c.student_identifier_2").isNotNull()
    values = {
        **{c: F.when(hit, F.col(f"c.{c}_2")).otherwise(F.col(f"d.{c}")) for c in IDENTITY},
        **{
            c: F.when(F.col(f"c.fix_{c}"), F.col(f"c.new_{c}")).otherwise(F.col(f"d.{c}"))
            for c in ("class_standing", "emphasis")
        },
    }
    return joined.select(*[values.get(c, F.col(f"d.{c}")).alias(c) for c in df.columns])


def stored_profile(scores: DataFrame) -> DataFrame:
    return materialize(profile(as_cells(scores)), "profiles")


def validate_scores(scores: DataFrame, rules: Rules = Rules()) -> Validation:
    """Repair scores; returns the repaired scores and the messages."""
    findings = find_corrections(stored_profile(scores), rules)
    return Validation(apply_corrections(scores, findings.corrections), findings.messages)


def _only(**on: bool) -> Rules:
    off = dict.fromkeys(("flips", "dashes", "misspellings", "standings", "emphases"), False)
    return Rules(**{**off, **on})


def repair_flipped(scores: DataFrame, repair_names: bool = False) -> Validation:
    rules = _only(flips=True)
    return validate_scores(scores, Rules(**{**rules.__dict__, "repair_names": repair_names}))


def repair_dashes(scores: DataFrame, match: str = "first_name") -> Validation:
    rules = _only(dashes=True)
    return validate_scores(scores, Rules(**{**rules.__dict__, "dash_match": match}))


def repair_misspelled(scores: DataFrame) -> Validation:
    return validate_scores(scores, _only(misspellings=True))


def resolve_standing(scores: DataFrame) -> Validation:
    return validate_scores(scores, _only(standings=True))


def resolve_emphasis(scores: DataFrame) -> Validation:
    return validate_scores(scores, _only(emphases=True))

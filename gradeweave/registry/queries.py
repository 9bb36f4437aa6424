"""Registered queries: name -> (spark, folder of tables) -> DataFrame.

All run over the whole sheet derived from the order tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import mode_first_seen
from gradeweave.functions.numbers import format_mean
from gradeweave.functions.text import clean, fold, semester_sort_key, sound_code
from gradeweave.operators import averages as avg
from gradeweave.operators import clusters as clu
from gradeweave.operators import conflicts as con
from gradeweave.operators import ingest as ing
from gradeweave.operators import likeness as lik
from gradeweave.operators import name_swaps as swp
from gradeweave.operators import ordering as odr
from gradeweave.operators import report as rep
from gradeweave.operators.cells import as_cells, identities, profile, score_cells
from gradeweave.plans import report_job as job
from gradeweave.plans import validate as val
from gradeweave.session import materialize, scratch_root
from gradeweave.sources.order_sheet import HEADER, score_sheet_wide, table
from gradeweave.sources.sheets import ROW_NO, Sheet, cell, read_csv_sheet, write_csv_sheet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END, SKIP = "I", "O", ()  # the score columns of the derived sheet
SKIPPED = ("K",)  # for the column-range query: one of the repeated headers
SEMESTER = "Fall 1996"


def register(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def register_as(name: str) -> Callable[[Query], Query]:
    def keep(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return keep


def sheet_of(spark: SparkSession, sf_dir: str) -> tuple[Sheet, ing.Layout]:
    sheet = score_sheet_wide(spark, sf_dir)
    return sheet, ing.plan_layout(sheet.header, START, END, SKIP)


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.sheet_rows(*sheet_of(spark, sf_dir))


def scores_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.read_scores(*sheet_of(spark, sf_dir))


def cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as cells: for queries that fold them once."""
    return as_cells(scores_of(spark, sf_dir))


def stored_cells_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded cells: for queries that use them more than once."""
    return materialize(score_cells(scores_of(spark, sf_dir)), "cells")


def profiles_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return val.stored_profile(scores_of(spark, sf_dir))


def identities_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(identities(profiles_of(spark, sf_dir)), "identities")


def swapped_identities_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities after the flip and dash repairs: what the name graph works on."""
    swaps = swp.swap_map(identities_of(spark, sf_dir))
    renamed = swaps.select(
        F.col("first_name_1").alias("first_name"), F.col("last_name_1").alias("last_name"), "n", "first_ord"
    )
    return materialize(renamed, "swapped-identities")


# Reading the sheet


def header_rows(spark: SparkSession, sf_dir: str, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """Positions and output names of the score columns, with how many cells are filled."""
    sheet, _ = sheet_of(spark, sf_dir)
    layout = ing.plan_layout(sheet.header, START, END, skip)
    filled = F.array(*[
        F.struct(F.lit(c).alias("col_no"), F.lit(name).alias("score_name"), F.col(cell(c)).alias("raw"))
        for c, name in layout.scores
    ])
    cells = ing.select_columns(sheet, layout).select(F.inline(filled))
    return cells.groupBy("col_no", "score_name").agg(
        F.count("raw").alias("filled"), F.count(F.lit(1)).alias("cells")
    )


@register
def read_wide_sheet(spark, sf_dir):
    """The sheet written as CSV files and read back by position."""
    sheet, _ = sheet_of(spark, sf_dir)
    path = f"{scratch_root(spark)}/gradeweave/{spark.sparkContext.applicationId}/sheet-{uuid.uuid4().hex}"
    write_csv_sheet(sheet, path)
    return read_csv_sheet(spark, path, row_no_header="Row").cells


@register
def header_mapping(spark, sf_dir):
    """What each mapped attribute column holds: header, position and filled cells."""
    sheet, layout = sheet_of(spark, sf_dir)
    found = F.array(*[
        F.struct(F.lit(HEADER[c - 1]).alias("header"), F.lit(c).alias("col_no"), F.col(cell(c)).alias("raw"))
        for c in layout.attributes.values()
    ])
    return sheet.cells.select(F.inline(found)).groupBy("header", "col_no").agg(F.count("raw").alias("filled"))


@register
def approach_rename(spark, sf_dir):
    return header_rows(spark, sf_dir)


@register
def column_range(spark, sf_dir):
    return header_rows(spark, sf_dir, SKIPPED)


@register
def clean_strings(spark, sf_dir):
    sheet, layout = sheet_of(spark, sf_dir)
    return sheet.cells.select(
        ROW_NO, *[clean(F.col(cell(c))).alias(name) for name, c in layout.attributes.items()]
    )


@register
def student_identifier(spark, sf_dir):
    return rows_of(spark, sf_dir).select(ROW_NO, "student_identifier")


@register
def filter_blank_names(spark, sf_dir):
    return ing.keep_named(rows_of(spark, sf_dir)).select(ROW_NO, "first_name", "last_name")


@register
def filter_bad_semester(spark, sf_dir):
    return ing.keep_dated(ing.keep_named(rows_of(spark, sf_dir))).select(ROW_NO, "semester")


@register
def filter_empty_rows(spark, sf_dir):
    sheet, layout = sheet_of(spark, sf_dir)
    return ing.keep_scored(ing.sheet_rows(sheet, layout), layout).select(ROW_NO, "student_identifier")


@register
def row_diagnostics(spark, sf_dir):
    return ing.sheet_diagnostics(*sheet_of(spark, sf_dir))


@register
def emphasis_reclass(spark, sf_dir):
    rows = rows_of(spark, sf_dir).withColumn("given", F.col("emphasis"))
    return ing.reclassify_emphasis(rows).select(ROW_NO, "class_standing", "semester", "given", "emphasis")


@register
def unpivot_scores(spark, sf_dir):
    sheet, layout = sheet_of(spark, sf_dir)
    return ing.unpivot_scores(ing.usable_rows(sheet, layout), layout).select(ROW_NO, "col_no", "score_name", "raw")


@register
def numeric_scores(spark, sf_dir):
    return scores_of(spark, sf_dir)


@register_as("semester_sort_key")
def semester_sort_keys(spark, sf_dir):
    return rows_of(spark, sf_dir).groupBy(
        "semester", semester_sort_key(F.col("semester")).alias("semester_sort")
    ).agg(F.count(F.lit(1)).alias("n"))


@register
def run_counts(spark, sf_dir):
    cells = stored_cells_of(spark, sf_dir)
    return job.run_counts(cells, avg.current_students(cells, SEMESTER))


@register
def current_semester_students(spark, sf_dir):
    scores = scores_of(spark, sf_dir)
    return avg.current_students(scores, SEMESTER).select("ord", "student_identifier", "semester", "score")


# Averages and reports


def averages_of(cells: DataFrame) -> DataFrame:
    return avg.student_score_averages(cells)


def with_double_average(df: DataFrame) -> DataFrame:
    """The exact parts of each mean, and the mean itself as a double."""
    return df.withColumn("average", F.col("score_sum").cast("double") / F.col("score_count"))


def report_cells_of(spark, sf_dir) -> DataFrame:
    cells = stored_cells_of(spark, sf_dir)
    return avg.report_cells(averages_of(cells), avg.cohort_average(cells))


@register
def student_score_averages(spark, sf_dir):
    return with_double_average(averages_of(cells_of(spark, sf_dir)))


@register
def cohort_average(spark, sf_dir):
    return with_double_average(avg.cohort_average(cells_of(spark, sf_dir)))


@register
def format_scores(spark, sf_dir):
    averages = averages_of(cells_of(spark, sf_dir))
    return averages.select(
        "student_identifier", "semester", "score_name", format_mean(F.col("score_sum"), F.col("score_count")).alias("shown")
    )


@register
def report_cells(spark, sf_dir):
    return report_cells_of(spark, sf_dir).drop("first_ord")


@register
def report_grid(spark, sf_dir):
    return rep.report_grid(materialize(report_cells_of(spark, sf_dir), "report-cells"))


@register
def report_pivot(spark, sf_dir):
    """Columns for all terms of the years the orders span."""
    date = F.year("o_orderdate")
    span = table(spark, sf_dir, "orders").agg(F.min(date).alias("first"), F.max(date).alias("last")).first()
    terms = ("Spring", "New Student Fall", "Fall")
    semesters = [f"{term} {year}" for year in range(span["first"], span["last"] + 1) for term in terms]
    return rep.report_pivot(report_cells_of(spark, sf_dir), semesters)


@register
def report_pivot_map(spark, sf_dir):
    """The pivot as a map, its keys and values in order."""
    rows = rep.report_pivot_map(report_cells_of(spark, sf_dir))
    listed = lambda x: F.array_join(x, "|")
    return rows.select(
        "student_identifier", "score_name", listed(F.map_keys("semesters")).alias("semesters"),
        listed(F.map_values("semesters")).alias("yours"))


@register
def students_by_last_name(spark, sf_dir):
    return odr.students_by_last_name(averages_of(cells_of(spark, sf_dir)))


@register
def student_semesters(spark, sf_dir):
    return odr.student_semesters(averages_of(cells_of(spark, sf_dir)))


@register
def student_assessments(spark, sf_dir):
    return odr.student_assessments(averages_of(cells_of(spark, sf_dir)))


@register
def student_report(spark, sf_dir):
    table = materialize(report_cells_of(spark, sf_dir), "report-cells")
    documents = rep.student_report(rep.report_grid(table), odr.students_by_last_name(table))
    return documents.select(
        "student_identifier", "student_pos", "title", "note",
        F.array_join("row_labels", "|").alias("row_labels"),
        F.array_join("semesters", "|").alias("semesters"),
        F.to_json("rows").alias("rows"),
    )


# Name repairs


@register
def flipped_names(spark, sf_dir):
    return swp.flipped_names(identities_of(spark, sf_dir))


@register
def lost_dashes(spark, sf_dir):
    return swp.lost_dashes(identities_of(spark, sf_dir))


@register
def soundex_names(spark, sf_dir):
    names = lik.distinct_names(identities_of(spark, sf_dir))
    return names.select("part", "name", sound_code(F.col("name")).alias("code"))


@register
def levenshtein_pairs(spark, sf_dir):
    """Upper-cased names of one part that are one edit apart."""
    nodes = materialize(lik.name_nodes(lik.distinct_names(identities_of(spark, sf_dir))), "name-nodes")
    keys = nodes.select("node", "part", "key")
    pairs = lik.one_edit_pairs(nodes).select("node", "linked")
    other = keys.select(F.col("node").alias("linked"), F.col("key").alias("other"))
    return pairs.join(keys, "node").join(other, "linked").select("part", F.col("key").alias("name"), "other")


def alike_names(spark, sf_dir, part: str) -> DataFrame:
    """Each distinct name with its sound code, and with the alike names that
    have another code. Names of one code are alike and not listed pairwise."""
    names = lik.distinct_names(swapped_identities_of(spark, sf_dir)).where(F.col("part") == part)
    names = materialize(names, "distinct-names")
    nodes = materialize(lik.name_nodes(names), "name-nodes")
    placed = names.select("name", fold(F.col("name")).alias("key")).join(nodes.where("not blank"), "key")
    placed = placed.select("name", "node", F.element_at(F.split("block", ":", 2), 2).alias("code"))
    linked = lik.name_links(nodes).select("node", "linked")
    other = placed.select(F.col("node").alias("linked"), F.col("name").alias("alike"))
    by_link = placed.join(linked, "node").join(other, "linked")
    return placed.select("name", F.lit("sound").alias("via"), F.col("code").alias("alike")).unionByName(
        by_link.select("name", F.lit("link").alias("via"), "alike")
    )


@register
def similar_first_names(spark, sf_dir):
    return alike_names(spark, sf_dir, "first")


@register
def similar_last_names(spark, sf_dir):
    return alike_names(spark, sf_dir, "last")


@register
def name_blocks(spark, sf_dir):
    """Names, spellings and links of every sound code."""
    return lik.name_blocks(lik.name_graph(lik.distinct_names(swapped_identities_of(spark, sf_dir))))


@register
def maximal_name_sets(spark, sf_dir):
    """Each distinct name with the set it uses, named by the set's owner."""
    names = materialize(lik.distinct_names(swapped_identities_of(spark, sf_dir)), "distinct-names")
    owners = lik.name_owners(lik.name_graph(names))
    used = names.select("part", "name", fold(F.col("name")).alias("key")).join(
        owners.where("not blank").select("part", "key", "owner", F.col("owner_size").alias("set_size")),
        ["part", "key"],
    )
    owner = names.select(
        (F.col("name_ord") * 2 + (F.col("part") == "last").cast("int")).alias("owner"),
        F.col("name").alias("owner_name"),
    )
    return used.join(owner, "owner").select("part", "name", "owner_name", "set_size")


@register
def name_pair_edges(spark, sf_dir):
    return clu.first_takers(swapped_identities_of(spark, sf_dir)).drop("pair", "taker")


@register
def name_clusters(spark, sf_dir):
    return clu.name_clusters(swapped_identities_of(spark, sf_dir)).withColumnRenamed("pair", "first_ord")


@register
def canonical_names(spark, sf_dir):
    clusters = materialize(clu.name_clusters(swapped_identities_of(spark, sf_dir)), "clusters")
    return clu.canonical_names(clusters).select(
        "first_name", "last_name", "canonical_first_name", "canonical_last_name"
    )


# Repaired scores

NAMED = ["ord", "student_identifier", "first_name", "last_name"]


@register
def repair_flipped(spark, sf_dir):
    return val.repair_flipped(scores_of(spark, sf_dir)).scores.select(*NAMED)


@register
def repair_dashes(spark, sf_dir):
    return val.repair_dashes(scores_of(spark, sf_dir)).scores.select(*NAMED)


@register
def repair_misspelled(spark, sf_dir):
    """All name repairs: the misspelling rule follows the flip and dash rules."""
    rules = val.Rules(standings=False, emphases=False)
    return val.validate_scores(scores_of(spark, sf_dir), rules).scores.select(*NAMED)


@register_as("mode_first_seen")
def commonest_standings(spark, sf_dir):
    return mode_first_seen(profile(cells_of(spark, sf_dir)), con.TERM, "class_standing")


@register
def multiple_standings(spark, sf_dir):
    return con.multiple_standings(profiles_of(spark, sf_dir))


@register
def multiple_emphases(spark, sf_dir):
    return con.multiple_emphases(profiles_of(spark, sf_dir))


@register
def resolve_standing(spark, sf_dir):
    return val.resolve_standing(scores_of(spark, sf_dir)).scores.select("ord", "class_standing")


@register
def resolve_emphasis(spark, sf_dir):
    return val.resolve_emphasis(scores_of(spark, sf_dir)).scores.select("ord", "emphasis")


@register
def validation_messages(spark, sf_dir):
    return val.find_corrections(profiles_of(spark, sf_dir)).messages


@register
def validated_scores(spark, sf_dir):
    return val.validate_scores(scores_of(spark, sf_dir)).scores


@register
def full_report(spark, sf_dir):
    """The whole job: read, repair, average, compare, and place in the reports."""
    sheet, _ = sheet_of(spark, sf_dir)
    options = job.JobOptions("", start_column=START, last_column=END, skip_columns=SKIP)
    return job.run_sheet(sheet, options).cells


"""The whole job: read, choose students, repair, average, report."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gradeweave.operators.averages import (
    cohort_average,
    current_students,
    report_cells,
    student_score_averages,
)
from gradeweave.operators.cells import merge_cells, profile, score_cells
from gradeweave.operators.ingest import (
    DEFAULT_END,
    DEFAULT_SKIP,
    DEFAULT_START,
    FINDING,
    SCORE,
    plan_layout,
    sheet_events,
)
from gradeweave.operators.ordering import students_by_last_name
from gradeweave.operators.report import positioned_cells, report_grid, student_report
from gradeweave.plans.validate import Findings, Rules, apply_corrections, find_corrections
from gradeweave.schema import SCORE_COLUMNS, SCORE_PRECISION, SCORE_SCALE
from gradeweave.session import discard, materialize, materialize_by, scratch_run
from gradeweave.sources.outputs import folders_of, refuse_overlap, replaced_together, write_by_student, write_table
from gradeweave.sources.sheets import (
    ROW_NO,
    Sheet,
    cell,
    read_csv_sheets,
    read_parquet_sheet,
    read_table_sheet,
    resolve_sheet_path,
    resolve_sheet_table,
)


@dataclass(frozen=True)
class JobOptions:
    workbook: str  # folder of sheets, or a catalog schema
    sheet_name: str = "Sheet1"
    output: str | None = None
    current_semester: str | None = None
    start_column: str | None = DEFAULT_START
    last_column: str | None = DEFAULT_END
    skip_columns: tuple[str, ...] = DEFAULT_SKIP
    validate_only: bool = False
    row_no_header: str | None = None  # column of row numbers; needed for parquet and tables
    source: str = "csv"  # csv, parquet or table
    header: tuple[str | None, ...] | None = None  # header texts of parquet and tables, where they repeat
    precision: int = SCORE_PRECISION
    scale: int = SCORE_SCALE
    buckets: int = 64  # folders of the report tables
    collation: str | None = None  # order of students by last name, such as UNICODE; code points if unset
    max_block: int = 1_000  # names with one sound code that are told as crowded when there are more
    rules: Rules = field(default_factory=Rules)


@dataclass(frozen=True)
class Report:
    counts: DataFrame
    diagnostics: DataFrame
    messages: DataFrame
    cells: DataFrame | None = None
    documents: DataFrame | None = None
    ingested: DataFrame | None = None  # one row: rows_read, cells_kept, cells_lost
    crowded: DataFrame | None = None  # sound codes with more names than max_block
    scratch: str | None = None  # folder the tables above are read from

    def close(self) -> None:
        """Remove the run's scratch folder; the tables above cannot be read then."""
        if self.scratch:
            discard(self.counts.sparkSession, self.scratch)


def run_counts(read: DataFrame, used: DataFrame) -> DataFrame:
    """One row: scores read and scores of the chosen students, from cells."""
    both = read.select("score_count", F.lit(1).alias("is_read")).unionByName(
        used.select("score_count", F.lit(0).alias("is_read"))
    )

    def total(flag: int):
        return F.coalesce(F.sum(F.when(F.col("is_read") == flag, F.col("score_count"))), F.lit(0))

    return both.agg(total(1).alias("scores_read"), total(0).alias("scores_used"))


def cell_findings(cells: DataFrame, rules: Rules = Rules()) -> Findings:
    return find_corrections(materialize(profile(cells), "profiles"), rules)


def repaired_cells(cells: DataFrame, findings: Findings) -> DataFrame:
    return materialize(merge_cells(apply_corrections(cells, findings.corrections)), "repaired-cells")


def report_tables(cells: DataFrame, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Report cells with positions, and the documents, from stored cells."""
    table = materialize(report_cells(student_score_averages(cells), cohort_average(cells)), "report-cells")
    positions = students_by_last_name(table, collation)
    return positioned_cells(table, positions), student_report(report_grid(table), positions)


def run_sheet(sheet: Sheet, options: JobOptions) -> Report:
    return run_sheets([sheet], options)


def stored_events(sheets: list[Sheet], options: JobOptions) -> tuple[DataFrame, DataFrame]:
    """Scores and diagnostics of all sheets, read in one pass and stored by kind; and, from that pass, one row of rows
    read, cells kept, and cells lost to their type."""
    kind = {"precision": options.precision, "scale": options.scale}
    width = max(len(s.header) for s in sheets)
    passed, events = [], []
    for s in sheets:
        layout = plan_layout(s.header, options.start_column, options.last_column, options.skip_columns)
        needed = sorted({*layout.attributes.values(), *layout.scanned})  # counting rows would keep all columns
        passed.append(Observation())
        rows = s.cells.select(ROW_NO, *map(cell, needed)).observe(passed[-1], F.count(F.lit(1)).alias("rows"))
        events.append(sheet_events(Sheet(rows, s.header), layout, **kind, width=width))
    made, is_score = Observation(), F.col("kind") == SCORE
    # A finding of a cell stands for a lost cell if it has no score.
    lost = ~is_score & (F.col("field") == "score") & F.col("score").isNull()
    counted = reduce(DataFrame.unionByName, events).observe(
        made, F.count_if(is_score).alias("kept"), F.count_if(F.coalesce(lost, F.lit(False))).alias("lost"))
    stored = materialize_by(counted, "events", "kind")
    rows = sum(seen.get["rows"] for seen in passed)
    ingested = stored.sparkSession.createDataFrame(
        [(rows, made.get["kept"], made.get["lost"])], "rows_read long, cells_kept long, cells_lost long")
    return stored, ingested


def run_sheets(sheets: list[Sheet], options: JobOptions) -> Report:
    """The job over sheets of one workbook page, each with a header of its own."""
    events, ingested = stored_events(sheets, options)
    read = materialize(score_cells(events.where(F.col("kind") == SCORE).select(*SCORE_COLUMNS)), "cells")
    diagnostics = events.where(F.col("kind") == FINDING).select(ROW_NO, "field", "message")
    used, counted = current_students(read, options.current_semester), Observation()
    findings = cell_findings(used.observe(counted, F.coalesce(F.sum("score_count"), F.lit(0)).alias("n")), options.rules)
    counts = ingested.select(
        F.col("cells_kept").alias("scores_read"), F.lit(counted.get["n"]).cast("long").alias("scores_used"))
    crowded = None if findings.blocks is None else findings.blocks.where(F.col("names") > options.max_block)
    report = Report(counts, diagnostics, findings.messages, ingested=ingested, crowded=crowded)
    if options.validate_only:
        return report
    cells, documents = report_tables(repaired_cells(used, findings), options.collation)
    return replace(report, cells=cells, documents=documents)


def read_sheets(spark: SparkSession, options: JobOptions) -> list[Sheet]:
    """The sheets that the options name."""
    if options.source == "csv":
        path = resolve_sheet_path(spark, options.workbook, options.sheet_name)
        return read_csv_sheets(spark, path, options.row_no_header)
    if options.row_no_header is None:
        raise ValueError("Name the column of row numbers: row_no_header")
    header = None if options.header is None else list(options.header)
    if options.source == "parquet":
        path = resolve_sheet_path(spark, options.workbook, options.sheet_name)
        return [read_parquet_sheet(spark, path, options.row_no_header, header)]
    if options.source == "table":
        return [read_table_sheet(spark, options.workbook, options.sheet_name, options.row_no_header, header)]
    raise ValueError(f"Unknown source {options.source}: csv, parquet or table")


def inputs_of(spark: SparkSession, options: JobOptions) -> list[str]:
    """Folders that the job reads."""
    if options.source == "table":
        return folders_of(spark.table(resolve_sheet_table(spark, options.workbook, options.sheet_name)))
    return [resolve_sheet_path(spark, options.workbook, options.sheet_name)]


def run(spark: SparkSession, options: JobOptions) -> Report:
    """Run the job; results are also written when ``output`` is set, all of them or none."""
    if options.output:
        refuse_overlap(options.output, *inputs_of(spark, options))
    with scratch_run(spark) as scratch:
        report = replace(run_sheets(read_sheets(spark, options), options), scratch=scratch)
        if options.output:
            with replaced_together(spark, options.output) as folder:
                _write(report, folder, options.buckets)
    return report


def _write(report: Report, folder: str, buckets: int) -> None:
    tables = {
        "run_counts": report.counts, "diagnostics": report.diagnostics, "messages": report.messages,
        "ingested": report.ingested, "crowded_blocks": report.crowded,
    }
    for name, table in tables.items():
        if table is not None:
            write_table(table, f"{folder}/{name}")
    if report.cells is not None:
        write_by_student(report.cells, f"{folder}/report_cells", buckets=buckets)
        write_by_student(report.documents, f"{folder}/documents", "json", buckets)

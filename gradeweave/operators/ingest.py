"""From a wide sheet to long-form scores, with row diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.numbers import is_number, number_loss, number_value
from gradeweave.functions.text import (
    NBSP,
    WHITE_SPACE,
    clean,
    fold,
    fold_text,
    full_name,
    is_blank,
    semester_sort_key,
    text_or_empty,
)
from gradeweave.schema import SCORE_COLUMNS, SCORE_PRECISION, SCORE_SCALE, columns_per_row
from gradeweave.session import bound_methods
from gradeweave.sources.sheets import ROW_NO, Sheet, cell

# Header texts, labels and messages of the sheet format.
NAME_HEADERS = {
    "first_name": "First Name",
    "last_name": "Last Name",
    "class_standing": "Class Standing",
    "emphasis": "Emphasis",
    "semester": "Semester/Date",
}
REPEATED_HEADER = "Approach"
REPEATED_NAMES = [
    "Acting/Directing Approach",
    "Design Approach",
    "Educational Approach",
    "Other Project Approach",
]
DEFAULT_START, DEFAULT_END, DEFAULT_SKIP = "I", "AP", ("AH", "AI", "AJ")
FRESHMAN = "1 - Freshman"
NEW_STUDENT = "NEW STUDENT"
APPLICANT_OF = "Musical Theatre"
APPLICANT = "Musical Theatre Applicant"
#: Kinds of what a sheet holds.
SCORE, FINDING = "score", "finding"


def column_number(letters: str) -> int:
    """Position of a spreadsheet column: A is 1, Z 26, AA 27."""
    number = 0
    for letter in letters:
        if not "A" <= letter <= "Z":
            raise ValueError(f"Not a column: {letters}")
        number = number * 26 + ord(letter) - ord("A") + 1
    return number


def _clean_header(text: str | None) -> str | None:
    return text if text is None else text.replace(NBSP, " ").strip(WHITE_SPACE)


@dataclass(frozen=True)
class Layout:
    """What the header row says: attribute positions and the score columns in order."""

    attributes: dict[str, int]
    scores: tuple[tuple[int, str | None], ...]
    scanned: tuple[int, ...]


def score_range(width: int, start: str | None, end: str | None) -> range:
    """Columns from start to end. Without a start it is the first column;
    without an end the sheet's last column is left out."""
    first = column_number(start or "A")
    last = width - 1 if end is None else column_number(end)
    return range(first, last + 1)


def map_header(header: Sequence[str | None], last: int) -> tuple[dict[str, int], dict[int, str]]:
    """Positions by header text (a later duplicate wins), and the new names of
    the repeated columns, up to column ``last``."""
    positions: dict[str, int] = {}
    renamed: dict[int, str] = {}
    seen = 0
    for position, raw in enumerate(header[:last], 1):
        text = _clean_header(raw)
        if not text:
            continue
        if fold_text(text) == fold_text(REPEATED_HEADER):
            if seen < len(REPEATED_NAMES):
                renamed[position] = REPEATED_NAMES[seen]
            seen += 1
        else:
            positions[text] = position
    return positions, renamed


def plan_layout(
    header: Sequence[str | None],
    start: str | None = DEFAULT_START,
    end: str | None = DEFAULT_END,
    skip: Sequence[str] = DEFAULT_SKIP,
) -> Layout:
    """Read the header row. Works on header texts only, never on rows."""
    columns = score_range(len(header), start, end)
    positions, renamed = map_header(header, columns.stop - 1)
    lost = [text for text in NAME_HEADERS.values() if text not in positions]
    if lost:
        raise ValueError(f"Headers missing at or before the last column: {', '.join(lost)}")
    skipped = {column_number(s) for s in skip}
    present = [c for c in columns if c <= len(header)]
    return Layout(
        {name: positions[text] for name, text in NAME_HEADERS.items()},
        tuple((c, renamed.get(c, _clean_header(header[c - 1]))) for c in present if c not in skipped),
        tuple(present),
    )


def select_columns(sheet: Sheet, layout: Layout) -> DataFrame:
    """Row number and the raw cells of the score columns."""
    return sheet.cells.select(ROW_NO, *[cell(c) for c, _ in layout.scores])


def sheet_rows(sheet: Sheet, layout: Layout) -> DataFrame:
    """Cleaned attributes and identifier beside the raw cells."""
    bound_methods(sheet.cells.sparkSession)
    attributes = [clean(F.col(cell(c))).alias(name) for name, c in layout.attributes.items()]
    named = sheet.cells.select(ROW_NO, *attributes, *[cell(c) for c in layout.scanned])
    return named.withColumn("student_identifier", full_name(F.col("first_name"), F.col("last_name")))


def keep_named(rows: DataFrame) -> DataFrame:
    """Drop rows without any name."""
    return rows.where(~(_is_empty("first_name") & _is_empty("last_name")))


def _is_empty(attribute: str):
    """Whether a cleaned attribute is missing."""
    return text_or_empty(F.col(attribute)) == ""


def _has_term():
    return F.contains(text_or_empty(F.col("semester")), F.lit(" "))


def keep_dated(rows: DataFrame) -> DataFrame:
    """Drop rows whose semester is blank or a single word."""
    return rows.where(_has_term())


def _has_value(layout: Layout) -> Column:
    """Whether anything stands in the score range, skipped columns included. A range of one cell is not tested."""
    if len(layout.scanned) <= 1:
        return F.lit(True)
    return reduce(Column.__or__, [~is_blank(F.col(cell(c))) for c in layout.scanned])


def keep_scored(rows: DataFrame, layout: Layout) -> DataFrame:
    """Drop rows with nothing in the score range."""
    return rows.where(_has_value(layout))


def _row(text: Column) -> Column:
    return F.concat(F.lit("Row "), F.col(ROW_NO).cast("string"), F.lit(": "), text)


def _row_findings() -> list[Column]:
    """What is missing in a named row: structs of field and message, null where nothing is."""

    def finding(field: str, problem: Column, text: Column) -> Column:
        return F.when(problem, F.struct(F.lit(field).alias("field"), _row(text).alias("message")))

    findings = [
        finding(field, _is_empty(field), F.lit(f"{NAME_HEADERS[field]} is missing"))
        for field in ("first_name", "last_name", "class_standing", "emphasis")
    ]
    quoted = F.concat(
        F.lit("Semester is missing or an unexpected value: '"),
        text_or_empty(F.col("semester")),
        F.lit("'; skipping row."),
    )
    return [*findings, finding("semester", ~_has_term(), quoted)]


def row_diagnostics(named: DataFrame) -> DataFrame:
    """One row per missing attribute of a named row: row_no, field, message."""
    present = F.filter(F.array(*_row_findings()), lambda f: f.isNotNull())
    return named.select(ROW_NO, F.inline(present))


def reclassify_emphasis(rows: DataFrame) -> DataFrame:
    """First-year and new students of one programme count as its applicants."""
    emphasis = F.col("emphasis")
    entering = (F.col("class_standing") == FRESHMAN) | F.contains(fold(F.col("semester")), F.lit(NEW_STUDENT))
    return rows.withColumn(
        "emphasis", F.when(entering & (emphasis == APPLICANT_OF), F.lit(APPLICANT)).otherwise(emphasis)
    )


def unpivot_scores(rows: DataFrame, layout: Layout, *more: tuple[str | None, int, str | None]) -> DataFrame:
    """One row per row and score column, with the raw cell text. Columns are
    told apart by position, as names may repeat. ``more`` adds cells that are
    the same in all rows: name, position and text."""
    ids = [c for c in rows.columns if c not in {cell(n) for n in layout.scanned}]
    text = lambda x: F.lit(x).cast("string")
    triples = [x for c, name in layout.scores for x in (text(name), F.lit(c), F.col(cell(c)))]
    triples += [x for name, c, raw in more for x in (text(name), F.lit(c), text(raw))]
    return rows.select(
        *ids, F.stack(F.lit(len(triples) // 3), *triples).alias("score_name", "col_no", "raw")
    )


def numeric_scores(cells: DataFrame, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE) -> DataFrame:
    """Keep cells that hold a number. The form is tested before the value is
    taken, so that the pattern is matched once per cell. What does not fit the
    type is told by ``score_diagnostics``."""
    numbers = cells.where(is_number(F.col("raw")))
    return numbers.withColumn("score", number_value(F.col("raw"), precision, scale)).where(F.col("score").isNotNull())


def _score_finding(precision: int, scale: int) -> Column:
    """What the type of scores cuts of a cell that holds a number, as in ``_row_findings``."""
    loss = number_loss(F.col("raw"), precision, scale)
    told = F.when(loss == "large", F.lit("' is too large; skipping cell.")).otherwise(F.lit(f"' is rounded to {scale} places."))
    message = _row(F.concat(F.lit("Score '"), F.col("raw"), told))
    return F.when(loss.isNotNull(), F.struct(F.lit("score").alias("field"), message.alias("message")))


def score_diagnostics(cells: DataFrame, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE) -> DataFrame:
    """One row per number that the type of scores cuts: row_no, field, message."""
    told = cells.where(is_number(F.col("raw"))).withColumn("told", _score_finding(precision, scale))
    return told.where(F.col("told").isNotNull()).select(ROW_NO, "told.*")


def usable_rows(sheet: Sheet, layout: Layout) -> DataFrame:
    return reclassify_emphasis(keep_scored(keep_dated(keep_named(sheet_rows(sheet, layout))), layout))


def read_scores(
    sheet: Sheet, layout: Layout, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE, width: int | None = None
) -> DataFrame:
    """All scores of a sheet in the long form. ``width`` is that of the widest
    sheet whose rows are numbered together, by default this one's."""
    rows = usable_rows(sheet, layout).withColumn("semester_sort", semester_sort_key(F.col("semester")))
    scores = numeric_scores(unpivot_scores(rows, layout), precision, scale)
    return scores.select(
        (F.col(ROW_NO) * columns_per_row(width or len(sheet.header)) + F.col("col_no")).alias("ord"), *SCORE_COLUMNS[1:],
    )


def sheet_events(
    sheet: Sheet, layout: Layout, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE, width: int | None = None
) -> DataFrame:
    """All scores and all diagnostics of a sheet in one pass over it, told apart by ``kind``.

    The columns are those of ``read_scores``, then row_no, field and message. A row of the sheet is unpivoted into its
    cells and itself, as a cell in column 0: what is missing in the row belongs to that one.
    """
    rows = reclassify_emphasis(keep_named(sheet_rows(sheet, layout)))
    rows = rows.withColumn("semester_sort", semester_sort_key(F.col("semester"))).withColumn("_used", _has_term() & _has_value(layout))
    itself = (None, 0, None)
    cells = unpivot_scores(rows, layout, itself).where((F.col("col_no") == 0) | (F.col("_used") & is_number(F.col("raw"))))
    values = cells.withColumn("score", number_value(F.col("raw"), precision, scale))

    def event(kind: str, when: Column, finding: Column | None = None) -> Column:
        told = [finding[c].alias(c) if finding is not None else F.lit(None).cast("string").alias(c) for c in ("field", "message")]
        return F.when(when, F.struct(F.lit(kind).alias("kind"), *told))

    of_row = [event(FINDING, f.isNotNull(), f) for f in _row_findings()]
    lost = _score_finding(precision, scale)
    of_cell = [event(SCORE, F.col("score").isNotNull()), event(FINDING, lost.isNotNull(), lost)]
    events = F.when(F.col("col_no") == 0, F.array(*of_row)).otherwise(F.array(*of_cell))
    listed = values.withColumn("_event", F.explode(events)).where(F.col("_event").isNotNull())
    return listed.select(
        "_event.kind",
        (F.col(ROW_NO) * columns_per_row(width or len(sheet.header)) + F.col("col_no")).alias("ord"),
        *SCORE_COLUMNS[1:], ROW_NO, "_event.field", "_event.message",
    )


def sheet_diagnostics(
    sheet: Sheet, layout: Layout, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE
) -> DataFrame:
    """What is missing in rows, and scores that do not fit their type."""
    cells = unpivot_scores(usable_rows(sheet, layout), layout)
    return row_diagnostics(keep_named(sheet_rows(sheet, layout))).unionByName(score_diagnostics(cells, precision, scale))

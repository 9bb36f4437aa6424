"""Files with their own headers, numbers that do not fit, blank headings, row numbers, scratch folders."""

import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeweave import JobOptions, run
from gradeweave.operators.ingest import plan_layout, read_scores, sheet_diagnostics
from gradeweave.operators.likeness import _substitutions, distinct_names, name_nodes
from gradeweave.plans.report_job import read_sheets
from gradeweave.schema import columns_per_row
from gradeweave.sources.outputs import write_by_student
from gradeweave.sources.sheets import read_csv_sheet, read_csv_sheets, read_parquet_sheet, sheet_from_dataframe

NAMES = ["First Name", "Last Name", "Class Standing", "Emphasis", "Semester/Date"]


def book(tmp_path, **files):
    folder = tmp_path / "book" / "Sheet1"
    folder.mkdir(parents=True)
    for name, rows in files.items():
        (folder / f"{name}.csv").write_text("\n".join(",".join(r) for r in rows) + "\n", encoding="utf-8")
    return str(tmp_path / "book")


def row(first, last, *scores):
    return [first, last, "4 - Senior", "Acting", "Fall 2019", *scores]


def opts(workbook, **extra):
    return JobOptions(workbook, start_column="F", last_column="H", skip_columns=(), **extra)


def test_each_file_has_its_own_header(spark, tmp_path):
    swapped = ["Last Name", "First Name", *NAMES[2:]]
    workbook = book(tmp_path, a=[[*NAMES, "Oral", "Essay", "x"], row("Ann", "Lee", "4", "3", "")],
                    b=[[*swapped, "Essay", "Oral", "x"], row("Ray", "Bob", "2", "1", ""), row("Kay", "Ed", "5", "", "")],
                    c=[[*NAMES, "Oral", "Essay", "x"], row("Cy", "Orr", "1", "", "")])
    sheets = read_sheets(spark, opts(workbook))
    assert len(sheets) == 2
    report = run(spark, opts(workbook))
    shown = {(r.student_identifier, r.score_name): r.yours for r in report.cells.collect()}
    assert shown == {("Ann Lee", "Oral"): "4", ("Ann Lee", "Essay"): "3", ("Bob Ray", "Essay"): "2", ("Bob Ray", "Oral"): "1",
                     ("Ed Kay", "Essay"): "5", ("Cy Orr", "Oral"): "1"}
    numbers = sorted((r.row_no, r.c1) for s in sheets for r in s.cells.collect())
    assert numbers == [(2, "Ann"), (3, "Ray"), (4, "Kay"), (5, "Cy")]
    with pytest.raises(ValueError, match="2 different headers"):
        read_csv_sheet(spark, f"{workbook}/Sheet1")


def test_a_heading_may_hold_line_ends(spark, tmp_path):
    folder = tmp_path / "book" / "Sheet1"
    folder.mkdir(parents=True)
    head = ",".join(NAMES)
    (folder / "a.csv").write_text(f'\n\ufeff{head},"Oral\r\nexam ""1""","Two\n\nends",x\r\nAnn,Lee,4 - Senior,Acting,Fall 2019,4,3,\r\n', encoding="utf-8")
    (folder / "b.csv").write_text(f'{head},Oral,Essay,x\n\n   \nBob,Ray,4 - Senior,Acting,Fall 2019,2,1,\n', encoding="utf-8")
    (folder / "c.csv").write_text(f'{head},Oral,"Essay,x\nCy,Orr,4 - Senior,Acting,Fall 2019,5,5,\n', encoding="utf-8")  # never closed
    sheets = read_csv_sheets(spark, str(folder))
    titles = {s.header[5:]: sorted((r.row_no, r.c1, r.c6) for r in s.cells.collect()) for s in sheets}
    assert titles == {('Oral\nexam "1"', "Two\nends", "x"): [(2, "Ann", "4")], ("Oral", "Essay", "x"): [(3, "Bob", "2")],
                      ("Oral", "Essay,x"): [(4, "Cy", "5")]}


def test_lines_are_read_once(spark, tmp_path):
    """Header and rows come from the lines as they were stored, not from the files."""
    workbook = book(tmp_path, a=[[*NAMES, "Oral"], *[row("Ann", "Lee", "4")] * 5])
    (sheet,) = read_csv_sheets(spark, f"{workbook}/Sheet1")
    assert sheet.cells.inputFiles() and not [f for f in sheet.cells.inputFiles() if "book/Sheet1" in f]
    (tmp_path / "book" / "Sheet1" / "a.csv").unlink()
    assert sheet.cells.count() == 5


def test_cells_may_hold_line_ends_where_asked(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"y\nz"\n1,"2\n3"\n4,5\n')
    (sheet,) = read_csv_sheets(spark, str(tmp_path), multi_line=True)
    assert sheet.header == ("x", "y\nz") and sorted(map(tuple, sheet.cells.collect())) == [(2, "1", "2\n3"), (3, "4", "5")]


def test_no_line_is_shuffled(spark, tmp_path):
    workbook = book(tmp_path, a=[[*NAMES, "Oral"], *[row("Ann", "Lee", "4")] * 50])
    (sheet,) = read_csv_sheets(spark, f"{workbook}/Sheet1")
    plan = sheet.cells._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_row_numbers_must_be_whole_and_differ(spark, tmp_path):
    head = ["Row", "a"]
    for i, bad in enumerate((["x", "1"], ["2", "1"])):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "f.csv").write_text("\n".join(",".join(r) for r in [head, ["2", "q"], bad]) + "\n")
        with pytest.raises(ValueError, match="Row numbers .* missing or repeated"):
            read_csv_sheet(spark, str(folder), row_no_header="Row")
    spark.createDataFrame([(1, "a"), (1, "b")], "n long, x string").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="1 .2 rows"):
        read_parquet_sheet(spark, str(tmp_path / "p"), "n")


def test_numbers_that_do_not_fit_are_told(spark, tmp_path):
    workbook = book(tmp_path, a=[[*NAMES, "Oral", "Essay", "Talk"], row("Ann", "Lee", "1234567890123", "0.00000049", "9" * 30),
                                 row("Bob", "Ray", "0.123456789", "", "")])
    report = run(spark, opts(workbook))
    assert sorted((r.row_no, r.field, r.message) for r in report.diagnostics.collect()) == [
        (2, "score", f"Row 2: Score '{'9' * 30}' is too large; skipping cell."),
        (3, "score", "Row 3: Score '0.123456789' is rounded to 8 places."),
    ]
    (sheet,) = read_sheets(spark, opts(workbook))
    layout = plan_layout(sheet.header, "F", "H", ())
    assert [r.score for r in read_scores(sheet, layout).orderBy("ord").collect()] == [
        Decimal("1234567890123"), Decimal("0.00000049"), Decimal("0.12345679")]
    assert sheet_diagnostics(sheet, layout, 38, 6).where("message like '%rounded to 6%'").count() == 2
    wide = run(spark, opts(workbook, precision=38, scale=8))
    assert wide.counts.first().scores_read == 4 and wide.diagnostics.count() == 1


def test_cells_without_heading_are_reported(spark, tmp_path):
    workbook = book(tmp_path, a=[[*NAMES, "Oral", "", "Talk"], row("Ann", "Lee", "1", "2", "3"), row("Bob", "Ray", "", "4", "")])
    report = run(spark, opts(workbook))
    cells = {(r.student_identifier, r.score_name): r.yours for r in report.cells.collect()}
    assert cells == {("Ann Lee", "Oral"): "1", ("Ann Lee", None): "2", ("Ann Lee", "Talk"): "3", ("Bob Ray", None): "4"}
    documents = report.documents.select("student_identifier", F.to_json("rows").alias("j")).collect()
    listed = {(d.student_identifier, x["assessment"] or None): x["cells"][0][0] for d in documents for x in json.loads(d.j)}
    assert listed == cells


def test_positions_of_wide_sheets_differ(spark):
    assert columns_per_row(40) == columns_per_row(9_999) == 10_000 and columns_per_row(10_000) == 100_000
    assert columns_per_row(123_456) > 123_456


def test_job_on_parquet_and_tables(spark, tmp_path):
    rows = [(i, *row("Ann", "Lee", str(i), "", "")) for i in (1, 2)]
    df = spark.createDataFrame(rows, ["n", *[f"h{i}" for i in range(8)]])
    df.write.parquet(str(tmp_path / "book" / "Sheet1"))
    header = (*NAMES, "Oral", None, "x")
    report = run(spark, opts(str(tmp_path / "book"), source="parquet", row_no_header="n", header=header))
    assert [(r.score_name, r.yours) for r in report.cells.collect()] == [("Oral", "1.5")]
    with pytest.raises(ValueError, match="row_no_header"):
        run(spark, opts(str(tmp_path / "book"), source="parquet"))
    assert sheet_from_dataframe(df, "n", list(header)).header == header


def test_a_closed_run_leaves_nothing(spark, tmp_path):
    workbook = book(tmp_path, a=[[*NAMES, "Oral", "Essay", "x"], row("Ann", "Lee", "4", "3", "")])
    report = run(spark, opts(workbook))
    folder = report.scratch.removeprefix("file://").removeprefix("file:")
    assert os.listdir(folder) and report.cells.count() == 2
    report.close()
    assert not os.path.exists(folder)


def test_messages_alone_write_no_corrections(spark, tmp_path):
    workbook = book(tmp_path, a=[[*NAMES, "Oral", "Essay", "x"], row("Ann", "Lee", "4", "3", "")])
    report = run(spark, opts(workbook, validate_only=True))
    folder = report.scratch.removeprefix("file://").removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("corrections")]


def test_a_bucket_has_few_files(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("s"), "id").alias("student_identifier"), "id").repartition(8)
    write_by_student(df, str(tmp_path / "out"), buckets=4)
    for bucket in (tmp_path / "out").glob("bucket=*"):
        assert len(list(bucket.glob("part-*"))) == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500


def test_substitutions_pair_other_blocks_only(spark):
    """One- and two-letter names without sound all share a stem and a block; only names of other blocks pair with them."""
    letters = [chr(0x674E + i) for i in range(40)] + ["A", "B", "李A", "李B"]
    identities = spark.createDataFrame([(n, None, 1, i) for i, n in enumerate(letters)], "first_name string, last_name string, n long, first_ord long")
    nodes = name_nodes(distinct_names(identities))
    key = {r.node: (r.key, r.block) for r in nodes.collect()}
    got = {frozenset((key[r.a.node][0], key[r.b.node][0])) for r in _substitutions(nodes, other_block_only=True).collect()}
    one_off = lambda x, y: len(x) == len(y) and sum(p != q for p, q in zip(x, y, strict=True)) == 1
    held = list(key.values())
    assert got == {frozenset((x, y)) for x, bx in held for y, by in held if bx != by and one_off(x, y)}
    rows = _substitutions(nodes, other_block_only=True).count()
    assert rows == len(got)

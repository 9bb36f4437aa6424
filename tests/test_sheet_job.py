"""Sheets from files to reports."""

import json

import pytest
from pyspark.sql import functions as F

from gradeweave import JobOptions, run
from gradeweave.operators.ingest import plan_layout, read_scores, sheet_diagnostics
from gradeweave.plans.validate import Rules
from gradeweave.sources.outputs import refuse_overlap
from gradeweave.sources.sheets import (
    Sheet,
    read_csv_sheet,
    read_parquet_sheet,
    resolve_sheet_path,
    sheet_from_dataframe,
    write_csv_sheet,
)

HEADER = ["First Name", "Last Name", "Class Standing", "Emphasis", "Semester/Date", "Oral", "Approach",
          "\xa0approach ", "Notes", "Approach", "APPROACH", "Approach", "Overall Success", "Last"]
ROWS = [
    ["Ann", "Lee", "1 - Freshman", "Musical Theatre", "Fall 2019", "4", "3", "2", "x", "1", "5", "9", "3.125", "8"],
    ["Ann", "Lee", "1 - Freshman", "Musical Theatre", "Spring 2020", "3-", "", "n/a", "", "", "", "", "2", ""],
    ["\xa0Bob ", "Ray", "4 - Senior", "Acting", "New Student Fall 2019", "2", "", "", "", "", "", "", "", ""],
    ["Cy", "Orr", "", "", "TBD", "4", "", "", "", "", "", "", "", ""],
    ["", " ", "4 - Senior", "Acting", "Fall 2019", "4", "", "", "", "", "", "", "", ""],
    ["", "Poe", "4 - Senior", "Acting", "Fall 2019", "", "", "", "", "", "", "", "", ""],
    ["Dee", "Fox", "1 - freshman", "Musical Theatre", "Fall 2019", "1,000", "", "", "", "", "", "", "", ""],
]


@pytest.fixture(scope="module")
def workbook(tmp_path_factory):
    """Two CSV files of one sheet; quoting, a comma and a header in each."""
    root = tmp_path_factory.mktemp("book")
    folder = root / "Scores"
    folder.mkdir()
    quote = lambda row: ",".join('"' + c + '"' for c in row)
    for name, rows in (("a.csv", ROWS[:3]), ("b.csv", ROWS[3:])):
        (folder / name).write_text("\n".join([quote(HEADER), *map(quote, rows)]) + "\n", encoding="utf-8")
    return root


@pytest.fixture(scope="module")
def sheet(spark, workbook):
    return read_csv_sheet(spark, resolve_sheet_path(spark, str(workbook), "SCORES"))


def test_missing_sheet_and_empty_sheet(spark, workbook, tmp_path):
    with pytest.raises(ValueError, match="not found"):
        resolve_sheet_path(spark, str(workbook), "Other")
    (tmp_path / "e.csv").write_text("a,b\n")
    with pytest.raises(ValueError, match="no data"):
        read_csv_sheet(spark, str(tmp_path))


def test_lines_are_numbered_across_files(sheet):
    rows = sheet.cells.orderBy("row_no").select("row_no", "c2").collect()
    assert [r.row_no for r in rows] == list(range(2, 9))
    assert [r.c2 for r in rows] == [r[1] for r in ROWS]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("n,m\n" + "".join(f"{i},{'x' * 50}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        cells = read_csv_sheet(spark, str(tmp_path)).cells
        assert cells.rdd.getNumPartitions() > 1
        assert cells.where(F.col("row_no") != F.col("c1").cast("long") + 2).count() == 0
        assert cells.select("row_no").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_layout():
    layout = plan_layout(HEADER, "F", "M", ("I",))
    assert [c for c, _ in layout.scores] == [6, 7, 8, 10, 11, 12, 13]
    assert [n for _, n in layout.scores] == [
        "Oral", "Acting/Directing Approach", "Design Approach", "Educational Approach", "Other Project Approach",
        "Approach", "Overall Success",
    ]
    # Skipped columns count as repeats; without an end the last column is out.
    assert dict(plan_layout(HEADER, "H", None, ("G",)).scores)[8] == "Design Approach"
    assert plan_layout(HEADER, None, None, ()).scanned == tuple(range(1, 14))
    assert plan_layout(HEADER, "F", "AP", ()).scanned[-1] == 14
    assert plan_layout([*HEADER[:5], "", "Emphasis"], "A", "G", ()).attributes["emphasis"] == 7
    with pytest.raises(ValueError, match="Semester/Date"):
        plan_layout(HEADER, "A", "D", ())


def test_scores_and_diagnostics(sheet):
    layout = plan_layout(sheet.header, "F", "M", ("I",))
    rows = read_scores(sheet, layout).orderBy("ord").collect()
    assert [(r.ord, r.student_identifier, r.score_name, str(r.score)) for r in rows[:3]] == [
        (20006, "Ann Lee", "Oral", "4.00000000"), (20007, "Ann Lee", "Acting/Directing Approach", "3.00000000"),
        (20008, "Ann Lee", "Design Approach", "2.00000000"),
    ]
    assert [(r.ord, str(r.score)) for r in rows[7:]] == [
        (30006, "-3.00000000"), (30013, "2.00000000"), (40006, "2.00000000"), (80006, "1000.00000000")]
    assert rows[0].emphasis == "Musical Theatre Applicant"
    assert rows[-1].emphasis == "Musical Theatre"  # the standing is compared exactly
    assert rows[9].semester_sort == "20190" and rows[9].first_name == "Bob"
    found = sorted((r.row_no, r.message) for r in sheet_diagnostics(sheet, layout).collect())
    assert found == [
        (5, "Row 5: Class Standing is missing"), (5, "Row 5: Emphasis is missing"),
        (5, "Row 5: Semester is missing or an unexpected value: 'TBD'; skipping row."),
        (7, "Row 7: First Name is missing"),
    ]


def test_new_students_are_applicants_too(spark):
    row = ["Al", "Day", "3 - Junior", "Musical Theatre", "NEW student Fall 2019", "4", "x"]
    cells = spark.createDataFrame([(2, *row)], ["row_no", *[f"c{i}" for i in range(1, 8)]])
    sheet = Sheet(cells, (*HEADER[:5], "", "x"))
    (score,) = read_scores(sheet, plan_layout(sheet.header, "F", "F", ())).collect()
    assert score.emphasis == "Musical Theatre Applicant" and score.score_name == ""


def test_parquet_sheet_and_csv_round_trip(spark, sheet, tmp_path):
    table = sheet.cells.toDF("row_no", *[f"h{i}" for i in range(1, 15)])
    table.write.parquet(str(tmp_path / "t"))
    again = read_parquet_sheet(spark, str(tmp_path / "t"), "row_no", list(HEADER))
    assert again.header == tuple(HEADER)
    assert sorted(again.cells.collect()) == sorted(sheet.cells.collect())
    numbered = sheet_from_dataframe(
        sheet.cells.select("row_no", F.col("row_no").alias("Row"), "c2", F.lit('say "hi", \\ ').alias("c3")), "row_no",
        ["Row", "Name", "Quote"])
    write_csv_sheet(numbered, str(tmp_path / "c"))
    back = read_csv_sheet(spark, str(tmp_path / "c"), row_no_header="Row")
    assert sorted(back.cells.collect()) == sorted(numbered.cells.collect())


def options(workbook, **extra):
    return JobOptions(str(workbook), "scores", start_column="F", last_column="M", skip_columns=("I",), **extra)


def test_whole_job(spark, workbook, tmp_path):
    out = str(tmp_path / "out")
    report = run(spark, options(workbook, output=out))
    assert report.counts.first().asDict() == {"scores_read": 11, "scores_used": 11}
    cells = {(r.student_identifier, r.score_name, r.semester): r for r in report.cells.collect()}
    last = cells["Ann Lee", "Overall Success", "Fall 2019"]
    assert (last.yours, last.average, last.score_pos, last.semester_pos) == ("3.13", "3.13", 7, 1)
    places = {r.student_identifier: r.student_pos for r in report.cells.collect()}
    assert places == {"Dee Fox": 1, "Ann Lee": 2, "Bob Ray": 3}

    documents = spark.read.json(f"{out}/documents")
    ann = documents.where("student_identifier = 'Ann Lee'").first()
    assert ann.title == "Assessment Scores For Ann Lee"
    assert ann.semesters == ["Fall 2019", "Spring 2020"]
    assert [r.assessment for r in ann.rows][-1] == "Overall Success" and ann.rows[-1].emphasised
    assert ann.rows[1].cells == [["3", "3"], ["N/A"]]
    assert spark.read.parquet(f"{out}/report_cells").count() == len(cells)
    # A second run replaces the first.
    run(spark, options(workbook, output=out, current_semester="Spring 2020"))
    kept = spark.read.parquet(f"{out}/report_cells").select("student_identifier").distinct().collect()
    assert [r.student_identifier for r in kept] == ["Ann Lee"]
    assert spark.read.parquet(f"{out}/run_counts").first().scores_used == 9


def test_validate_only(spark, workbook, tmp_path):
    out = tmp_path / "out"
    report = run(spark, options(workbook, validate_only=True, output=str(out)))
    assert report.cells is None and report.documents is None
    assert sorted(p.name for p in out.iterdir()) == [
        "crowded_blocks", "diagnostics", "ingested", "messages", "run_counts"]


def test_output_must_not_overlap_input(spark, workbook):
    for bad in (str(workbook), str(workbook / "Scores"), str(workbook / "Scores" / "deep")):
        with pytest.raises(ValueError, match="overlaps"):
            run(spark, options(workbook, output=bad))
    refuse_overlap("/a/b", "/a/c", "file:/a/bc")


def test_documents_are_json(spark, scores_of):
    """Positions, empty places and ties in a report."""
    from gradeweave.operators.averages import cohort_average, report_cells, student_score_averages
    from gradeweave.operators.cells import score_cells
    from gradeweave.operators.ordering import global_position, students_by_last_name
    from gradeweave.operators.report import report_grid, report_pivot, student_report

    base = {"first": "Ann", "last": "Lee"}
    rows = [
        {**base, "name": "Overall Success", "semester": "New Student Spring 2019", "sort": "20190", "score": 1},
        {**base, "name": "Oral", "semester": "New Student Fall 2019", "sort": "20190", "score": 2},
        {**base, "name": "Oral", "semester": "New Student Fall 2019", "sort": "20190", "score": 3},
        {"first": "Cy", "last": "Lee", "semester": "New Student Spring 2019", "sort": "20190", "score": 5},
        {"first": "Di", "last": None, "emphasis": None, "score": 5},
        {"first": "Ed", "last": "Kay", "emphasis": None, "score": 4},
    ]
    cells = score_cells(scores_of(rows))
    averages = student_score_averages(cells)
    table = report_cells(averages, cohort_average(cells))
    shown = {(r.student_identifier, r.score_name, r.semester): (r.yours, r.average) for r in table.collect()}
    # The two new-student terms share a cohort; missing emphasis is a cohort of its own.
    assert shown["Ann Lee", "Oral", "New Student Fall 2019"] == ("2.5", "3.33")
    assert shown["Di ", "Oral", "Spring 2019"] == ("5", "4.5")
    positions = students_by_last_name(table)
    assert [r.student_identifier for r in positions.orderBy("student_pos").collect()] == [
        "Di ", "Ed Kay", "Ann Lee", "Cy Lee"]
    grid = report_grid(table)
    documents = {r.student_identifier: json.loads(r.j) for r in
                 student_report(grid, positions).select("student_identifier", F.to_json("rows").alias("j")).collect()}
    assert documents["Ann Lee"] == [
        {"assessment": "Oral", "emphasised": False, "cells": [["N/A"], ["2.5", "3.33"]]},
        {"assessment": "Overall Success", "emphasised": True, "cells": [["1", "1"], ["N/A"]]},
    ]
    wide = {(r.student_identifier, r.score_name): r for r in report_pivot(table).collect()}
    assert wide["Ann Lee", "Oral"]["New Student Fall 2019"] == "2.5"
    assert wide["Ann Lee", "Oral"]["Spring 2019"] == "N/A"
    with pytest.raises(Exception, match="Semester not listed"):
        report_pivot(table, ["Spring 2019"]).collect()

    many = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(1000)).alias("v"), (F.col("id") % 2).alias("hot"))
    placed = global_position(many, ["hot", "v"], "pos")
    by_place = [r.pos for r in placed.orderBy("hot", "v").collect()]
    assert by_place == list(range(1, 1001))


def test_collation_orders_names_as_people_do(spark, scores_of):
    from gradeweave.operators.cells import score_cells
    from gradeweave.operators.averages import student_score_averages
    from gradeweave.operators.ordering import students_by_last_name

    rows = [{"first": "x", "last": n} for n in ("b", "A", "a", "B")]
    averages = student_score_averages(score_cells(scores_of(rows)))
    order = lambda **k: [r.last_name for r in students_by_last_name(averages, **k).orderBy("student_pos").collect()]
    assert order() == ["A", "B", "a", "b"]
    assert order(collation="UNICODE") == ["a", "A", "b", "B"]


def test_earlier_report_survives_a_failure_between_two_tables(spark, workbook, tmp_path, monkeypatch):
    from gradeweave.plans import report_job

    out = tmp_path / "out"
    run(spark, options(workbook, output=str(out)))
    before = {t: sorted(map(str, spark.read.parquet(f"{out}/{t}").collect())) for t in ("report_cells", "run_counts", "ingested")}

    def fails(*_, **__):
        raise RuntimeError("disk full")

    with monkeypatch.context() as m:
        m.setattr(report_job, "write_by_student", fails)
        with pytest.raises(RuntimeError):
            run(spark, options(workbook, output=str(out), current_semester="Spring 2020"))
    assert {t: sorted(map(str, spark.read.parquet(f"{out}/{t}").collect())) for t in before} == before
    assert not [p.name for p in out.iterdir() if p.name.startswith(".")]
    # Only what is checked is replaced by a run that only checks.
    run(spark, options(workbook, output=str(out), current_semester="Spring 2020", validate_only=True))
    assert spark.read.parquet(f"{out}/run_counts").first().scores_used == 9
    assert sorted(map(str, spark.read.parquet(f"{out}/report_cells").collect())) == before["report_cells"]


def test_a_switch_that_was_cut_off_is_undone(spark, tmp_path):
    from gradeweave.sources.outputs import EARLIER, STAGED, recover, replaced_together, write_table

    out = tmp_path / "out"
    table = lambda n: spark.createDataFrame([(n,)], "n int")
    seen = lambda t: spark.read.parquet(f"{out}/{t}").first().n
    with replaced_together(spark, str(out)) as folder:
        write_table(table(1), f"{folder}/a")
        write_table(table(1), f"{folder}/b")
    # As if the machine stopped after the first table was replaced and the second taken away.
    for name, n in ((f"{EARLIER}x/a", 1), (f"{EARLIER}x/b", 1), (f"{STAGED}x/b", 2), ("a", 2)):
        write_table(table(n), str(out / name))
    import shutil
    shutil.rmtree(out / "b")
    recover(spark, str(out))
    assert (seen("a"), seen("b")) == (1, 1) and sorted(p.name for p in out.iterdir()) == ["a", "b"]
    with pytest.raises(ZeroDivisionError):
        with replaced_together(spark, str(out)) as folder:
            write_table(table(3), f"{folder}/a")
            1 / 0
    assert seen("a") == 1
    with replaced_together(spark, str(out)) as folder:
        write_table(table(4), f"{folder}/b")
    assert (seen("a"), seen("b")) == (1, 4) and sorted(p.name for p in out.iterdir()) == ["a", "b"]


def test_output_must_not_overlap_a_table(spark, tmp_path):
    from gradeweave.plans.report_job import inputs_of

    spark.range(3).write.option("path", str(tmp_path / "t")).saveAsTable("overlap_sheet")
    table = JobOptions("default", "OVERLAP_SHEET", source="table", row_no_header="id", output=str(tmp_path / "t" / "out"))
    try:
        assert [f.rpartition("/")[2] for f in inputs_of(spark, table)] == ["t"]
        with pytest.raises(ValueError, match="overlaps"):
            run(spark, table)
    finally:
        spark.sql("DROP TABLE overlap_sheet")


def test_job_orders_students_by_collation(spark, tmp_path):
    folder = tmp_path / "book" / "Sheet1"
    folder.mkdir(parents=True)
    names = [("x", "b"), ("y", "A"), ("z", "a"), ("v", "B"), ("w", "A")]
    lines = [",".join([*HEADER[:5], "Oral", "x"])] + [f"{f},{n},4 - Senior,Acting,Fall 2019,4," for f, n in names]
    (folder / "f.csv").write_text("\n".join(lines))
    plain = Rules(flips=False, dashes=False, misspellings=False)  # such short names are all alike
    order = lambda **k: [r[0] for r in run(spark, JobOptions(
        str(tmp_path / "book"), start_column="F", last_column="F", skip_columns=(), rules=plain, **k)).cells.orderBy("student_pos").select("student_identifier").collect()]
    assert order() == ["y A", "w A", "v B", "z a", "x b"]
    assert order(collation="UNICODE") == ["z a", "y A", "w A", "x b", "v B"]


def test_a_sheet_is_read_in_one_pass(spark, sheet, tmp_path):
    from gradeweave.operators.ingest import sheet_events
    from gradeweave.plans.report_job import run_sheet

    sheet.cells.toDF("row_no", *[f"h{i}" for i in range(1, 15)]).write.parquet(str(tmp_path / "t"))
    stored = read_parquet_sheet(spark, str(tmp_path / "t"), "row_no", list(HEADER))
    layout = plan_layout(stored.header, "F", "M", ("I",))
    events = sheet_events(stored, layout)
    assert events._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    scores = events.where("kind = 'score'").select("ord", "student_identifier", "emphasis", "semester_sort", "score_name", "score")
    assert sorted(map(str, scores.collect())) == sorted(map(str, read_scores(stored, layout).select(scores.columns).collect()))
    found = events.where("kind = 'finding'").select("row_no", "field", "message")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sheet_diagnostics(stored, layout).collect()))
    report = run_sheet(stored, options("unused"))
    for table in (report.diagnostics, report.messages, report.cells, report.crowded):
        assert not [f for f in table.inputFiles() if str(tmp_path) in f]  # all else comes from what was stored
    assert report.ingested.first().asDict() == {"rows_read": 7, "cells_kept": 11, "cells_lost": 0}


def test_crowded_sound_codes_are_told(spark, scores_of):
    from gradeweave.operators.clusters import clusters_and_blocks

    names = ["Bat", "Bad", "bad", "Bet", "Snow", "Batt", "B"]
    identities = spark.createDataFrame([(n, "Lee", 1, i) for i, n in enumerate(names)], "first_name string, last_name string, n long, first_ord long")
    blocks = {(r.part, r.code): (r.names, r.spellings, r.links) for r in clusters_and_blocks(identities)[1].collect()}
    assert blocks["first", "B300"] == (4, 5, 4) and blocks["first", "B000"] == (1, 1, 4) and blocks["last", "L000"] == (1, 1, 0)


def test_pivot_as_a_map_takes_any_number_of_semesters(spark, scores_of):
    from gradeweave.operators.averages import cohort_average, report_cells, student_score_averages
    from gradeweave.operators.cells import score_cells
    from gradeweave.operators.report import report_pivot, report_pivot_map

    rows = [{"first": "Ann", "last": "Lee", "semester": f"Fall {y}", "sort": f"{y}2", "score": y % 5} for y in range(2031, 2000, -1)]
    rows.append({"first": "Ann", "last": "Lee", "name": None, "semester": "Fall 2005", "sort": "20052", "score": 1})
    cells = score_cells(scores_of(rows))
    table = report_cells(student_score_averages(cells), cohort_average(cells))
    old = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        with pytest.raises(Exception, match="pivot"):
            report_pivot(table).collect()
        pairs = F.arrays_zip(F.map_keys("semesters").alias("k"), F.map_values("semesters").alias("v"))
        got = {r.score_name: [tuple(x) for x in r.pairs] for r in report_pivot_map(table).select("score_name", pairs.alias("pairs")).collect()}
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", old)
    assert got == {"Oral": [(f"Fall {y}", str(y % 5)) for y in range(2001, 2032)], None: [("Fall 2005", "1")]}

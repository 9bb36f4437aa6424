"""Wide score sheets: where they are found and how they are read.

A workbook is a folder (or a catalog schema); each sheet in it is a
sub-folder (or table) of CSV or Parquet files. Every cell is read as text.
Header texts may repeat, so cells are addressed by position: ``c1``, ``c2``...
"""

from __future__ import annotations

import csv
import io
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeweave.functions.text import fold_text
from gradeweave.session import materialize

ROW_NO = "row_no"


@dataclass(frozen=True)
class Sheet:
    """``cells`` holds ``row_no`` and text columns ``c1..cN``; ``header[i]`` heads ``c{i+1}``."""

    cells: DataFrame
    header: tuple[str | None, ...]


def cell(position: int) -> str:
    return f"c{position}"


def resolve_sheet_path(spark: SparkSession, workbook: str, sheet_name: str) -> str:
    """Folder of the sheet whose name matches, in any case."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(workbook)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        for status in sorted(fs.listStatus(root), key=lambda s: s.getPath().getName()):
            if fold_text(status.getPath().getName()) == fold_text(sheet_name):
                return status.getPath().toString()
    raise ValueError(f"Sheet {sheet_name} not found in {workbook}")


def resolve_sheet_table(spark: SparkSession, schema: str, sheet_name: str) -> str:
    """Qualified name of the catalog table whose name matches, in any case."""
    for table in spark.catalog.listTables(schema):
        if fold_text(table.name) == fold_text(sheet_name):
            return f"{schema}.{table.name}"
    raise ValueError(f"Sheet {sheet_name} not found in {schema}")


def _require_rows(sheet: Sheet, where: str) -> Sheet:
    if sheet.cells.isEmpty():
        raise ValueError(f"Sheet {where} has no data")
    return sheet


def sheet_from_dataframe(df: DataFrame, row_no: str, header: list[str | None] | None = None) -> Sheet:
    """Sheet over a table. ``header`` gives the header texts where they repeat,
    as table columns cannot; the row number column is not a cell."""
    columns = [c for c in df.columns if c != row_no]
    header = columns if header is None else header
    if len(header) != len(columns):
        raise ValueError(f"{len(header)} header texts for {len(columns)} columns")
    cells = df.select(
        F.col(row_no).cast("bigint").alias(ROW_NO),
        *[F.col(c).cast("string").alias(cell(i)) for i, c in enumerate(columns, 1)],
    )
    return Sheet(cells, tuple(header))


def read_table_sheet(spark: SparkSession, schema: str, sheet_name: str, row_no: str,
                     header: list[str | None] | None = None) -> Sheet:
    table = resolve_sheet_table(spark, schema, sheet_name)
    return numbered_once(_require_rows(sheet_from_dataframe(spark.table(table), row_no, header), table), table)


def read_parquet_sheet(spark: SparkSession, path: str, row_no: str,
                       header: list[str | None] | None = None) -> Sheet:
    return numbered_once(_require_rows(sheet_from_dataframe(spark.read.parquet(path), row_no, header), path), path)


def numbered_once(sheet: Sheet, where: str) -> Sheet:
    """The sheet, unless row numbers are missing, unreadable or given twice:
    every rule about order rests on them."""
    doubtful = sheet.cells.groupBy(ROW_NO).count().where(F.col(ROW_NO).isNull() | (F.col("count") > 1))
    found = [("none" if r[ROW_NO] is None else str(r[ROW_NO]), r["count"]) for r in doubtful.limit(5).collect()]
    if found:
        told = ", ".join(f"{n} ({times} rows)" for n, times in found)
        raise ValueError(f"Row numbers of {where} missing or repeated: {told}")
    return sheet


def read_csv_sheet(spark: SparkSession, path: str, row_no_header: str | None = None,
                   multi_line: bool = False) -> Sheet:
    """Sheet over CSV files that all start with the same header line; see ``read_csv_sheets``."""
    sheets = read_csv_sheets(spark, path, row_no_header, multi_line)
    if len(sheets) > 1:
        raise ValueError(f"Files of {path} have {len(sheets)} different headers")
    return sheets[0]


def read_csv_sheets(spark: SparkSession, path: str, row_no_header: str | None = None,
                    multi_line: bool = False) -> list[Sheet]:
    """Sheets over the CSV files of a folder, one for each different header.

    ``row_no_header`` names the column that holds the row number. Without it
    rows are numbered by file path and line over all files, the first data row
    being 2. A quoted heading may hold line ends; with ``multi_line`` any cell
    may, and files are then read once more.
    """
    lines = _stored_lines(spark, path)
    heads = _headers(lines)
    if not heads:
        raise ValueError(f"Sheet {path} has no data")
    headers = sorted({h.text for h in heads})
    titles = [tuple(t or None for t in next(csv.reader(io.StringIO(h.removeprefix("\ufeff"), newline="")))) for h in headers]
    schemas = [T.StructType([T.StructField(cell(i), T.StringType()) for i in range(1, len(t) + 1)]) for t in titles]
    if multi_line:
        parts = [
            _with_place(spark.read.options(**CSV, header=True, multiLine=True).schema(schema)
                        .csv([unquote(h.file) for h in heads if h.text == text]))
            for text, schema in zip(headers, schemas, strict=True)
        ]
        if row_no_header is None:
            parts = [materialize(p, "sheet-lines") for p in parts]
    else:
        # One row per file, as the driver lists the files anyway.
        known = spark.createDataFrame(
            [(h.file, h.last, headers.index(h.text)) for h in heads], "_file string, _last long, _header int")
        data = lines.join(F.broadcast(known), "_file").where("_start > 0 or _id > _last")
        parts = [
            data.where(F.col("_header") == k)
            .select(F.from_csv("value", ", ".join(f"{c} string" for c in schema.names), CSV).alias("_row"), *PLACE)
            .select("_row.*", *PLACE)
            for k, schema in enumerate(schemas)
        ]
    if row_no_header is None:
        sheets = [Sheet(c, t) for c, t in zip(number_lines(parts), titles, strict=True)]
    else:
        if lost := [t for t in titles if row_no_header not in t]:
            raise ValueError(f"No column {row_no_header} in {path}: {lost[0]}")
        number = lambda t: F.col(cell(t.index(row_no_header) + 1)).try_cast("bigint").alias(ROW_NO)
        sheets = [Sheet(c.select(number(t), *c.drop(*PLACE).columns), t) for c, t in zip(parts, titles, strict=True)]
        numbers = reduce(DataFrame.unionByName, [s.cells.select(ROW_NO) for s in sheets])
        numbered_once(Sheet(numbers, ()), path)
    if all(s.cells.isEmpty() for s in sheets):
        raise ValueError(f"Sheet {path} has no data")
    return sheets


CSV = {"escape": '"', "encoding": "UTF-8"}
#: Where a line comes from: its file, the split's first byte, and a number that grows within the split.
PLACE = ["_file", "_start", "_id"]


def _with_place(lines: DataFrame) -> DataFrame:
    return lines.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _stored_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files that are not blank, read once and stored with their places."""
    lines = spark.read.text(path).where(F.rlike("value", F.lit("[^\\x00-\\x20]")))
    return materialize(_with_place(lines), "sheet-lines")


@dataclass(frozen=True)
class Header:
    file: str
    text: str
    last: int  # the number of its last line


def _headers(lines: DataFrame) -> list[Header]:
    """Every file's header, from the stored lines of its first split; one row per file comes to the driver.

    A header ends where its quotes are closed: with its first line, or else with the next one that has an odd number
    of quotes. One that is never closed is a line.
    """
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    begun = lines.where("_start = 0")
    firsts = begun.groupBy("_file").agg(F.min("_id").alias("first"), F.min_by("value", "_id").alias("text"), F.min_by(odd, "_id").alias("open"))
    found = {r["_file"]: Header(r["_file"], r["text"], r["first"]) for r in firsts.collect()}
    opened = materialize(firsts.where("open").select("_file", "first"), "open-headers")
    if not opened.isEmpty():
        more = begun.join(F.broadcast(opened), "_file")
        ends = more.where(odd & (F.col("_id") > F.col("first"))).groupBy("_file").agg(F.min("_id").alias("last"))
        texts = (
            more.join(F.broadcast(ends), "_file").where("_id <= last").groupBy("_file", "last")
            .agg(F.array_sort(F.collect_list(F.struct("_id", "value"))).alias("lines"))  # the lines of one header
        )
        for r in texts.collect():
            found[r["_file"]] = Header(r["_file"], "\n".join(x["value"] for x in r["lines"]), r["last"])
    return [found[f] for f in sorted(found)]


def number_lines(parts: list[DataFrame]) -> list[DataFrame]:
    """Row numbers in file-path, then line, order over all parts, starting at 2.

    Lines are stored with the file split they come from. Within a split
    the generated ids run on line by line, so a row's place is its distance
    from the split's first id plus the rows of all splits before it. Only
    per-split totals are ordered in one place and broadcast, two numbers per
    split; no line is shuffled.
    """
    split = ["_file", "_start"]
    totals = reduce(DataFrame.unionByName, [
        p.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows")) for p in parts
    ])
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select(
        F.xxhash64(*split).alias("_split"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 2).alias("_shift"),
    ), "sheet-splits")
    numbered = []
    for part in parts:
        placed = part.withColumn("_split", F.xxhash64(*split)).join(F.broadcast(offsets), "_split")
        numbered.append(placed.select((F.col("_id") + F.col("_shift")).alias(ROW_NO), *part.drop(*PLACE).columns))
    return numbered


def write_csv_sheet(sheet: Sheet, path: str) -> None:
    """Export a sheet as CSV files with a header line each."""
    order = [F.col(cell(i)) for i in range(1, len(sheet.header) + 1)]
    (
        sheet.cells.select(*order)
        .toDF(*[h if h is not None else "" for h in sheet.header])
        .write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )

"""A score sheet derived from order tables, for checks and benchmarks.

Each order is one student's form for one semester: the customer is the student
and gives the name and emphasis, the order key picks the planted errors, and up
to seven order lines give the scores. One scored column has no heading, and
some scores have thirteen digits or eight places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeweave.functions.text import NBSP
from gradeweave.sources.sheets import ROW_NO, Sheet, cell

# The vocabulary of the derived sheet.
FIRST_NAMES = (
    "Alison Brent Carla Derek Elaine Gordon Heidi Imogen "
    "Jasper Kirsten Lorenzo Nadine Oscar Paula Rupert Sybil"
).split()
SURNAME_HEADS = "Hal Mor Tan Wex Bri Col Dug Fen Gar Jas Kel Lun Nob Pic Rus Vin".split()
SURNAME_TAILS = "ton berg field worth smith ley man shaw gate dorf kins well".split()
EMPHASES = {
    "BUILDING": "Musical Theatre",
    "AUTOMOBILE": "Generalist",
    "FURNITURE": "Design",
    "HOUSEHOLD": "Acting",
    "MACHINERY": "Education",
}
STANDINGS = {"1": "1 - Freshman", "2": "2 - Sophomore", "3": "3 - Junior", "4": "4 - Senior", "5": "4 - senior"}
# Spellings that differ by such a letter: first names, surnames, standings, emphases.
ALIKE_FIRST, ALIKE_LAST = ("Ilkin", "Ilk\u0131n"), ("Strauss", "Strau\xdf")
ALIKE_STANDINGS, ALIKE_EMPHASES = ("5 - Diploma", "5 - D\u0131ploma"), ("Masswerk", "Ma\xdfwerk")
ATTRIBUTE_HEADERS = ["Row", "First Name", "Last Name", "Class Standing", "Emphasis", "Semester/Date",
                     "Status", "Customer"]
SCORE_HEADERS = ["Oral", None, "Approach", "Approach", "Approach", "Approach", "Overall Success"]
HEADER = (*ATTRIBUTE_HEADERS, *SCORE_HEADERS, "Comments")
FIRST_SCORE_COLUMN = len(ATTRIBUTE_HEADERS) + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (index % len(words) + 1).cast("int"))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def _hits(key: Column, every: int) -> Column:
    return key % every == 0


def _score_text(key: Column, line: int) -> Column:
    q = F.col(f"q{line}").cast("int")
    digits = q.cast("string")
    return (
        F.when(q.isNull(), F.lit(None).cast("string"))
        .when(_hits(key + line, 31), F.lit("n/a"))
        .when(_hits(key + line, 37), F.concat(F.lit("1,0"), (q + 10).cast("string")))
        .when(_hits(key + line, 41), F.concat(digits, F.lit("-")))
        .when(_hits(key + line, 43), F.concat(F.lit("12345678901"), F.lpad(digits, 2, "0")))
        .when(_hits(key + line, 47), F.concat(F.lit("0.000000"), F.lpad(digits, 2, "0")))
        .otherwise(F.concat(F.floor(q / 10).cast("string"), F.lit("."), (q % 10).cast("string")))
    )


def score_sheet_wide(spark: SparkSession, sf_dir: str) -> Sheet:
    lines = range(1, len(SCORE_HEADERS) + 1)
    quantities = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(*[F.max(F.when(F.col("l_linenumber") == n, F.col("l_quantity"))).alias(f"q{n}") for n in lines])
    )
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    forms = (
        table(spark, sf_dir, "orders")
        .join(segments, "o_custkey", "left")
        .join(quantities.hint("merge"), "o_orderkey", "left")  # two fact tables: never a broadcast
    )

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    missing = F.lit(None).cast("string")
    mary_ann = _hits(c, 97)
    other_i, other_s = c % 83 < 2, c % 89 < 2
    first = F.when(mary_ann, F.lit("Mary")).when(other_i, _pick(ALIKE_FIRST, c % 83)).otherwise(_pick(FIRST_NAMES, c))
    surname = F.concat(
        _pick(SURNAME_HEADS, F.shiftright(c, 4)),  # 16 first names
        _pick(SURNAME_TAILS, F.shiftright(c, 8)),  # 16 surname heads
    )
    last = F.when(mary_ann, F.lit("Ann")).when(other_s, _pick(ALIKE_LAST, c % 89)).otherwise(surname)
    nbsp = F.lit(NBSP)
    year = F.year("o_orderdate").cast("string")

    first_cell = (
        F.when(_hits(k, 67) | _hits(k, 61), missing)
        .when(_hits(k, 53), last)
        .when(_hits(k, 179), F.lit("Mary-Ann"))
        .when(_hits(k, 47), F.concat(F.substring(first, 1, 2), F.substr(first, F.lit(4))))
        .when(_hits(k, 59), F.concat(nbsp, first, nbsp))
        .otherwise(first)
    )
    last_cell = (
        F.when(_hits(k, 67), missing)
        .when(_hits(k, 53), first)
        .when(_hits(k, 43), F.concat(last, F.lit("s")))
        .otherwise(last)
    )
    standing = F.when(_hits(k, 73), missing).when(other_i, _pick(ALIKE_STANDINGS, k)).otherwise(
        _lookup(STANDINGS, F.substring("o_orderpriority", 1, 1))
    )
    emphasis = F.when(_hits(k, 71), missing).when(other_s, _pick(ALIKE_EMPHASES, k)).otherwise(_lookup(EMPHASES, F.col("c_mktsegment")))
    semester = (
        F.when(_hits(k, 79), F.lit("TBD"))
        .when(_hits(k, 83), F.concat(F.lit("New Student Fall "), year))
        .when(F.month("o_orderdate") < 7, F.concat(F.lit("Spring "), year))
        .otherwise(F.concat(F.lit("Fall "), year))
    )

    cells = [
        k.cast("string"), first_cell, last_cell, standing, emphasis, semester,
        F.col("o_orderstatus"), F.col("o_custkey").cast("string"),
        *[_score_text(k, n) for n in lines],
        F.col("o_orderpriority"),
    ]
    return Sheet(
        forms.select(k.alias(ROW_NO), *[text.alias(cell(i)) for i, text in enumerate(cells, 1)]),
        HEADER,
    )

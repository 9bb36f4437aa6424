import pytest
from pyspark.sql import functions as F

from gradeweave.functions import numbers as num
from gradeweave.functions import text as txt


def apply(spark, values, build):
    """build(column) for each value, in one job."""
    frame = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in frame.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_semester_sort_key(spark):
    known = {
        "Fall 2019": "20192", "Spring 2019": "20191", "New Student Fall 2019": "20190",
        "new student spring 2019": "20190", "Summer 2019": "Summer 2019", "Fall Term 2019": "2019TERM",
        "fall 2020": "20202", "2019": None, None: None, "Fall 2019_Eric Snow": "Snow2019_ERIC",
    }
    assert apply(spark, list(known), txt.semester_sort_key) == list(known.values())


def test_parse_score(spark):
    known = {
        "1,234.5": "1234.50000000", "3-": "-3.00000000", "+4": "4.00000000", " 4 ": "4.00000000", ".5": "0.50000000",
        "5.": "5.00000000", "3 -": "-3.00000000", "3+": "3.00000000", "-2": "-2.00000000", "\t7\n": "7.00000000",
        "1e2": None, "(3)": None, "$3": None, "- 3": None, "\xa04": None, "abc": None, "": None, "NaN": None,
        "+": None, ".": None, "+3-": None, ",5": None, "1.2.3": None, None: None,
    }
    got = apply(spark, list(known), num.parse_score)
    assert [g if g is None else str(g) for g in got] == list(known.values())


def test_parse_score_precision(spark):
    value = "1234567890123456"
    assert apply(spark, [value], lambda c: num.parse_score(c, 18, 6)) == [None]
    assert str(apply(spark, [value], lambda c: num.parse_score(c, 28, 6))[0]) == value + ".000000"
    assert str(apply(spark, [value + ".12345678"], num.parse_score)[0]) == value + ".12345678"


def test_number_loss(spark):
    known = {"1": None, "0.12345678": None, "0.1234567800": None, "0.123456789": "places", "1" * 20: None, "1" * 21: "large",
             "1,000.000000001-": "places", "+" + "9" * 40: "large"}
    assert apply(spark, list(known), num.number_loss) == list(known.values())


def test_format_mean_rounds_once(spark):
    # 1e11 scores of a total just under half a hundredth each: rounding the mean first would give 0.01.
    known = {("499999999.99999999", 10**11): "0", ("500000000", 10**11): "0.01", ("10", 3): "3.33", ("-2.005", 1): "-2.01",
             ("20", 3): "6.67", ("1234567890123.12345678", 1): "1234567890123.12", ("0", 5): "0", ("-1", 3): "-0.33",
             ("99999999999999999999999.995", 1): "100000000000000000000000"}
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(known)], "i int, t string, n long")
    shown = rows.select("i", num.format_mean(F.col("t").cast("decimal(38,8)"), F.col("n")).alias("x")).orderBy("i").collect()
    assert [r.x for r in shown] == list(known.values())


def test_format_score(spark):
    known = {"2.005": "2.01", "3.125": "3.13", "3.5": "3.5", "4": "4", "10": "10", "0": "0", "100": "100",
             "-2.005": "-2.01", "0.5": "0.5", "0.004": "0"}
    assert apply(spark, list(known), lambda c: num.format_score(c.cast("decimal(38,16)"))) == list(known.values())


def test_clean_and_blank(spark):
    known = {"\xa0Ann\xa0": "Ann", "  a b\t": "a b", "a\xa0b": "a b", " x　": "x", "\x85": "", "": "", None: None}
    assert apply(spark, list(known), txt.clean) == list(known.values())
    assert apply(spark, list(known), txt.is_blank) == [not v for v in known.values()]


def test_clean_agrees_with_pattern(spark):
    """Trimming by the listed characters is trimming of Unicode white space."""
    values = [chr(c) + "x" + chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    by_list = apply(spark, values, lambda c: F.btrim(c, F.lit(txt.WHITE_SPACE)))
    by_pattern = apply(spark, values, lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    assert by_list == by_pattern


def test_full_name(spark):
    frame = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None), (None, None)], "f string, l string")
    got = [r.n for r in frame.select(txt.full_name(F.col("f"), F.col("l")).alias("n")).collect()]
    assert got == ["a b", " b", "a ", " "]


def test_pairwise_rule(spark):
    pairs = {("Wood", "Woods"): True, ("Snow", "Wood"): False, ("Alison", "ALISON"): True, ("Ann", "Joann"): True,
             ("Ben", "Den"): True, ("Ben", "Dan"): False}
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    rule = txt.sounds_or_looks_alike(F.col("a"), F.col("b"))
    both = frame.select("i", rule.alias("x"), txt.within_one_edit(F.col("a"), F.col("b"), True).alias("exact"))
    rows = both.orderBy("i").collect()
    assert [r.x for r in rows] == list(pairs.values())
    assert [r.exact for r in rows] == [True, False, False, False, True, False]


@pytest.mark.parametrize("bad", ["a", "A1", "É"])
def test_column_number(bad):
    from gradeweave.operators.ingest import column_number

    assert [column_number(x) for x in ("A", "I", "Z", "AA", "AP", "BA")] == [1, 9, 26, 27, 42, 53]
    with pytest.raises(ValueError):
        column_number(bad)


def test_fold_changes_one_letter_to_one_letter(spark):
    known = {
        "Strauß": "STRAUß", "Strauss": "STRAUSS", "Ilkın": "ILKıN", "Ilkin": "ILKIN", "éΩя": "ÉΩЯ", "ﬁ ŉ ǰ": "ﬁ ŉ ǰ", "ſ": "ſ",
        "ÿ": "Ÿ", "ẞ": "ẞ", "": "", None: None, "a😀ß\nb": "A😀ß\nB", "σς": "ΣΣ",
    }
    assert apply(spark, list(known), txt.fold) == list(known.values())
    assert [None if x is None else txt.fold_text(x) for x in known] == list(known.values())
    assert apply(spark, list(known), txt.taken_as_same) == list(known.values())


def test_letters_without_capital_stay_apart_in_codes_and_likeness(spark):
    assert apply(spark, ["Strauß", "Strauss", "Ilkın", "Ilkin", "ſnow"], txt.sound_code) == ["S360", "S362", "I425", "I425", "N000"]
    alike = lambda a, b: apply(spark, [a], lambda c: txt.sounds_or_looks_alike(c, F.lit(b)))[0]
    assert not alike("Strauß", "Strauss") and alike("Ilkın", "Ilkin") and alike("STRAUß", "straußen")
    assert apply(spark, ["ß"], lambda c: txt.within_one_edit(c, F.lit("s"))) == [True]  # one letter against another
    assert apply(spark, ["ß"], lambda c: txt.within_one_edit(c, F.lit("ss"))) == [False]


def test_fold_tells_kept_letters_without_a_pattern(spark):
    """F1 to F3: a pattern of all kept letters took most of the time of reading a sheet."""
    frame = spark.createDataFrame([("x",)], "x string")
    plan = frame.select(txt.fold(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan
    stand_in = chr(0xE000)  # kept, as the text holds no kept letter
    known = {"stra\xdfe": "STRA\xdfE", "\xe9a": "\xc9A", stand_in + "a": stand_in + "A", "": "", None: None}
    known |= {c + "a": c + "A" for c in txt.KEPT_LETTERS}
    assert apply(spark, list(known), txt.fold) == list(known.values())


def test_reading_rows_keeps_methods_to_what_the_jvm_compiles(spark):
    from gradeweave.session import METHOD_BYTES, METHOD_SETTING, bound_methods

    given = spark.conf.get(METHOD_SETTING, "65535")
    try:
        for before, after in (("65535", str(METHOD_BYTES)), ("30000", "30000")):
            spark.conf.set(METHOD_SETTING, before)
            bound_methods(spark)
            assert spark.conf.get(METHOD_SETTING) == after
    finally:
        spark.conf.set(METHOD_SETTING, given)

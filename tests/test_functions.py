"""Scalar functions on hand cases."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarryline.functions import keys, numbers, periods, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


def many(spark, cases, make, kind="string"):
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], f"n int, x {kind}")
    return [r["y"] for r in rows.select("n", make(F.col("x")).alias("y")).orderBy("n").collect()]


def test_keys(spark):
    assert many(spark, ["0001234567-20-000012", "123456720000012", " 0001234567-20-000012 ", None], keys.accession_key) == ["000123456720000012"] * 3 + [None]
    assert many(spark, ["us-gaap:NetIncomeLoss", "US-GAAP:NETINCOMELOSS", "us-gaap_NetIncomeLoss", "us-gaap/NetIncomeLoss", "Net Income Loss"], keys.concept_key) == ["netincomeloss"] * 5
    assert many(spark, ["$abc", "NYSE: ABC", "Abc "], keys.ticker_key) == ["ABC"] * 3
    assert many(spark, ["10-K", "10K", "Form 10-K", "10‑k", "10 K"], keys.form_key) == ["10K"] * 5
    assert one(spark, "10-K/A", keys.form_key) == "10K/A"
    assert many(spark, ["Item 1A", "1a", " 01A.", "ITEM 1A."], keys.item_key) == ["1A"] * 4
    assert many(spark, ["I.2", "Part I, Item 2", "item i.2."], keys.item_key) == ["I2"] * 3
    assert many(spark, ["annual_reports", "Annual Reports", " annual-reports"], keys.source_key) == ["annualreports"] * 3


@pytest.mark.parametrize(
    "printed,value",
    [("1,234.5", "1234.5"), ("$ (12)", "-12"), ("($12)", "-12"), ("−7", "-7"), ("—", "0"), ("()", "0"), ("1 234", "1234"), ("12%", None), ("", None), (None, None), ("abc", None), (".5", "0.5"), ("5.", "5"), ("1-2", None)],
)
def test_parse_number(spark, printed, value):
    assert one(spark, printed, numbers.parse_number) == (None if value is None else Decimal(value))


def test_scales(spark):
    assert many(spark, ["(In thousands, except per share data)", "in millions and billions", "dollars", None, "x except in millions"], numbers.caption_scale) == [3, None, None, None, None]
    assert many(spark, ["12.5%", "abc", "—", "(3)", None], numbers.is_value) == [True, False, False, True, False]
    assert one(spark, Decimal("1.5"), lambda c: numbers.apply_scale(c, F.lit(6)), "decimal(38,6)") == 1500000
    assert one(spark, Decimal("9" * 30), lambda c: numbers.apply_scale(c, F.lit(9)), "decimal(38,6)") is None


def test_figures(spark):
    got = one(spark, "Revenue was $1,200 million, up 12.5%, loss (3) and 4 thousand", numbers.figures)
    assert [(x["value"], x["percent"]) for x in got] == [(Decimal(1200000000), False), (Decimal("12.5"), True), (Decimal(-3), False), (Decimal(4000), False)]
    assert one(spark, "", numbers.figures) == [] and one(spark, None, numbers.figures) is None


def test_comparisons(spark):
    df = spark.createDataFrame([(Decimal(100), Decimal("100.4")), (Decimal(0), Decimal(0)), (Decimal(1), Decimal(0)), (Decimal(-100), Decimal(100))], "a decimal(38,6), b decimal(38,6)")
    assert [r[0] for r in df.select(numbers.within(F.col("a"), F.col("b"), 0.5)).collect()] == [True, True, False, True]
    lo, hi = one(spark, "12.3", lambda c: numbers.printed_interval(c, F.lit(6)))
    assert (lo, hi) == (12250000, 12350000) and one(spark, "5", lambda c: numbers.printed_interval(c, F.lit(6))) is None


def test_text(spark):
    assert one(spark, "Net-revenue of $1,234.50 in Q3!", text.tokens) == ["net-revenue", "of", "1234.50", "in", "q3"]
    assert one(spark, "Don't, stop - (A&B)!", text.phrase_key) == "dont stop - (a&b)"
    assert one(spark, "Page  12 of 300", text.digit_key) == "Page # of #"
    assert one(spark, "It rose. Then 5 fell! ok. Done", text.sentences) == ["It rose.", "Then 5 fell! ok.", "Done"]
    assert many(spark, ["ab1 ", "", None], text.letters_share) == [0.5, 0.0, 0.0]
    assert one(spark, "[head]\nbody", text.excerpt) == "body" and one(spark, "a@b.co in /home/me/x", text.redacted) == "<mail> in <home>/x"
    assert one(spark, '```json\n{"k": 3}\n```', lambda c: text.json_with_keys(c, "k int", ["k"])["k"]) == 3
    assert one(spark, '{"k": 3, "z": 1}', lambda c: text.json_with_keys(c, "k int", ["k"])) is None
    assert many(spark, ["ask ABC now", "abcd", "x.abc."], lambda c: text.has_word(c, F.lit("ABC"))) == [True, False, True]


def test_periods(spark):
    assert [str(d) for d in one(spark, "On May 5, 2020 and Feb 30, 2020, then 2019-12-31 and Sept 1, 2018", periods.dates_in)] == ["2020-05-05", "2019-12-31", "2018-09-01"]
    df = spark.sql("SELECT * FROM VALUES (null, date'2020-01-01'), (date'2019-01-01', date'2019-12-31'), (date'2020-01-01', date'2020-03-31'), (date'2020-01-01', date'2020-06-30'), (date'2020-01-01', date'2020-01-05') AS t(a, b)")
    assert [r[0] for r in df.select(periods.period_kind(F.col("a"), F.col("b"))).collect()] == ["instant", "annual", "quarter", "ytd", "other"]
    assert many(spark, ["Q3", "FY", " q1 ", None], periods.fiscal_quarter) == [3, None, 1, None]


def test_scale_keeps_fractions(spark):
    df = spark.createDataFrame([(1, Decimal("1.234567")), (2, None), (3, Decimal("-2500"))], "i int, v decimal(38,6)")
    got = {r["i"]: r["x"] for r in df.select("i", numbers.apply_scale(F.col("v"), F.lit(-3), "decimal(38,9)").alias("x")).collect()}
    assert got == {1: Decimal("0.001234567"), 2: None, 3: Decimal("-2.5")}

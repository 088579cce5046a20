import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from plumbline.functions import dates, scoring, text

from .helpers import indel


def one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_title_case_follows_python(spark):
    values = ["acme SUPPLY", "O'Neil mc-donald", "a1b", "über straße", "", "Ünal Öz", None]
    expected = [v.title() if v is not None else None for v in values]
    assert one(spark, values, text.title_case(F.col("v"))) == expected
    wrong = one(spark, values, text.not_title_case(F.col("v")))
    assert wrong == [None if v is None else v != v.title() for v in values]


def test_strip_follows_python(spark):
    values = [" a ", "\ta\n", "a", "", "  ", " é　", "é", "a b", None, "\x1fa"]
    expected = [v.strip() if v is not None else None for v in values]
    assert one(spark, values, text.strip(F.col("v"))) == expected


@pytest.mark.parametrize("value, expected", [
    ("12", 12.0), (" 12.5 ", 12.5), ("1e3", 1000.0), ("-.5", -0.5), ("12d", None), ("$5", None),
    ("", None), ("abc", None), (None, None), ("inf", None)])
def test_number_of_text(spark, value, expected):
    assert one(spark, [value], text.number(F.col("v"), T.StringType())) == [expected]


def test_nan_is_null(spark):
    assert one(spark, [1.5, float("nan"), None], text.number(F.col("v"), T.DoubleType()),
               "double") == [1.5, None, None]


def test_money(spark):
    assert one(spark, ["$1,234.50", "7", "x"], text.money(F.col("v"))) == [1234.5, 7.0, None]


@pytest.mark.parametrize("value, expected", [
    ("2024-02-29", dt.date(2024, 2, 29)), ("2/9/2024", dt.date(2024, 2, 9)),
    ("31-12-2009", dt.date(2009, 12, 31)), ("2024/03/01", dt.date(2024, 3, 1)),
    (" 2024-01-05 ", dt.date(2024, 1, 5)), ("2023-02-30", None), ("13/13/2024", None),
    ("2024-01-05 10:00", None), ("20240105", None), ("", None), (None, None)])
def test_parse_date(spark, value, expected):
    assert one(spark, [value], dates.parse_date(F.col("v"))) == [expected]


def test_long_dates_only_on_request(spark):
    values = ["March 5, 2021", "Foo 5, 2021"]
    assert one(spark, values, dates.parse_date(F.col("v"))) == [None, None]
    assert one(spark, values, dates.parse_date(F.col("v"), long_form=True)) == [
        dt.date(2021, 3, 5), None]


def test_indel_ratio_matches_dynamic_programming(spark):
    pairs = [("kitten", "sitting"), ("abc", "abc"), ("", "a"), ("a" * 70, "a" * 69 + "b"),
             ("Customer#000000001", "Customer#000000012"), ("çé", "éç")]
    df = spark.createDataFrame(pairs + [(None, "x")], "a string, b string")
    got = [r[0] for r in df.select(text.indel_ratio("a", "b")).collect()]
    assert got[:-1] == pytest.approx([indel(a, b) for a, b in pairs]) and got[-1] is None


def test_bands(spark):
    rates = [0.0, 0.049, 0.05, 0.099, 0.10, 0.299, 0.30, 1.0]
    assert one(spark, rates, scoring.severity_of_rate(F.col("v")), "double") == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL"]
    scores = [0.0, 24.9, 25.0, 50.0, 70.0, 85.0, 90.0]
    assert one(spark, scores, scoring.severity_of_score(F.col("v")), "double") == [
        "CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "LOW", "OK", "OK"]
    assert one(spark, scores, scoring.score_label(F.col("v")), "double") == [
        "CRITICAL", "CRITICAL", "POOR", "FAIR", "GOOD", "GOOD", "EXCELLENT"]
    assert one(spark, scores, scoring.gate(F.col("v")), "double") == ["FAIL"] * 5 + ["PASS"] * 2

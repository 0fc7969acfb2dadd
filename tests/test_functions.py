import math
from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wattloom.functions.coercion import is_blank, or_one, or_zero, to_number
from wattloom.functions.dates import parse_record_date
from wattloom.functions.hashing import gaussian, uniform
from wattloom.functions.rounding import (
    exact_round,
    fixed_digits,
    floor_divide,
    half_up,
    js_round,
)

def x():
    return F.col("x")


def column(spark, values, expression, schema="x double"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_js_round_golden(spark):
    values = [2.675, 1.005, 0.125, -2.5, None, 1e300]
    assert column(spark, values, js_round(x())) == [2.68, 1.0, 0.13, -2.5, None, 1e300]
    assert math.isnan(column(spark, [float("nan")], js_round(x()))[0])


def test_half_up_ties_go_up(spark):
    values = [2.5, -2.5, 0.49999999999999994, -0.5, 4503599627370497.0]
    assert column(spark, values, half_up(x())) == [3.0, -2.0, 0.0, 0.0, 4503599627370497.0]


floats = st.floats(min_value=-1e9, max_value=1e9)
grid = st.integers(-10**8, 10**8).map(lambda n: n / 1000)
several = settings(max_examples=8, deadline=None,
                   suppress_health_check=list(HealthCheck))


@several
@given(values=st.lists(floats | grid, min_size=200, max_size=300))
def test_exact_round_is_python_round(spark, values):
    for digits in (2, 4):
        expected = [round(v, digits) for v in values]
        assert column(spark, values, exact_round(x(), digits)) == expected


@several
@given(values=st.lists(floats.map(abs) | grid.map(abs), min_size=200, max_size=300))
def test_fixed_digits_rounds_the_exact_value_half_up(spark, values):
    expected = [float(Decimal(v).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert column(spark, values, fixed_digits(x(), 2)) == expected


@several
@given(pairs=st.lists(st.tuples(
    st.floats(-1e6, 1e6, allow_subnormal=False),
    st.floats(0.001, 1e4) | st.floats(-1e4, -0.001)), min_size=200, max_size=300))
def test_floor_divide_is_python_floor_division(spark, pairs):
    pairs = [(a, b) for a, b in pairs if a == 0 or abs(a) > 1e-9] + [(1.0, 0.1), (6.0, 2.0)]
    found = column(spark, pairs, floor_divide(x(), F.col("y")), "x double, y double")
    assert found == [a // b for a, b in pairs]


def test_floor_divide_by_zero_is_null(spark):
    assert column(spark, [(1.0, 0.0)], floor_divide(x(), F.col("y")), "x double, y double") == [None]


def test_to_number(spark):
    texts = {"5": 5.0, " 5 ": 5.0, "-2.50": -2.5, ".5": 0.5, "5.": 5.0, "1e3": 1000.0,
             "+7": 7.0, "": None, "  ": None, "abc": None, "5d": None, "Infinity": None,
             "NaN": None, "0x10": None, "1e": None, "12,5": None, "1 2": None, "--3": None}
    found = column(spark, list(texts), to_number(x()), "x string")
    assert found == list(texts.values())
    blank = column(spark, ["", "  ", None, "0"], is_blank(x()), "x string")
    assert blank == [True, True, True, False]


def test_defaults_for_empty_numbers(spark):
    values = [None, float("nan"), 0.0, 2.0]
    assert column(spark, values, or_zero(x())) == [0.0, 0.0, 0.0, 2.0]
    assert column(spark, values, or_one(x())) == [1.0, 1.0, 1.0, 2.0]


def dates(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, d string")
    return parse_record_date(df, "d", "iso", "at").orderBy("i").collect()


GOOD_DATES = [
    "2024-01-05", "20240105", "2024-01-05T10:20", "2024-01-05 10:20:30", "2024-01-05T10",
    "2024-01-05T10:20:30.5", "2024-01-05T10:20:30.123456", "2024-01-05T10:20:30+05:30",
    "2024-01-05T10:20:30-08:00", "2024-01-05T10:20:30Z", "20240105T102030", "20240105T1020+0530",
    "2024-W05", "2024W05", "2024-W05-3", "2024W053", "2024-W05-3T10:20", "2020-W53-7",
    "2026-W01-1", "2024W053T1020Z", "2024-02-29", "2024-01-05T10:20:30,25", "2024-01-05x10:20", "2024-01-05T10:20:30+05",
]
BAD_DATES = ["", "2024", "2024-01", "2024-13-01", "2023-02-29", "05/01/2024", "2024-01-05T25:00",
             "2024-01-05T10:61", "yesterday", "2024-01-05T10:20:30+24:00", "0000-01-01",
             "20241301", "2021-W53-1", "2024-W00-1", "2024-W05-8", "2024-W5", "2024-W051",
             "0000-W10", "2024-01-05T1", "2024-01-05 10:20 pm"]


def test_good_dates_agree_with_python(spark):
    for text, row in zip(GOOD_DATES, dates(spark, [f"  {t} " for t in GOOD_DATES])):
        moment = datetime.fromisoformat(text)
        assert row["iso"] == moment.isoformat(), text
        if moment.tzinfo:
            moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
        assert row["at"] == moment, text


def test_unpadded_date(spark):
    assert dates(spark, ["2024-1-5"])[0]["iso"] == "2024-01-05T00:00:00"


@pytest.mark.parametrize("text", [*BAD_DATES, None])
def test_bad_dates_are_null(spark, text):
    row = dates(spark, [text])[0]
    assert row["iso"] is None and row["at"] is None


def test_randomness_depends_on_the_key_only(spark):
    df = spark.range(2000).select(F.col("id"), uniform(F.col("id"), "s").alias("u"),
                                  gaussian(F.col("id"), "s").alias("g"))
    one = {r["id"]: (r["u"], r["g"]) for r in df.collect()}
    other = {r["id"]: (r["u"], r["g"]) for r in df.repartition(7).collect()}
    assert one == other
    mean = sum(u for u, _ in one.values()) / 2000
    spread = math.sqrt(sum(g * g for _, g in one.values()) / 2000)
    assert abs(mean - 0.5) < 0.03 and abs(spread - 1) < 0.06

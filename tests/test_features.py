import pytest
from pyspark.sql import functions as F

from wattloom.constants import FEATURE_SPECS, TARGET
from wattloom.operators import features, profile


def test_feature_order_formats(spark, tmp_path):
    assert features.parse_feature_order('{"feature_order": ["a", "b"]}') == ["a", "b"]
    (tmp_path / "order.json").write_text('[\n "a"\n]')
    assert features.load_feature_order(spark, str(tmp_path / "order.json")) == ["a"]
    for bad in ('{"x": 1}', '"a"'):
        with pytest.raises(ValueError):
            features.parse_feature_order(bad)


def test_select_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], f"b double, a double, {TARGET} double")
    assert features.select_features(df, ["a", TARGET, "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing"):
        features.select_features(df, ["a", "c"])


@pytest.mark.parametrize("kind", ["double", "string"])
def test_city_one_hot(spark, kind):
    codes = [1, 2, 3, 4, 0, 5, None]
    values = [(None if c is None else float(c) if kind == "double" else str(c),) for c in codes]
    df = spark.createDataFrame(values, f"city_code {kind}")
    rows = features.city_one_hot(df).collect()
    letters = "".join(c for r in rows for c in "ABCD" if r[f"City_City_{c}"] == 1.0)
    assert letters == "ABCDAAA"


FORM = ("total_appliance_power string, avg_power_per_appliance string, appliance_count string, "
        "NetBill string, GridConsumption_kWh string, TariffRate string, MonthlyHours string, "
        "AirConditioner string")
OUT = ["total_appliance_power", "NetBill", "MonthlyHours", "avg_power_per_appliance"]


@pytest.mark.parametrize("form,force,expected", [
    (("", "12.345", "3", "", "", "", "", ""), False, (37.04, None, 240.0, 12.345)),
    (("", "", "", "", "", "", "", ""), False, (None, None, 240.0, None)),
    (("100", "", "3", "", "", "", "", "1"), False, (100.0, None, 300.0, 33.33)),
    (("", "", "4", "", "10", "", "5", "0"), False, (None, 0.0, 5.0, 0.0)),
    (("", "", "0", "", "10", "2.5", "5", ""), False, (None, 25.0, 5.0, None)),
    (("7", "10", "2", "9", "10", "3", "5", "2"), False, (7.0, 9.0, 5.0, 10.0)),
    (("7", "10", "2", "9", "10", "3", "5", "2"), True, (20.0, 30.0, 300.0, 10.0)),
    (("7", "0", "2", "9", "", "3", "5", ""), True, (7.0, 9.0, 240.0, 3.5)),
    (("0", "10", "2", "0", "10", "3", "0", ""), False, (0.0, 0.0, 0.0, 10.0)),
    (("", "x", "2", "", "x", "3", "x", "x"), False, (None, None, None, None)),
])
def test_autofill(spark, form, force, expected):
    row = features.autofill(spark.createDataFrame([form], FORM), force).first()
    if form[1] == "x":
        # The mean field is not blank, so it stays as it is: unreadable.
        expected = (None, None, None, None)
    assert tuple(row[c] for c in OUT) == expected


def test_autofill_takes_numbers_as_well_as_text(spark):
    df = spark.createDataFrame(
        [(None, 10.0, 4.0, 100.0, 2.0)],
        "total_appliance_power double, avg_power_per_appliance double, appliance_count double, "
        "GridConsumption_kWh double, TariffRate double")
    row = features.autofill(df).first()
    assert [row[c] for c in OUT] == [40.0, 200.0, 240.0, 10.0]


def test_net_bill(spark):
    df = spark.createDataFrame(
        [("5", "10", "2"), ("", "10", "2.345"), (None, "", "2"), (" ", "10", "")],
        "NetBill string, GridConsumption_kWh string, TariffRate string")
    assert [r["net_bill"] for r in features.net_bill(df).collect()] == [5.0, 23.45, 0.0, 0.0]


def test_assemble_smoke_vector(spark):
    """A few named values, all others 0."""
    df = spark.createDataFrame(
        [("300", "50", "250", "5.0", "1", "1")],
        "MonthlyHours string, SolarGeneration_kWh string, GridConsumption_kWh string, "
        "TariffRate string, Fan string, AirConditioner string")
    row = features.assemble_vector(df, "v16").first()
    named = dict(zip(FEATURE_SPECS["v16"], row["features"]))
    assert {k: v for k, v in named.items() if v} == {
        "Fan": 70.0, "AirConditioner": 1200.0, "MonthlyHours": 300.0,
        "SolarGeneration_kWh": 50.0, "GridConsumption_kWh": 250.0, "TariffRate": 5.0,
        "NetBill": 1250.0, "City_City_A": 1.0}


def test_assemble_alias_and_modes(spark):
    df = spark.createDataFrame(
        [("", "75", "x", "2", "power"), ("60", "75", "3", "2", "count"), ("y", "75", "3", "", "")],
        "total_appliance_power string, TotalAppliancePower string, appliance_count string, "
        "Fan string, Fan__mode string")
    rows = features.assemble_vector(
        df, ["total_appliance_power", "appliance_count", "Fan"]).collect()
    assert [r["features"] for r in rows] == [[75.0, 0.0, 2.0], [60.0, 3.0, 140.0], [0.0, 3.0, 0.0]]


def test_label_encode(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "city string")
    found = features.label_encode(df, {"city": "code"}).collect()
    assert sorted((r["city"] or "", r["code"]) for r in found if r["city"]) == [
        ("a", 0.0), ("a", 0.0), ("b", 1.0), ("c", 2.0)]
    assert [r["code"] for r in found if r["city"] is None] == [None]


def test_standardize_uses_population_deviation(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = features.scaler_stats(train, ["a", "b"])
    assert stats.std == {"a": 1.0, "b": 0.0}
    rows = features.standardize(train, stats).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


def test_noise_and_clip(spark):
    df = spark.range(5000).select("id", F.lit(1.0).alias(TARGET))
    noisy = features.add_noise(df, "id")
    again = features.add_noise(df.repartition(9), "id")
    assert sorted(noisy.collect()) == sorted(again.collect())
    spread = noisy.agg(F.stddev(TARGET)).first()[0]
    assert spread == pytest.approx(5.0, abs=0.2)
    clipped = features.clip_target(noisy)
    assert clipped.agg(F.min(TARGET)).first()[0] == 0.0
    zeros = profile.count_zero_target(clipped).first()["zeros"]
    assert zeros == noisy.filter(F.col(TARGET) <= 0).count()
    assert profile.zero_target_rows(clipped).count() == zeros


def test_clean_training(spark):
    nan = float("nan")
    rows = [(1.0, 2.0, 3.0), (None, 2.0, 3.0), (nan, 2.0, 3.0), (-1.0, 2.0, 3.0),
            (1.0, 2.0, None), (1.0, -2.0, 3.0)]
    df = spark.createDataFrame(rows, f"MonthlyHours double, other double, {TARGET} double")
    kept = features.clean_training(df, ["MonthlyHours", "other"])
    assert [tuple(r) for r in kept.collect()] == [(1.0, 2.0, 3.0), (1.0, -2.0, 3.0)]


def test_energy_balance(spark):
    df = spark.createDataFrame([(50.0, 100.0), (30.0, 20.0), (5.0, 0.0), (None, 4.0)],
                               "gen double, use double")
    df = features.surplus_energy(features.solar_offset(df, "gen", "use"), "gen", "use")
    rows = df.select("solar_offset_pct", "surplus_kwh", "grid_need_kwh").collect()
    assert [tuple(r) for r in rows] == [
        (50.0, 0.0, 50.0), (100.0, 10.0, 0.0), (None, 5.0, 0.0), (None, 0.0, 4.0)]


def test_units_and_bill(spark):
    df = spark.createDataFrame(
        [(500.0, "Wh"), (2.0, "kWh"), (0.5, "MWh"), (1.0, "J"), (None, "kWh")],
        "value double, unit string")
    rows = features.units_to_kwh(df).collect()
    assert [r["kwh"] for r in rows] == [0.5, 2.0, 500.0, None, None]
    assert [r["reason"] for r in rows] == [
        None, None, None, "unknown unit", "value is missing"]
    bill = features.predicted_bill(df.withColumn("TariffRate", F.lit(3.333)), "value")
    assert bill.first()["predicted_bill"] == 1666.5


def test_thresholds_and_outliers(spark):
    rows = [(float(i), 240.0 + i, 10.0 * i) for i in range(101)]
    df = spark.createDataFrame(
        rows, "GridConsumption_kWh double, MonthlyHours double, total_appliance_power double")
    limits = profile.thresholds(df)
    assert (limits.grid_p95, limits.grid_p99, limits.total_power_p99) == (95.0, 99.0, 990.0)
    assert (limits.monthly_min, limits.monthly_max) == (240.0, 340.0)
    flagged = profile.outlier_flags(df, limits)
    assert flagged.filter("grid_above_p95").count() == 5
    assert flagged.filter("grid_above_p99").count() == 1
    assert flagged.filter("hours_outside").count() == 0


def test_describe_agrees_with_pandas(spark):
    df = spark.createDataFrame([(float(v),) for v in (3, 1, 4, 1, 5, 9, 2, 6)], "v double")
    expected = df.toPandas()["v"].describe()
    row = profile.describe(df, ["v"]).first()
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    assert [row[n] for n in names] == pytest.approx(list(expected))

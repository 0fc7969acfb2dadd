import pytest
from pyspark.sql import functions as F

from wattloom import schemas
from wattloom.operators import history, registry, validation
from wattloom.runtime import scratch_path
from wattloom.sources import sinks, tables

HOUSEHOLDS = [
    ("  h1 ", "2024-01-05", {"Fan": 1.0}, 3.0),
    ("h2", "2024-02-05T10:00:00+05:30", {}, 3.0),
    ("  ", "2024-01-05", {"Fan": 1.0}, 3.0),
    (None, "2024-01-05", {"Fan": 1.0}, 3.0),
    ("h3", "2024", {"Fan": 1.0}, 3.0),
    ("h4", "2024-01-05", {"Fan": -1.0}, 3.0),
    ("h5", "2024-01-05", {"Fan": float("nan")}, 3.0),
    ("h6", "2024-01-05", {"Fan": None}, 3.0),
    ("h7", "2024-01-05", None, 3.0),
    ("h8", "2024-01-05", {"Fan": 0.0}, None),
    ("h9", "2024-01-05", {"Fan": 0.0}, -3.0),
]


def test_validate_household(spark):
    checked = validation.validate_household(spark.createDataFrame(HOUSEHOLDS, schemas.HOUSEHOLD))
    accepted, rejected = validation.split_valid(checked)
    assert {(r["house_id"], r["date"]) for r in accepted.collect()} == {
        ("h1", "2024-01-05T00:00:00"), ("h2", "2024-02-05T10:00:00+05:30"),
        ("h9", "2024-01-05T00:00:00")}
    assert rejected.count() == 8
    assert rejected.filter(F.col("reason").isNull()).count() == 0


def test_ingest_and_read_back(spark):
    path = scratch_path(spark, "households")
    records = spark.createDataFrame(HOUSEHOLDS, schemas.HOUSEHOLD)
    sinks.ingest_households(records, path)
    sinks.ingest_households(records.limit(1), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 12
    assert stored.filter("outcome = 'accepted'").count() == 4
    assert {r["month"] for r in stored.filter("house_id = 'h2'").collect()} == {"2024-02"}
    assert history.household_by_id(stored, "h1").count() == 2
    assert history.household_by_id(stored, "nobody").count() == 0


def test_validate_vector(spark):
    rows = [("linear", ["1", "2.5"]), ("other", ["1", "2"]), ("rf", ["1", "x"]),
            ("rf", ["1"]), ("rf", ["1", None]), (None, ["1", "2"])]
    df = spark.createDataFrame(rows, "model string, features array<string>")
    reasons = [r["reason"] for r in validation.validate_vector(df, ["linear", "rf"], 2).collect()]
    assert reasons == [None, "model not available", "feature is not a number",
                       "wrong number of features", "feature is not a number",
                       "model not available"]
    loose = validation.validate_vector(df, ["linear", "rf"], None).collect()
    assert loose[3]["reason"] is None


@pytest.fixture(scope="module")
def forms(spark):
    rows = [(1, "", "5", "", "x"), (2, "300", "5", "", "2"), (3, "745", "abc", "-1", "1"),
            (4, "-1", None, "5", ""), (5, "744", "200", "0", "0")]
    return spark.createDataFrame(
        rows, "row_id long, MonthlyHours string, TariffRate string, NetBill string, Other string")


def test_validate_fields(forms):
    names = ["MonthlyHours", "TariffRate", "NetBill", "Other", "Fan"]
    outcomes = validation.validate_fields(forms, names)
    found = {(r["row_id"], r["field"]): r["status"] for r in outcomes.collect()}
    assert len(found) == 25
    bad = {k: v for k, v in found.items() if v != "ok"}
    assert bad == {(1, "MonthlyHours"): "error", (3, "MonthlyHours"): "warning",
                   (3, "TariffRate"): "error", (3, "NetBill"): "error",
                   (4, "MonthlyHours"): "error", (4, "TariffRate"): "error"}
    message = outcomes.filter("row_id = 3 and field = 'MonthlyHours'").first()["message"]
    assert message == "seems high, at most 744 expected"


def test_blocked_rows_agree_with_field_outcomes(forms):
    blocked = {r["row_id"] for r in validation.blocked_rows(forms).collect()}
    assert blocked == {1, 3, 4}
    outcomes = validation.validate_fields(forms)
    grouped = validation.blocked_from_outcomes(outcomes).filter("blocked")
    assert {r["row_id"] for r in grouped.collect()} == blocked


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "h", 10, "a", 50.0), (2, "h", 20, "a", 50.0), (3, "h", 20, "b", 20.0),
            (4, "k", 15, "b", 700.0)]
    return spark.createDataFrame(
        rows, "_id long, house_id string, timestamp long, model string, predicted_value_kwh double")


def test_prediction_history(log):
    assert [r["_id"] for r in history.prediction_history(log).collect()] == [3, 2, 4, 1]
    assert [r["_id"] for r in history.prediction_history(log, 1, "a").collect()] == [2]
    assert history.prediction_history(log, 1000, "").count() == 4
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            history.prediction_history(log, limit)
    plan = history.prediction_history(log)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_delta_gauge_and_band(log):
    linked = history.delta_vs_last(log).withColumn(
        "gauge", history.gauge_pct(F.col("predicted_value_kwh"), F.col("last_kwh"))).withColumn(
        "band", history.prediction_band(F.col("predicted_value_kwh")))
    found = {r["_id"]: (r["delta_kwh"], r["direction"], r["gauge"], r["band"])
             for r in linked.collect()}
    assert found == {1: (None, None, 60.0, "green"), 2: (0.0, "up", 60.0, "green"),
                     3: (-30.0, "down", 30.0, "green"), 4: (None, None, 60.0, "red")}


def test_gauge_without_usable_last_value(spark):
    df = spark.createDataFrame([(200.0, 0.0), (200.0, 1.0), (0.5, None), (100.5, 100.0)],
                               "v double, last double")
    found = [r[0] for r in df.select(history.gauge_pct(F.col("v"), F.col("last"))).collect()]
    assert found == [60.0, 100.0, 35.0, 60.0]


def test_chart_series(spark):
    df = spark.createDataFrame(
        [(1, "2024-03-01", None, 1.0, 9.0), (2, "", "2024-02-01 10:00:00", None, 2.0),
         (3, None, None, None, None), (4, None, "2024-02-01 09:00:00", 0.0, 5.0)],
        "_id long, date string, t string, predicted_kwh double, estimated_kwh double",
    ).withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    rows = history.chart_series(df).orderBy("position").collect()
    assert [(r["_id"], r["label"], r["kwh"]) for r in rows] == [
        (3, "-", 0.0), (4, "2024-02-01", 0.0), (2, "2024-02-01", 2.0), (1, "2024-03-01", 1.0)]


def test_known_and_unknown_models(spark, log):
    models = spark.createDataFrame([("a", "p", "A")], "model string, path string, label string")
    assert {r["_id"] for r in registry.known_model_rows(log, models).collect()} == {1, 2}
    assert {r["_id"] for r in registry.unknown_model_rows(log, models).collect()} == {3, 4}


def test_scan_training(spark, tmp_path):
    from wattloom.constants import FEATURE_SPECS, TARGET

    names = ["house_id", TARGET, *FEATURE_SPECS["v12"], "extra"]
    values = ["7", "1.5", *["2.25"] * 12, "text"]
    path = tmp_path / "training.csv"
    path.write_text(",".join(names) + "\n" + ",".join(values) + "\n")
    row = tables.scan_training(spark, str(path)).first()
    assert row["house_id"] == 7 and row[TARGET] == 1.5 and row["City_code"] == 2.25
    path.write_text("house_id,other\n1,2\n")
    with pytest.raises(ValueError, match="target"):
        tables.scan_training(spark, str(path))
    path.write_text(f"house_id,{TARGET}\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        tables.scan_training(spark, str(path))

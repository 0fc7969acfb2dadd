import pytest

from wattloom import schemas
from wattloom.operators import appliances, solar


@pytest.fixture(scope="module")
def inventory(spark):
    rows = [
        (1, 1, "Fan", 70.0, 10.0, 2.0),
        (1, 2, "Television", 100.0, 5.0, 0.0),
        (1, 3, "Fan", 70.0, 4.0, None),
        (2, 1, "Router", None, 24.0, 1.0),
        (2, 2, "Monitor", 33.333, 3.0, 3.0),
        (3, 1, "Fan", 50.0, None, float("nan")),
    ]
    return spark.createDataFrame(rows, schemas.INVENTORY)


def by_house(df, *names):
    return {r["house_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_household_consumption(inventory):
    found = by_house(appliances.household_consumption(inventory), "daily_kwh", "monthly_kwh")
    assert found[1] == pytest.approx((2.18, 65.4))
    assert found[2] == pytest.approx((0.299997, 8.99991))
    assert found[3] == (0.0, 0.0)


def test_daily_total(inventory):
    row = appliances.daily_total(inventory).first()
    assert row["daily_kwh"] == pytest.approx(2.479997)
    assert row["monthly_kwh"] == pytest.approx(2.479997 * 30)


def test_import_appliances(inventory):
    found = by_house(appliances.import_appliances(inventory), "total_appliance_power",
                     "appliance_count", "avg_power_per_appliance")
    assert found == {1: (310.0, 4.0, 77.5), 2: (100.0, 4.0, 25.0), 3: (50.0, 1.0, 50.0)}


def test_quantities_that_cancel_out_fall_back_to_the_row_count(spark):
    rows = [(1, 1, "Fan", 10.0, 1.0, 2.0), (1, 2, "Fan", 10.0, 1.0, -2.0)]
    df = spark.createDataFrame(rows, schemas.INVENTORY)
    row = appliances.import_appliances(df).first()
    assert (row["appliance_count"], row["avg_power_per_appliance"]) == (2.0, 0.0)


def test_of_equal_names_the_last_row_counts(inventory):
    for df in (inventory, inventory.repartition(5)):
        found = by_house(appliances.appliance_usage_map(df), "appliance_usage")
        assert found[1][0] == {"Fan": 4.0, "Television": 5.0}
        assert found[2][0] == {"Router": 24.0, "Monitor": 9.0}


def test_usage_by_appliance_takes_the_first_present_map(spark):
    df = spark.createDataFrame(
        [({"Fan": 1.0}, {"Fan": 9.0}), (None, {"Fan": 2.0, "TV": None}), (None, None)],
        "appliances map<string,double>, breakdown map<string,double>")
    found = {r["name"]: r["usage"] for r in appliances.usage_by_appliance(df).collect()}
    assert found == {"Fan": 3.0, "TV": 0.0}


def test_appliance_watts(spark):
    rows = [("Fan", "count", 2.0), ("Fan", None, 1.5), ("Fan", "power", 33.0),
            ("Toaster", "count", 2.0), ("Toaster", "power", 2.0), ("Fan", "count", None)]
    df = spark.createDataFrame(rows, "name string, mode string, value double")
    found = [r["watts"] for r in appliances.appliance_watts(df).collect()]
    assert found == [140.0, 105.0, 33.0, 0.0, 2.0, 0.0]


def test_standby_energy(inventory):
    found = by_house(appliances.standby_energy(inventory), "standby_kwh", "standby_share")
    assert found[1] == pytest.approx((0.5, 0.5 / 2.18))
    assert found[2] == (0.0, 0.0)
    assert found[3] == (0.0, None)


REQUESTS = [
    (4.5005, 5.0, 400.0, 0.75),
    (4.5, 5.0, 400.0, None),
    (0.0, 5.0, 400.0, None),
    (4.5, -1.0, 400.0, None),
    (4.5, 5.0, 400.0, 0.0),
    (0.01, 1.0, 0.5, 0.75),
    (4.5, 5.0, 0.0, None),
    (float("nan"), 5.0, 400.0, None),
]


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(REQUESTS, schemas.SOLAR_REQUEST)


def test_solar_sizing_agrees_with_python(requests):
    found = [tuple(r)[4:] for r in solar.solar_sizing(requests).collect()]
    expected = []
    for daily, sun, watt, efficiency in (REQUESTS[0], REQUESTS[1], REQUESTS[5]):
        panel = watt * sun * (0.75 if efficiency is None else efficiency)
        panels = int((daily * 1000.0 + panel - 1) // panel)
        expected.append((panels, round(panel * panels / 1000.0, 4), round(panel, 2)))
    assert found == expected
    assert found[0][0] == 3


def test_solar_ceiling_variant(requests):
    found = [(r["daily_kwh"], r["panel_watt"], r["panels_required"],
              r["estimated_daily_generation_kwh"])
             for r in solar.solar_sizing_ceil(requests).collect()]
    assert found[0] == (4.5005, 400.0, 4, 6.0)
    assert found[1] == (4.5, 400.0, 3, 4.5)
    # A panel of 0 W means the default panel.
    assert (4.5, 0.0, 3, 4.5) in found
    assert len(found) == 5


def test_solar_rejects(requests):
    reasons = [r["reason"] for r in solar.validate_solar(requests).collect()]
    assert [r is None for r in reasons] == [True, True, False, False, False, True, False, False]
    assert reasons[4] == "panel yields no energy"
    assert solar.solar_rejects(requests).count() == 5

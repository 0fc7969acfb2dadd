import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import history, quantiles
from wattloom.operators.ordering import number_in_order, previous_in_order


@pytest.fixture(scope="module", autouse=True)
def many_partitions(spark):
    """Keep the adaptive planner from merging the small test data into one range."""
    option = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(option, "false")
    yield
    spark.conf.unset(option)


@pytest.fixture(scope="module")
def log(spark):
    """A third of the rows belong to house 1, and a third of those to one moment."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        house = 1 if i % 3 == 0 else int(rng.integers(2, 40))
        second = 77 if i % 9 == 0 else int(rng.integers(0, 500))
        rows.append((i, house if i != 5 else None, second, float(rng.normal())))
    return spark.createDataFrame(rows, "_id long, house_id long, t long, kwh double").repartition(6)


def expected_previous(log):
    last, found = {}, {}
    for r in sorted(log.collect(), key=lambda r: (r["t"], r["_id"])):
        found[r["_id"]] = last.get(r["house_id"])
        last[r["house_id"]] = r["kwh"]
    return found


@pytest.mark.parametrize("hot_rows", [10**9, 100, 0])
def test_previous_in_order_with_and_without_hot_keys(log, hot_rows):
    linked = previous_in_order(log, "house_id", ["t", "_id"], "kwh", "last", hot_rows)
    assert {r["_id"]: r["last"] for r in linked.collect()} == expected_previous(log)
    assert linked.columns == [*log.columns, "last"]


def test_hot_key_is_spread_over_several_ranges(spark, log):
    from wattloom.operators.ordering import _RANGE, in_ranges

    hot = log.filter("house_id = 1")
    ranges = in_ranges(hot, [F.col("house_id"), F.col("t"), F.col("_id")])
    assert ranges.select(_RANGE).distinct().count() > 1


def test_number_in_order(log):
    numbered = number_in_order(log, [F.col("t").asc(), F.col("_id").asc()], "position")
    rows = numbered.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(1, 1501))
    assert [(r["t"], r["_id"]) for r in rows] == sorted((r["t"], r["_id"]) for r in rows)


def test_recent_rank_filter_runs_before_the_shuffle(log):
    recent = history.recent_per_house(log, 3, "t", "_id")
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert recent.filter("house_id = 1").count() == 3


VALUES = {
    "normal": np.random.default_rng(1).normal(size=3000),
    "hot": np.where(np.arange(3000) % 3 == 0, 7.0, np.arange(3000) / 10.0),
    "wide": np.concatenate([np.geomspace(1e-12, 1e300, 1500), -np.geomspace(1e-12, 1e300, 1500)]),
    "constant": np.full(3000, -4.25),
    "zeros": np.where(np.arange(3000) % 2 == 0, 0.0, -0.0),
}
PROBABILITIES = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("listed", [10_000, 50, 1])
def test_exact_quantiles_agree_with_numpy(spark, monkeypatch, listed):
    monkeypatch.setattr(quantiles, "ACCURACY", 64)
    names = list(VALUES)
    rows = [tuple(float(VALUES[n][i]) for n in names) for i in range(3000)]
    schema = ", ".join(f"{n} double" for n in names)
    df = spark.createDataFrame([*rows, (None,) * 5, (float("nan"),) * 5], schema).persist()
    found = quantiles.exact_quantiles(df, {n: PROBABILITIES for n in names}, listed=listed)
    df.unpersist()
    for n in names:
        np.testing.assert_allclose(found[n], np.quantile(VALUES[n], PROBABILITIES), rtol=1e-12)


def test_quantiles_of_nothing_are_none(spark):
    empty = spark.createDataFrame([], "v double")
    assert quantiles.exact_quantiles(empty, {"v": [0.5]}) == {"v": [None]}


def count_passes(monkeypatch):
    """Counts the scans that the search takes after the summary."""
    passes = []
    for name in ("_proposals", "_count_groups"):
        original = getattr(quantiles, name)
        monkeypatch.setattr(quantiles, name, lambda *a, f=original: passes.append(1) or f(*a))
    return passes


@pytest.mark.parametrize("kind", ["infinite", "decades", "two values", "ties"])
def test_quantiles_end_within_six_passes(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    n = 40_000
    values = {
        "infinite": np.where(np.arange(n) % 3 == 0, np.inf, np.where(np.arange(n) % 7 == 0, -np.inf, rng.normal(size=n))),
        "decades": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n),
        "two values": np.where(np.arange(n) % 4 == 0, 1.0, 2.0),
        "ties": np.floor(rng.exponential(1.0, n)),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    passes = count_passes(monkeypatch)
    ranks = [0, 1, n // 4, n // 2, n - n // 3, n - 2, n - 1]
    found = quantiles.order_statistics(df, {"x": ranks}, listed=500)
    ordered = np.sort(values)
    assert [found["x", k] for k in ranks] == [ordered[k] for k in ranks]
    assert len(passes) <= 6


def test_quantile_between_infinities(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("inf"),)], "x double")
    assert quantiles.exact_quantiles(df, {"x": [0.0, 0.75, 1.0]})["x"] == [1.0, float("inf"), float("inf")]

"""Statistics kept up to date against one pass over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.operators import maintained, metrics
from wattloom.runtime import scratch_path

def columns():
    return {"x": F.col("x"), "far": F.col("x") + 1e9}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = [(int(m), k, None if i % 50 == 0 else float("nan") if i % 51 == 0 else float(x)) for i, (m, k, x) in enumerate(
        zip(rng.integers(1, 13, 900), rng.choice(["a", "b"], 900), rng.normal(5, 2, 900)))]
    return spark.createDataFrame([*data, (3, "only", 7.0)], "month int, k string, x double")


def delivered(spark, rows, cuts=((1, 3), (4, 9), (10, 12))):
    root = scratch_path(spark, "kept")
    for i, (lo, hi) in enumerate(cuts):
        some = rows.filter(F.col("month").between(lo, hi))
        for _ in range(2):  # a repeated delivery replaces itself
            maintained.deliver(maintained.parts(some, F.col("month"), columns(), ["k"]), root, f"d{i}")
    return maintained.stored_parts(spark, root)


def test_merged_months_equal_one_pass(spark, rows):
    found = {(r.k, r.name): r for r in maintained.merged(delivered(spark, rows), ["k"], {"p95": 0.95}).collect()}
    values = {k: np.array([r.x for r in rows.filter(F.col("k") == k).collect() if r.x is not None and not math.isnan(r.x)])
              for k in ("a", "b", "only")}
    assert set(found) == {(k, n) for k in values for n in ("x", "far")}
    for (k, name), r in found.items():
        x = values[k] + (1e9 if name == "far" else 0)
        assert (r["count"], r["min"], r["max"]) == (len(x), x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean(), rel=1e-14)
        assert r["std_pop"] == pytest.approx(x.std(), rel=1e-6, abs=1e-9)
        assert r["std"] == (pytest.approx(x.std(ddof=1), rel=1e-6) if len(x) > 1 else None)
        assert r["p95"] == np.sort(x)[math.ceil(0.95 * len(x)) - 1]


def test_one_delivery_equals_many(spark, rows):
    names = ("k", "name", "count", "min", "max", "p50")
    both = [maintained.merged(delivered(spark, rows, cuts), ["k"], {"p50": 0.5}).select(*names).collect()
            for cuts in (((1, 12),), tuple((m, m) for m in range(1, 13)))]
    assert sorted(both[0]) == sorted(both[1])


def test_ranks_of_large_sketches_are_within_the_bound(spark):
    n = 400_000
    rows = spark.range(n).select((F.col("id") % 12 + 1).cast("int").alias("month"), (F.col("id") * 7919 % n).alias("x"))
    root = scratch_path(spark, "kept")
    for half in range(2):
        some = rows.filter(F.col("month") % 2 == half)
        maintained.deliver(maintained.parts(some, F.col("month"), {"x": F.col("x")}), root, str(half))
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    row = maintained.merged(maintained.stored_parts(spark, root), [], wanted).first()
    for name, q in wanted.items():
        assert abs(row[name] / n - q) <= maintained.rank_error()


def test_metrics_from_parts(spark):
    rng = np.random.default_rng(5)
    y = np.where(np.arange(300) % 7 == 0, 0.0, rng.normal(50, 20, 300))
    data = [("m", i % 5, float(a), float(a + e)) for i, (a, e) in enumerate(zip(y, rng.normal(0, 5, 300)))]
    data += [("exact", 1, 2.0, 2.0), ("exact", 2, 2.0, 2.0), ("constant", 1, 2.0, 3.0), ("constant", 1, 2.0, 2.0)]
    scored = spark.createDataFrame(data, "model string, month int, y double, prediction double")
    found = maintained.parts(scored, F.col("month"), maintained.error_values(F.col("y"), F.col("prediction")), ["model"])
    root = scratch_path(spark, "kept")
    maintained.deliver(found, root, "all")
    kept_up = {r.model: r for r in maintained.metrics_of(maintained.stored_parts(spark, root), ["model"]).collect()}
    for r in metrics.eval_metrics(scored).collect():
        for name in ("n", *metrics.METRICS):
            assert kept_up[r.model][name] == pytest.approx(r[name]), (r.model, name)

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.constants import FEATURE_SPECS, TARGET
from wattloom.operators import metrics, registry, trees
from wattloom.operators import models as ml
from wattloom.operators.features import assemble_vector, vector_to_columns
from wattloom.runtime import scratch_path
from wattloom.sources import sinks, views

TINY = ml.Settings(trees=5, tree_depth=5, rounds=25, boost_depth=4)


def test_metrics_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    y = np.where(np.arange(400) % 7 == 0, 0.0, rng.normal(50, 20, 400))
    p = np.where(np.arange(400) % 14 == 0, 0.0, y + rng.normal(0, 5, 400))
    df = spark.createDataFrame(
        [("m", float(a), float(b)) for a, b in zip(y, p)], "model string, y double, prediction double")
    row = metrics.eval_metrics(df).first()
    some, denominator = y != 0, np.abs(y) + np.abs(p)
    expected = {
        "RMSE": np.sqrt(np.mean((y - p) ** 2)),
        "MAE": np.mean(np.abs(y - p)),
        "R2": 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2),
        "MAPE_safe": np.mean(np.abs((y - p)[some] / y[some])) * 100,
        "SMAPE": np.mean(2 * np.abs(p - y)[denominator != 0] / denominator[denominator != 0]) * 100,
    }
    for name, value in expected.items():
        assert row[name] == pytest.approx(value), name
        assert metrics.metric(df, name).first()[name] == row[name]


def test_metrics_at_the_edges(spark):
    rows = [("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("constant", 2.0, 3.0), ("constant", 2.0, 2.0),
            ("zero", 0.0, 0.0), ("zero", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, y double, prediction double")
    found = {r["model"]: r for r in metrics.eval_metrics(df).collect()}
    assert (found["exact"]["R2"], found["constant"]["R2"], found["zero"]["R2"]) == (1.0, 0.0, 1.0)
    assert found["zero"]["MAPE_safe"] is None and found["zero"]["SMAPE"] is None
    assert metrics.eval_metrics(df.limit(0)).count() == 0


def test_rank_residuals_and_diagonal(spark):
    table = spark.createDataFrame(
        [("a", 3.0, 0.9), ("b", 3.0, 0.95), ("c", None, 1.0), ("d", 1.0, 0.1)],
        "model string, MAPE_safe double, R2 double")
    ranks = {r["model"]: r["rank"] for r in metrics.rank_models(table).collect()}
    assert ranks == {"d": 1, "b": 2, "a": 3, "c": 4}
    scored = spark.createDataFrame([("a", 1.0, 4.0), ("a", -2.0, 0.0)],
                                   "model string, y double, prediction double")
    assert [r["residual"] for r in metrics.residuals(scored).collect()] == [-3.0, -2.0]
    bounds = metrics.pred_vs_actual(scored).first()
    assert (bounds["diagonal_min"], bounds["diagonal_max"]) == (-2.0, 4.0)


def test_split_is_reproducible_and_complete(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    train, test = ml.train_test_split(df, "k")
    assert train.count() + test.count() == 4000
    assert abs(test.count() - 1200) < 120
    again, _ = ml.train_test_split(df.repartition(7), "k")
    assert sorted(again.collect()) == sorted(train.collect())


@pytest.mark.parametrize("rows", [10, 101, 4000])
def test_exact_split_sizes(spark, rows):
    df = spark.range(rows).withColumnRenamed("id", "k")
    train, test = ml.train_test_split(df, "k", exact=True)
    assert test.count() == math.ceil(rows * 0.3)
    assert train.count() == rows - math.ceil(rows * 0.3)


@pytest.fixture(scope="module")
def trained(spark, folder):
    root = scratch_path(spark, "models")
    return root, ml.train_models(views.training_raw(spark, folder), settings=TINY, root=root)


def test_linear_model_is_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) * [1.0, 50.0]
    y = 3.0 + x @ [2.0, -0.5] + rng.normal(size=300)
    df = spark.createDataFrame(
        [(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], f"a double, b double, {TARGET} double")
    model = ml.fit(df, "linear", ["a", "b"])
    found = [r["prediction"] for r in ml.predict(df, model).collect()]
    design = np.column_stack([np.ones(300), x])
    np.testing.assert_allclose(found, design @ np.linalg.lstsq(design, y, rcond=None)[0], rtol=1e-8)


def test_training_quality(trained):
    quality = {r["model"]: r for r in trained[1].metrics.collect()}
    assert set(quality) == {"linear", "rf", "gbt"}
    for row in quality.values():
        # The target carries noise of deviation 5, which no model can predict.
        assert row["RMSE"] > 4.0
        assert row["R2"] > 0.7


def test_scored_rows_hold_every_model(trained):
    counts = {r["model"]: r["count"] for r in trained[1].scored.groupBy("model").count().collect()}
    assert len(set(counts.values())) == 1 and len(counts) == 3


def test_models_survive_storage(spark, folder, trained):
    root, result = trained
    rows = views.training(spark, folder).limit(50)
    for key, model in result.models.items():
        loaded = ml.load_model(spark, root, key)
        assert (ml.predict(rows, loaded).select("house_id", "prediction").collect()
                == ml.predict(rows, model).select("house_id", "prediction").collect())
    with pytest.raises(KeyError):
        ml.load_model(spark, root, "other")
    with pytest.raises(FileNotFoundError):
        ml.load_model(spark, f"{root}/nowhere", "linear")


def test_available_models_are_the_stored_ones(spark, trained):
    root, result = trained
    everything = registry.registry_frame(spark)
    stored = registry.available_models(everything, registry.stored_artifacts(spark, root))
    assert {r["model"] for r in stored.collect()} == {"linear", "rf", "gbt"}
    assert registry.model_info(spark, root)["available_models"]["gbt"] == "Gradient-Boosted Trees"
    partial = scratch_path(spark, "models")
    ml.save_models({"rf": result.models["rf"]}, partial)
    stored = registry.available_models(everything, registry.stored_artifacts(spark, partial))
    assert [tuple(r) for r in stored.collect()] == [("rf", "Random Forest")]


def test_each_row_is_scored_by_its_model(spark, folder, trained):
    models = trained[1].models
    requests = views.vector_requests(spark, folder).filter("size(features) = 12").filter(
        "forall(features, x -> x is not null)")
    found = {r["house_id"]: (r["model"], r["prediction"])
             for r in ml.score_by_model(requests, models).collect()}
    assert len(found) == requests.filter("model <> 'unknown'").count()
    rows = views.training(spark, folder)
    by_name = {
        (r["house_id"], r["model"]): r["prediction"]
        for r in ml.score_all_models(rows, models).collect()}
    for house, (model, prediction) in found.items():
        assert by_name[house, model] == prediction


def test_importances(trained):
    models = trained[1].models
    top = ml.top_importances(ml.feature_importances(models["rf"]), 3).collect()
    assert len(top) == 3 and top[0]["feature"] in FEATURE_SPECS["v12"]
    assert [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
    with pytest.raises(ValueError):
        ml.feature_importances(models["linear"])


def test_target_is_required(spark):
    with pytest.raises(ValueError, match=TARGET):
        ml.prepare_training(spark.createDataFrame([(1,)], "house_id long"))


def test_log_rows_and_metrics_file(spark, trained):
    requests = spark.createDataFrame(
        [("h", "rf", [1.0], None, 5.0)],
        "house_id string, model string, features array<double>, meta map<string,string>, "
        "prediction double")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp_ntz")
    path = scratch_path(spark, "log")
    log = ml.to_log(requests, F.lit("id1"), at)
    sinks.append_prediction_log(log, path)
    sinks.append_prediction_log(log, path)
    stored = spark.read.parquet(path).collect()
    assert len(stored) == 2 and stored[0]["meta"] == {} and stored[0]["month"] == "2024-01"
    where = scratch_path(spark, "metrics")
    sinks.write_metrics(trained[1].metrics, where)
    lines = [json.loads(r["value"]) for r in spark.read.text(where).collect()]
    assert {line["model"] for line in lines} == {"linear", "rf", "gbt"}


def test_sixteen_feature_models_take_collinear_city_columns(spark, folder):
    """Form rows through vector assembly into training; the four city columns sum to 1."""
    vectors = assemble_vector(views.forms(spark, folder), "v16")
    rows = vector_to_columns(vectors.select(F.col("row_id").alias("house_id"), "features"), "v16")
    target = 3.0 * F.col("Fan") + 0.5 * F.col("MonthlyHours") + 10.0 * F.col("City_City_B")
    table = rows.withColumn(TARGET, target)
    prepared = ml.prepare_training(table, "v16", sigma=0.0)
    assert prepared.columns == ["house_id", TARGET, *FEATURE_SPECS["v16"]]
    model = ml.fit(prepared, "linear", "v16")
    quality = metrics.eval_metrics(ml.score_all_models(prepared, {"linear": model})).first()
    assert quality["R2"] > 0.999999


def test_forests_do_not_depend_on_the_layout_of_the_rows(spark, folder):
    rows = ml.prepare_training(views.training_raw(spark, folder))
    settings = ml.Settings(trees=4, tree_depth=5)
    one = ml.fit(rows, "rf", settings=settings)
    other = ml.fit(rows.repartition(11).orderBy(F.rand(3)), "rf", settings=settings)
    found = [{r["house_id"]: r["prediction"] for r in ml.predict(rows, m).collect()} for m in (one, other)]
    assert found[0] == found[1]


def test_requests_are_read_once_for_all_models(spark, folder, trained):
    """Also those with missing values, which validation would refuse, and those that name no model."""
    models, path = trained[1].models, scratch_path(spark, "requests")
    views.vector_requests(spark, folder).withColumn("model", F.when(F.col("house_id") % 8 != 0, F.col("model"))).write.parquet(path)
    requests = spark.read.parquet(path)
    found = ml.score_by_model(requests, models)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert found.columns == [*requests.columns, "prediction"]
    wanted = {r["house_id"]: r["prediction"] for key, model in models.items()
              for r in ml.predict_vectors(requests.filter(F.col("model") == key), model).collect()}
    assert {r["house_id"]: r["prediction"] for r in found.collect()} == wanted
    assert ml.score_by_model(requests.filter("model = 'unknown'"), models).count() == 0
    only = ml.score_by_model(requests, {"gbt": models["gbt"]})
    assert {r["model"] for r in only.collect()} == {"gbt"}


def test_models_fitted_together_are_those_fitted_alone(spark, folder):
    rows = ml.prepare_training(views.training(spark, folder)).repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    together = ml.fit_all(rows.mapInArrow(counted, rows.schema), ["linear", "rf", "gbt"], settings=TINY)
    assert read.value == rows.count()
    for key in ("rf", "gbt"):
        assert vars(together[key].nodes) == vars(ml.fit(rows, key, settings=TINY).nodes)
    np.testing.assert_allclose(together["linear"].coefficients, ml.fit(rows, "linear").coefficients, rtol=1e-9, atol=1e-9)


def test_trees_fitted_together_share_their_cuts_and_are_stored(spark, folder, monkeypatch):
    rows, cut, find = ml.prepare_training(views.training(spark, folder)), [], trees.find_cuts
    monkeypatch.setattr(trees, "find_cuts", lambda *a: cut.append(a) or find(*a))
    root = scratch_path(spark, "models")
    fitted = ml.fit_all(rows, ["linear", "rf", "gbt"], settings=TINY, root=root)
    assert list(fitted) == ["linear", "rf", "gbt"]
    assert len(cut) == 1
    loaded = ml.load_models(spark, root, list(fitted))
    assert all(vars(loaded[key].nodes) == vars(fitted[key].nodes) for key in ("rf", "gbt"))
    assert loaded["linear"] == fitted["linear"]

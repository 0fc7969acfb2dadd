"""The registered queries: one function (spark, folder) -> DataFrame per operator."""

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom import schemas
from wattloom.constants import FEATURE_SPECS, PUBLISHED_THRESHOLDS, TARGET
from wattloom.functions import dates
from wattloom.functions.rounding import js_round
from wattloom.operators import appliances, features, history, maintained, metrics, profile, registry, solar
from wattloom.operators import models as ml
from wattloom.operators import validation
from wattloom.runtime import scratch_path
from wattloom.sources import sinks, tables, views
from wattloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

V12 = FEATURE_SPECS["v12"]
GRID, SOLAR = "GridConsumption_kWh", "SolarGeneration_kWh"


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Sums of doubles depend on the order of addition in the last bits; cut those."""
    return df.withColumns({n: js_round(F.col(n), digits) for n in names})


# --- sources and sinks -------------------------------------------------------------------------


@query
def scan_training(spark, folder):
    path = scratch_path(spark, "training-csv")
    views.training(spark, folder).write.option("header", True).csv(path)
    return tables.scan_training(spark, path)


@query
def select_features(spark, folder):
    order = [*V12[::-1], TARGET]
    return features.select_features(views.training(spark, folder), order, keep=["house_id"])


@query
def ingest_households(spark, folder):
    path = scratch_path(spark, "households")
    sinks.ingest_households(views.households(spark, folder), path)
    return spark.read.parquet(path).select(
        "record_id", "house_id", "date", "total_consumption_kwh", "outcome",
        F.coalesce("reason", F.lit("")).alias("reason"))


@query
def household_by_id(spark, folder):
    log = views.predictions(spark, folder)
    return history.household_by_id(log, 42).select("_id", "house_id", "predicted_value_kwh")


@query
def households_by_ids(spark, folder):
    wanted = views.houses_dim(spark, folder).filter(F.col("company") == "HOUSEHOLD")
    return history.households_by_ids(views.predictions(spark, folder), wanted).select(
        "_id", "house_id", "predicted_value_kwh")


def _scored_log(spark, folder):
    """Prediction log of a fixed linear formula over the valid requests."""
    checked = validation.validate_vector(
        views.vector_requests(spark, folder), ["linear", "rf", "gbt"])
    accepted, _ = validation.split_valid(checked)
    x = F.col("features")
    formula = 0.0001 * x[0] * x[3] + 0.5 * x[9]
    orders = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("house_id"), "o_orderdate")
    scored = accepted.withColumn("prediction", formula).join(orders, "house_id")
    return ml.to_log(scored, F.col("house_id"), F.col("o_orderdate"))


@query
def append_prediction_log(spark, folder):
    path = scratch_path(spark, "log")
    sinks.append_prediction_log(_scored_log(spark, folder), path)
    log = spark.read.schema(schemas.PREDICTION_LOG).parquet(path)
    return log.select(
        "_id", "house_id", "model", "predicted_value_kwh",
        F.size("features").alias("n_features"),
        F.coalesce(F.try_element_at("meta", F.lit("source")), F.lit("")).alias("source"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


@query
def prediction_history(spark, folder):
    newest = history.prediction_history(views.predictions(spark, folder), 50, "rf")
    return newest.select("_id", "house_id", "model", "predicted_value_kwh",
                         F.substring(F.col("timestamp").cast("string"), 1, 10).alias("day"))


@query
def write_metrics(spark, folder):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(metrics.eval_metrics(views.scored(spark, folder)), path)
    names = list(metrics.METRICS)
    schema = "model string, n long, " + ", ".join(f"{n} double" for n in names)
    return _rounded(spark.read.schema(schema).json(path), names)


@query
def write_thresholds(spark, folder):
    path = scratch_path(spark, "thresholds")
    limits = profile.thresholds(views.training(spark, folder))
    sinks.write_thresholds(limits, spark, path)
    names = list(limits.__dict__)
    stored = spark.read.schema(", ".join(f"{n} double" for n in names)).json(path)
    # Interpolated values have few decimals; nine digits keep rounding away from their ties.
    return _rounded(stored, names, 9)


@query
def available_models(spark, folder):
    """Registry entries whose models stand in storage: the line is stored here, the trees are not."""
    train, _ = _parts(spark, folder)
    root = scratch_path(spark, "models")
    ml.save_models({"linear": ml.fit(train, "linear", "v12")}, root)
    return registry.available_models(
        registry.registry_frame(spark), registry.stored_artifacts(spark, root))


# --- projections and features ------------------------------------------------------------------


@query
def clip_target(spark, folder):
    rows = views.training(spark, folder).withColumn(TARGET, F.col(TARGET) - 20.0)
    return features.clip_target(rows).select("house_id", TARGET)


@query
def add_noise(spark, folder):
    noisy = features.add_noise(views.training(spark, folder), "house_id")
    return _rounded(noisy.select("house_id", TARGET), [TARGET])


@query
def city_one_hot(spark, folder):
    return features.city_one_hot(views.houses_dim(spark, folder)).drop("company")


@query
def appliance_watts(spark, folder):
    house = F.col("house_id")
    rows = views.inventory(spark, folder).select(
        "house_id",
        F.when(F.col("hours") == 0, "Heater").otherwise(F.col("name")).alias("name"),
        F.when(house % 2 == 0, "power").when(house % 3 == 0, "count").alias("mode"),
        F.when(house % 2 == 0, F.col("power")).when(F.col("qty") > 0, F.col("qty"))
        .alias("value"))
    return appliances.appliance_watts(rows)


@query
def net_bill(spark, folder):
    return features.net_bill(views.forms(spark, folder)).select("row_id", "net_bill")


def _vectors(spark, folder, spec):
    rows = features.assemble_vector(views.forms(spark, folder), spec)
    return features.vector_to_columns(rows.select("row_id", "features"), spec)


@query
def assemble_vector(spark, folder):
    return _vectors(spark, folder, "v12")


@query
def assemble_vector_v16(spark, folder):
    return _vectors(spark, folder, "v16")


def _autofilled(spark, folder, force):
    return features.autofill(views.forms(spark, folder), force).select(
        "row_id", "total_appliance_power", "NetBill", "MonthlyHours", "avg_power_per_appliance")


@query
def autofill(spark, folder):
    return _autofilled(spark, folder, force=False)


@query
def autofill_force(spark, folder):
    return _autofilled(spark, folder, force=True)


@query
def solar_sizing(spark, folder):
    return solar.solar_sizing(views.solar_requests(spark, folder))


@query
def solar_sizing_ceil(spark, folder):
    return solar.solar_sizing_ceil(views.solar_requests(spark, folder)).drop("efficiency")


@query
def prediction_band(spark, folder):
    value = F.col("predicted_value_kwh")
    return views.predictions(spark, folder).select(
        "_id", history.prediction_band(value).alias("band"))


@query
def gauge_pct(spark, folder):
    linked = history.delta_vs_last(views.predictions(spark, folder))
    gauge = history.gauge_pct(F.col("predicted_value_kwh"), F.col("last_kwh"))
    return linked.select("_id", gauge.alias("gauge_pct"))


@query
def residuals(spark, folder):
    return metrics.residuals(views.scored(spark, folder))


@query
def pred_vs_actual(spark, folder):
    return metrics.pred_vs_actual(views.scored(spark, folder))


@query
def parse_record_date(spark, folder):
    records = views.households(spark, folder).select("record_id", "date")
    return dates.parse_record_date(records, "date", iso="iso", at="at").select(
        "record_id", "iso", F.col("at").cast("string").alias("at_utc"))


@query
def month_num(spark, folder):
    checked = validation.validate_household(views.households(spark, folder))
    accepted, _ = validation.split_valid(checked)
    return features.month_num(accepted).select("record_id", "Month_num")


@query
def label_encode(spark, folder):
    houses = views.houses_dim(spark, folder)
    return features.label_encode(houses, {"company": "Company_code", "city_code": "City_index"})


def _training_part(spark, folder):
    train, _ = ml.train_test_split(views.training(spark, folder), "house_id")
    return train


@query
def scaler_stats(spark, folder):
    stats = features.scaler_stats(_training_part(spark, folder), V12)
    return _rounded(stats.frame(spark), ["mean", "std"])


@query
def standardize(spark, folder):
    stats = features.scaler_stats(_training_part(spark, folder), V12)
    scaled = features.standardize(views.training(spark, folder), stats)
    return _rounded(scaled.select("house_id", *V12), V12)


@query
def chart_date(spark, folder):
    label = history.chart_date(F.col("date"), F.col("timestamp"))
    return views.dashboard_records(spark, folder).select("_id", label.alias("label"))


@query
def first_present_kwh(spark, folder):
    records = views.dashboard_records(spark, folder)
    return records.select("_id", history.first_present_kwh(records).alias("kwh"))


@query
def units_to_kwh(spark, folder):
    return features.units_to_kwh(views.readings_with_unit(spark, folder))


@query
def clean_training(spark, folder):
    return features.clean_training(views.training_raw(spark, folder), V12)


@query
def predicted_bill(spark, folder):
    return features.predicted_bill(views.training(spark, folder), TARGET).select(
        "house_id", "predicted_bill")


@query
def solar_offset(spark, folder):
    rows = views.training(spark, folder).withColumn(
        "demand", F.when(F.col("house_id") % 9 != 0, F.col(GRID)).otherwise(0.0))
    return features.solar_offset(rows, SOLAR, "demand").select("house_id", "solar_offset_pct")


@query
def surplus_energy(spark, folder):
    return features.surplus_energy(views.training(spark, folder), SOLAR, GRID).select(
        "house_id", "surplus_kwh", "grid_need_kwh")


@query
def js_round2(spark, folder):
    product = F.col(GRID) * F.col("TariffRate") - 500.0
    return views.training(spark, folder).select("house_id", js_round(product).alias("rounded"))


# --- validation --------------------------------------------------------------------------------


@query
def validate_household(spark, folder):
    return validation.validate_household(views.households(spark, folder)).select(
        "record_id", "house_id", "reason")


@query
def validate_solar(spark, folder):
    return solar.validate_solar(views.solar_requests(spark, folder)).select(
        "request_id", "reason")


@query
def validate_vector(spark, folder):
    return validation.validate_vector(
        views.vector_requests(spark, folder), ["linear", "rf", "gbt"]).select(
        "house_id", "model", "reason")


@query
def validate_fields(spark, folder):
    return validation.validate_fields(views.forms(spark, folder))


@query
def blocked_rows(spark, folder):
    return validation.blocked_rows(views.forms(spark, folder))


@query
def filter_model(spark, folder):
    return history.filter_model(views.predictions(spark, folder), "linear").select(
        "_id", "model", "predicted_value_kwh")


@query
def zero_target_rows(spark, folder):
    noisy = features.clip_target(features.add_noise(views.training(spark, folder), "house_id"))
    return profile.zero_target_rows(noisy).select("house_id", TARGET)


@query
def outlier_flags(spark, folder):
    rows = views.training(spark, folder)
    flagged = profile.outlier_flags(rows, profile.thresholds(rows))
    return flagged.select("house_id", "grid_above_p95", "grid_above_p99", "hours_outside",
                          "power_above_p99")


@query
def outlier_flags_published(spark, folder):
    """Flags against the thresholds that were published with the original training data."""
    flagged = profile.outlier_flags(
        views.training(spark, folder), profile.Thresholds(**PUBLISHED_THRESHOLDS))
    return flagged.select("house_id", "grid_above_p95", "grid_above_p99", "hours_outside",
                          "power_above_p99")


@query
def known_model_rows(spark, folder):
    rows = views.predictions(spark, folder).select("_id", "model")
    return registry.known_model_rows(rows, registry.registry_frame(spark))


@query
def unknown_model_rows(spark, folder):
    rows = views.predictions(spark, folder).select("_id", "model")
    return registry.unknown_model_rows(rows, registry.registry_frame(spark))


@query
def submit_form(spark, folder):
    vectors = validation.submit_forms(views.forms(spark, folder)).select("row_id", "features")
    return features.vector_to_columns(vectors, "v12")


@query
def import_and_autofill(spark, folder):
    imported = appliances.import_appliances(views.inventory(spark, folder))
    return features.import_and_autofill(views.forms(spark, folder), imported).select(
        "row_id", "total_appliance_power", "NetBill", "MonthlyHours", "avg_power_per_appliance")


# --- aggregations ------------------------------------------------------------------------------


@query
def describe_target(spark, folder):
    """The target before noise, after noise and after clipping, side by side."""
    rows = views.training(spark, folder).select("house_id", F.col(TARGET).alias("before"))
    both = features.add_noise(rows.withColumn("after", F.col("before")), "house_id", "after")
    summary = profile.describe(features.clip_target(both, "after"), ["before", "after"])
    return _rounded(summary, ["mean", "std", "min", "p25", "p50", "p75", "max"], 9)


@query
def count_zero_target(spark, folder):
    noisy = features.clip_target(features.add_noise(views.training(spark, folder), "house_id"))
    return profile.count_zero_target(noisy)


@query
def household_consumption(spark, folder):
    return appliances.household_consumption(views.inventory(spark, folder))


@query
def import_appliances(spark, folder):
    return appliances.import_appliances(views.inventory(spark, folder))


@query
def appliance_usage_map(spark, folder):
    maps = appliances.appliance_usage_map(views.inventory(spark, folder))
    return maps.select("house_id", F.explode("appliance_usage").alias("name", "usage"))


@query
def household_records(spark, folder):
    dates = tables.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("house_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    records = appliances.household_records(views.inventory(spark, folder), dates)
    return _rounded(records, ["total_consumption_kwh"]).select(
        "house_id", "date", "total_consumption_kwh", F.explode("appliance_usage").alias("name", "usage"))


@query
def usage_by_appliance(spark, folder):
    maps = appliances.appliance_usage_map(views.inventory(spark, folder))
    even = F.col("house_id") % 2 == 0
    records = maps.select(
        F.when(even, F.col("appliance_usage")).alias("appliance_usage"),
        F.when(~even, F.col("appliance_usage")).alias("breakdown"))
    return appliances.usage_by_appliance(records)


@query
def standby_energy(spark, folder):
    return appliances.standby_energy(views.inventory(spark, folder))


@query
def daily_total(spark, folder):
    return appliances.daily_total(views.inventory(spark, folder))


def _metric(name, spark, folder):
    return _rounded(metrics.metric(views.scored(spark, folder), name), [name])


for _key, _name in [("metric_rmse", "RMSE"), ("metric_mae", "MAE"), ("metric_r2", "R2"),
                    ("metric_mape_safe", "MAPE_safe"), ("metric_smape", "SMAPE")]:
    _QUERIES[_key] = partial(_metric, _name)


@query
def eval_metrics(spark, folder):
    return _rounded(metrics.eval_metrics(views.scored(spark, folder)), list(metrics.METRICS))


@query
def thresholds(spark, folder):
    limits = profile.thresholds(views.training(spark, folder))
    return _rounded(limits.frame(spark), list(limits.__dict__), 9)


@query
def monthly_trend(spark, folder):
    return _rounded(history.monthly_trend(views.predictions(spark, folder)),
                    ["sum_kwh", "mean_kwh"])


@query
def maintained_statistics(spark, folder):
    """Statistics of the training columns from three deliveries of months, each read once."""
    root = scratch_path(spark, "statistics")
    rows = views.training(spark, folder)
    for i in range(3):
        months = rows.filter(F.col("Month_num").between(4 * i + 1, 4 * i + 4))
        found = maintained.parts(months, F.col("Month_num").cast("int"), {c: F.col(c) for c in [*V12, TARGET]})
        maintained.deliver(found, root, f"months{i}")
    kept_up = maintained.merged(maintained.stored_parts(spark, root), [], {"p95": 0.95, "p99": 0.99})
    return _rounded(kept_up, ["mean", "std", "std_pop"])


@query
def maintained_metrics(spark, folder):
    """Evaluation metrics by model from three deliveries of scored rows."""
    root = scratch_path(spark, "metrics")
    rows = views.scored(spark, folder)
    for i in range(3):
        found = maintained.parts(rows.filter(F.col("house_id") % 3 == i), (F.col("house_id") % 12).cast("int"),
                                 maintained.error_values(F.col("y"), F.col("prediction")), ["model"])
        maintained.deliver(found, root, f"part{i}")
    kept_up = maintained.metrics_of(maintained.stored_parts(spark, root), ["model"])
    return _rounded(kept_up, list(metrics.METRICS))


# --- windows and order -------------------------------------------------------------------------


@query
def recent_30(spark, folder):
    newest = history.recent_per_house(
        views.readings(spark, folder), time="ts", row_id="event_id")
    return newest.select("event_id", "house_id", "kwh")


@query
def delta_vs_last(spark, folder):
    return history.delta_vs_last(views.predictions(spark, folder)).select(
        "_id", "house_id", "predicted_value_kwh", "last_kwh", "delta_kwh", "direction")


@query
def rank_models(spark, folder):
    ranked = metrics.rank_models(metrics.eval_metrics(views.scored(spark, folder)))
    return _rounded(ranked.select("model", "MAPE_safe", "R2", "rank"), ["MAPE_safe", "R2"])


@query
def chart_series(spark, folder):
    return history.chart_series(views.dashboard_records(spark, folder))


# --- models ------------------------------------------------------------------------------------


@query
def train_test_split(spark, folder):
    train, test = ml.train_test_split(views.training(spark, folder), "house_id")
    return train.select("house_id", F.lit("train").alias("part")).unionByName(
        test.select("house_id", F.lit("test").alias("part")))


@query
def train_test_split_exact(spark, folder):
    train, test = ml.train_test_split(views.training(spark, folder), "house_id", exact=True)
    return train.select("house_id", F.lit("train").alias("part")).unionByName(
        test.select("house_id", F.lit("test").alias("part")))


@query
def linear_sql(spark, folder):
    """One-feature least squares in plain aggregates."""
    y, x = F.col(TARGET), F.col("total_appliance_power")
    line = views.training(spark, folder).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.count(F.lit(1)).alias("n"))
    return _rounded(line, ["slope", "intercept", "r2"])


_model_roots: dict[tuple[str, str], str] = {}
_stored: set[tuple[str, str]] = set()


def _stored_models(spark, folder, *keys):
    """Models at full size, fitted and stored by the first query of the application that needs them."""
    at = (spark.sparkContext.applicationId, folder)
    root = _model_roots.setdefault(at, scratch_path(spark, "models"))
    if wanted := [key for key in keys if (root, key) not in _stored]:
        train, _ = _parts(spark, folder)
        ml.fit_all(train, wanted, "v12", root=root)
        _stored.update((root, key) for key in wanted)
    return ml.load_models(spark, root, keys)


def _model(spark, folder, key):
    return _stored_models(spark, folder, key)[key]


def _models(spark, folder):
    return _stored_models(spark, folder, "linear", "rf", "gbt")


def _parts(spark, folder):
    rows = ml.prepare_training(views.training_raw(spark, folder), "v12")
    return ml.train_test_split(rows, "house_id")


def _quality(spark, folder, models, digits):
    """Metrics of each model on the test part."""
    _, test = _parts(spark, folder)
    found = metrics.eval_metrics(ml.score_all_models(test, models))
    return _rounded(found, list(metrics.METRICS), digits)


def _fit_quality(model, spark, folder):
    return _quality(spark, folder, {model: _model(spark, folder, model)}, 6)


for _key, _name in [("fit_forest", "rf"), ("fit_boosted", "gbt")]:
    _QUERIES[_key] = partial(_fit_quality, _name)


def _predicted(rows, model):
    # The fit and its SQL twin add in different orders and agree to about 1e-6 kWh.
    return _rounded(ml.predict(rows, model).select("house_id", "prediction"), ["prediction"], 1)


@query
def fit_linear(spark, folder):
    train, test = _parts(spark, folder)
    line = ml.fit(train, "linear", "v12")
    quality = metrics.eval_metrics(ml.score_all_models(test, {"linear": line}))
    return _rounded(quality, list(metrics.METRICS), 3)


@query
def predict_batch(spark, folder):
    _, test = _parts(spark, folder)
    return _predicted(test, _model(spark, folder, "linear"))


@query
def save_load_models(spark, folder):
    train, test = _parts(spark, folder)
    root = scratch_path(spark, "models")
    ml.save_models({"linear": ml.fit(train, "linear", "v12")}, root)
    return _predicted(test, ml.load_model(spark, root, "linear"))


def _compared(scored):
    """Predictions with as many digits as their SQL twin shares: trees add up exactly, the line to about 1e-6 kWh."""
    p = F.col("prediction")
    return scored.withColumn("prediction", F.when(F.col("model") == "linear", js_round(p, 1)).otherwise(js_round(p, 5)))


@query
def score_all_models(spark, folder):
    _, test = _parts(spark, folder)
    scored = ml.score_all_models(test, _models(spark, folder))
    return _rounded(_compared(scored), ["y"]).select("house_id", "model", "y", "prediction")


@query
def evaluate_models(spark, folder):
    return _quality(spark, folder, _models(spark, folder), 3)


@query
def score_by_model(spark, folder):
    models = _models(spark, folder)
    checked = validation.validate_vector(views.vector_requests(spark, folder), list(models))
    accepted, _ = validation.split_valid(checked)
    return _compared(ml.score_by_model(accepted, models)).select("house_id", "model", "prediction")


@query
def score_requests(spark, folder):
    """Requests checked, scored by the model they name and appended to the log."""
    path = scratch_path(spark, "log")
    log, _ = ml.score(views.vector_requests(spark, folder), _models(spark, folder), F.col("house_id"),
                      F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    sinks.append_prediction_log(log, path)
    stored = spark.read.schema(schemas.PREDICTION_LOG).parquet(path)
    line = F.when(F.col("model") == "linear", F.col("predicted_value_kwh"))
    return _rounded(stored.select(
        "_id", "house_id", "model", line.alias("linear_prediction"), F.size("features").alias("n_features"),
        F.coalesce(F.try_element_at("meta", F.lit("source")), F.lit("")).alias("source")), ["linear_prediction"], 1)


@query
def train_pipeline(spark, folder):
    """What the whole training job leaves: stored models, ranked by their test metrics."""
    models = _models(spark, folder)
    ranked = metrics.rank_models(metrics.eval_metrics(
        ml.score_all_models(_parts(spark, folder)[1], models)))
    root = _model_roots[spark.sparkContext.applicationId, folder]
    stored = registry.available_models(
        registry.registry_frame(spark), registry.stored_artifacts(spark, root))
    return stored.join(ranked, "model").select("model", "label", "n", "rank")


@query
def top_feature_importances(spark, folder):
    """The features by their share in the gains of the forest."""
    return _rounded(ml.top_importances(ml.feature_importances(_model(spark, folder, "rf"))), ["importance"])


# --- streams -----------------------------------------------------------------------------------


STREAM_PARTS = 4


def _arriving(spark, folder):
    """All events as a stream of several batches, in the order of their ids and so of their time."""
    base = scratch_path(spark, "arriving")
    events = tables.table(spark, folder, "events")
    size = events.agg(F.max("event_id")).first()[0] // STREAM_PARTS + 1
    for i in range(STREAM_PARTS):
        part = events.filter(F.col("event_id").between(i * size, (i + 1) * size - 1))
        part.write.mode("append").parquet(f"{base}/events.parquet")
    files = spark.read.parquet(f"{base}/events.parquet").inputFiles()
    return tables.event_stream(spark, base, files_per_batch=-(-len(files) // STREAM_PARTS))


@query
def stream_ingest(spark, folder):
    """Arriving records, those that repeat an id within the watermark dropped."""
    base = scratch_path(spark, "stream-ingest")
    records = views.event_records(_arriving(spark, folder))
    jobs.run_available(jobs.ingest_writer(records, base, "record_id", "ts"))
    return spark.read.parquet(f"{base}/records").select(
        "record_id", "house_id", "total_consumption_kwh", "outcome",
        F.coalesce("reason", F.lit("")).alias("reason"))


@query
def stream_score(spark, folder):
    base = scratch_path(spark, "stream-score")
    _, test = _parts(spark, folder)
    line = _model(spark, folder, "linear")
    test.write.parquet(f"{base}/requests")
    arriving = spark.readStream.schema(test.schema).parquet(f"{base}/requests")
    jobs.run_available(jobs.score_writer(arriving.drop(TARGET), line, base))
    log = spark.read.parquet(f"{base}/log")
    return _rounded(log.select("house_id", F.col("predicted_value_kwh").alias("prediction")),
                    ["prediction"], 1)


def _out_of_order(spark, folder, without_id=False):
    """All events as a stream of several batches, each row up to half a day after its time; rows without an id if asked."""
    base = scratch_path(spark, "arriving")
    events = tables.table(spark, folder, "events")
    late = F.col("event_id") * 7919 % 43200
    arrival = F.unix_timestamp(F.col("ts").cast("timestamp")) + (F.coalesce(late, F.lit(0)) if without_id else late)
    first, last = events.agg(F.min(arrival), F.max(arrival)).first()
    part = F.floor((arrival - first) * STREAM_PARTS / (last - first + 1))
    for i in range(STREAM_PARTS):
        events.filter(part == i).coalesce(1).write.mode("append").parquet(f"{base}/events.parquet")
    return tables.event_stream(spark, base, files_per_batch=1)


@query
def stream_delta(spark, folder):
    """All rows, which arrive out of order, linked in the order of their time: those that the watermark has passed by the
    streams, the others when the input has ended."""
    base = scratch_path(spark, "stream-delta")
    rows = views.reading_columns(_out_of_order(spark, folder, without_id=True))
    jobs.run_available(jobs.bucket_writer(rows, base, "kwh", "ts", "event_id"))
    jobs.run_available(jobs.link_writer(spark, base))
    events = tables.table(spark, folder, "events")
    arrived = views.reading_columns(events.withColumn("ts", F.col("ts").cast("timestamp")))
    linked = jobs.read_deltas(spark, base).unionByName(jobs.rest_deltas(arrived, base, "kwh", "ts", "event_id"))
    return linked.select(
        F.col("row_id").alias("event_id"), "house_id", "kwh", "last_kwh", "delta_kwh", "direction")


@query
def stream_recent_30(spark, folder):
    base = scratch_path(spark, "stream-recent")
    rows = views.reading_columns(_out_of_order(spark, folder))
    jobs.run_available(jobs.newest_writer(rows, base, "ts", "event_id"))
    jobs.run_available(jobs.recent_writer(spark, rows.schema, base, "ts", "event_id"))
    return jobs.read_recent(spark, base).select("event_id", "house_id", "kwh")


@query
def stream_score_by_model(spark, folder):
    """Arriving requests checked and scored by the model that each names, with the rejected ones."""
    base = scratch_path(spark, "stream-requests")
    _models(spark, folder)
    requests = views.vector_requests(spark, folder)
    requests.write.parquet(f"{base}/requests")
    arriving = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/requests")
    root = _model_roots[spark.sparkContext.applicationId, folder]
    jobs.run_available(jobs.score_requests_writer(arriving, root, base))
    return _compared(spark.read.parquet(f"{base}/scored")).select(
        "house_id", "model", "prediction", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def stream_usage_daily(spark, folder):
    base = scratch_path(spark, "stream-daily")
    rows = views.reading_columns(tables.event_stream(spark, folder))
    jobs.run_available(jobs.daily_usage_writer(rows, base, "appliance", "kwh", "ts"))
    daily = spark.read.parquet(f"{base}/daily").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "appliance", "kwh")
    return _rounded(daily, ["kwh"])

"""Training, storing and applying the regression models."""

import math
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.constants import (
    BOOST_RATE,
    BOOST_ROUNDS,
    FEATURE_SPECS,
    FOREST_TREES,
    MODEL_REGISTRY,
    NOISE_SIGMA,
    SEED,
    TARGET,
    TEST_FRACTION,
    TOP_FEATURES,
)
from wattloom.functions.hashing import hash52, uniform
from wattloom.operators.features import add_noise, clean_training, clip_target, select_features
from wattloom.operators.linear import LinearModel, fit_linear
from wattloom.operators.metrics import eval_metrics
from wattloom.operators.quantiles import order_statistics, summaries
from wattloom.operators.registry import stored_artifacts
from wattloom.operators.trees import Prepared, TreeModel, fit_boosted, fit_forest, prepare
from wattloom.operators.validation import split_valid, validate_vector
from wattloom.runtime import ensure_checkpoint_dir, kept

Model = LinearModel | TreeModel
#: Model keys of trees, first that whose fit may be one long task.
TREES = ("gbt", "rf")


@dataclass
class Settings:
    """Model sizes. A tree may have any depth; a node without a gain is a leaf."""

    trees: int = FOREST_TREES
    tree_depth: int = 12
    rounds: int = BOOST_ROUNDS
    boost_depth: int = 6
    #: More than the distinct monthly hours, so their splits are exact.
    bins: int = 64
    seed: int = SEED


def train_test_split(
    df: DataFrame,
    key: str,
    test_fraction: float = TEST_FRACTION,
    seed: int = SEED,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(train, test), decided per row by a hash of its key, so repartitioning changes nothing.

    By default the sizes are close to the fractions. ``exact`` makes the test part the
    ceil(n * fraction) rows of largest hash, found by counting passes instead of a sort.
    """
    salt = f"split{seed}"
    if not exact:
        is_test = uniform(F.col(key), salt) >= 1.0 - test_fraction
        return df.filter(~is_test), df.filter(is_test)
    with kept(df.select(hash52(F.col(key), salt).alias("h"))) as hashed:
        known = summaries(hashed, ["h"])
        rows = known["h"]["count"]
        first_test_rank = rows - math.ceil(rows * test_fraction)
        if not 0 < first_test_rank < rows:
            raise ValueError("both parts of a split need rows")
        border = order_statistics(hashed, {"h": [first_test_rank]}, known)["h", first_test_rank]
    is_test = hash52(F.col(key), salt) >= border
    return df.filter(~is_test), df.filter(is_test)


def _row_key(train: DataFrame, key: str | None) -> Column:
    """What tells rows apart for the bootstrap samples."""
    if key is not None:
        return F.col(key)
    return F.col("house_id") if "house_id" in train.columns else F.concat_ws("|", *train.columns)


def fit(
    train: DataFrame,
    model: str,
    spec: str | list[str] = "v12",
    settings: Settings | None = None,
    target: str = TARGET,
    key: str | None = None,
    ready: Prepared | None = None,
) -> Model:
    """The regressor of a model key, fitted on ``train``; the same rows in any layout give the same trees.

    ``ready``: the rows of ``train`` as ``prepare`` gives them, for trees.
    """
    order = FEATURE_SPECS[spec] if isinstance(spec, str) else spec
    settings = settings or Settings()
    if model == "linear":
        return fit_linear(train, order, target)
    if model == "rf":
        return fit_forest(train, order, target, _row_key(train, key), settings.trees, settings.tree_depth,
                          settings.bins, settings.seed, ready=ready)
    if model == "gbt":
        return fit_boosted(train, order, target, settings.rounds, settings.boost_depth, BOOST_RATE, settings.bins,
                           ready=ready)
    raise KeyError(f"unknown model key: {model}")


def fit_all(
    train: DataFrame,
    models: list[str],
    spec: str | list[str] = "v12",
    settings: Settings | None = None,
    target: str = TARGET,
    key: str | None = None,
    root: str | None = None,
) -> dict[str, Model]:
    """Every model of ``models``, from rows that are read once; the fits share the cores, as one may be a single task.

    The trees share the rows' cuts as well. With ``root`` each model is stored there as soon as it is fitted.
    """

    def fitted(m: str, rows: DataFrame, ready: Prepared | None = None) -> Model:
        model = fit(rows, m, spec, settings, target, key, ready)
        if root:
            save_models({m: model}, root)
        return model

    if len(models) == 1:
        return {m: fitted(m, train) for m in models}
    order = FEATURE_SPECS[spec] if isinstance(spec, str) else spec
    with kept(train) as rows, ThreadPoolExecutor(max(1, len(models))) as pool:
        rows.count()
        ensure_checkpoint_dir(rows.sparkSession)

        def start(m: str, ready: Prepared | None = None) -> Future:
            return pool.submit(inheritable_thread_target(rows.sparkSession)(fitted), m, rows, ready)

        running = {m: start(m) for m in models if m not in TREES}
        if trees := [m for m in TREES if m in models]:
            ready = prepare(rows, order, target, (settings or Settings()).bins, _row_key(rows, key))
            running |= {m: start(m, ready) for m in trees}
        return {m: running[m].result() for m in models}


def predict(df: DataFrame, model: Model, name: str = "prediction") -> DataFrame:
    """Add the model's prediction; predictions are not clipped at 0, and a missing feature is an error."""
    return model.predict(df, name)


def score_all_models(
    df: DataFrame, models: dict[str, Model], actual: str | None = TARGET
) -> DataFrame:
    """Every row scored by every model, as rows with ``model``, ``y`` and ``prediction``.

    The models run one after the other over the same row, so the input is read once.
    """
    kept = list(df.columns)
    for key, model in models.items():
        df = predict(df, model, f"_by_{key}")
    pairs = F.array(*[
        F.struct(F.lit(key).alias("model"), F.col(f"_by_{key}").alias("prediction"))
        for key in models
    ])
    actual_column = [F.col(actual).alias("y")] if actual else []
    return df.select(*kept, *actual_column, F.explode(pairs).alias("_p")).select(
        *kept, *(["y"] if actual else []), "_p.model", "_p.prediction")


def predict_vectors(
    requests: DataFrame, model: Model, features: str = "features",
    name: str = "prediction",
) -> DataFrame:
    """``predict`` for rows whose features already stand in an array in the model's order."""
    return requests.withColumn(name, _of_vector(model, features))


def _of_vector(model: Model, features: str, where: Column | None = None) -> Column:
    return model.score([F.get(features, i).cast("double") for i in range(len(model.order))], where)


def score_by_model(
    requests: DataFrame, models: dict[str, Model], column: str = "model"
) -> DataFrame:
    """Score each request with the model it names; rows naming no given model are left out.

    The requests are read once, and trees are walked for the rows that name them.
    """
    named = F.col(column)
    found = F.lit(None).cast("double")
    for key, model in models.items():
        found = F.when(named == key, _of_vector(model, "features", named == key)).otherwise(found)
    return requests.filter(named.isin(*models)).withColumn("prediction", found)


def score(
    requests: DataFrame, models: dict[str, Model], row_id: Column, at: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(log rows of the valid requests, rejected requests with ``reason``)."""
    accepted, rejected = split_valid(validate_vector(requests, list(models)))
    return to_log(score_by_model(accepted, models), row_id, at), rejected


def to_log(scored: DataFrame, row_id: Column, at: Column | None = None) -> DataFrame:
    """Scored requests as prediction-log rows, by default with the present time.

    Missing ``meta`` becomes an empty map.
    """
    empty = F.create_map().cast("map<string,string>")
    return scored.select(
        row_id.cast("string").alias("_id"),
        F.col("house_id").cast("string").alias("house_id"),
        "model",
        F.col("prediction").alias("predicted_value_kwh"),
        "features",
        F.coalesce(F.col("meta"), empty).alias("meta"),
        (F.localtimestamp() if at is None else at).alias("timestamp"),
    )


def feature_importances(model: Model, spec: str | list[str] = "v12") -> DataFrame:
    """(feature, importance) of a tree model; the linear model has none."""
    if not isinstance(model, TreeModel):
        raise ValueError("the model has no feature importances")
    order = FEATURE_SPECS[spec] if isinstance(spec, str) else spec
    rows = [(name, float(v)) for name, v in zip(order, model.importances())]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")


def top_importances(importances: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def save_models(models: dict[str, Model], root: str) -> None:
    """Store each model under its registry path."""
    for key, model in models.items():
        model.save(SparkSession.active(), f"{root}/{MODEL_REGISTRY[key][0]}")


def load_model(spark, root: str, key: str) -> Model:
    """Load one model: KeyError for an unknown key, FileNotFoundError for one not stored.

    A damaged model is an error.
    """
    if key not in MODEL_REGISTRY:
        raise KeyError(f"unknown model key: {key}")
    path = MODEL_REGISTRY[key][0]
    if stored_artifacts(spark, root, {key: MODEL_REGISTRY[key]}).isEmpty():
        raise FileNotFoundError(f"{root}/{path}")
    return (LinearModel if key == "linear" else TreeModel).load(spark, f"{root}/{path}")


def load_models(spark, root: str, keys: Sequence[str]) -> dict[str, Model]:
    """``load_model`` of each key, all at the same time."""
    with ThreadPoolExecutor(max(1, len(keys))) as pool:
        running = {key: pool.submit(inheritable_thread_target(spark)(load_model), spark, root, key) for key in keys}
        return {key: loaded.result() for key, loaded in running.items()}


@dataclass
class Training:
    """What a training run leaves behind."""

    models: dict[str, Model]
    metrics: DataFrame
    scored: DataFrame


def prepare_training(
    table: DataFrame,
    spec: str = "v12",
    key: str = "house_id",
    sigma: float = NOISE_SIGMA,
    seed: int = SEED,
) -> DataFrame:
    """Clean rows, noisy and clipped target, features in order."""
    if TARGET not in table.columns:
        raise ValueError(f"target column {TARGET} is missing")
    order = FEATURE_SPECS[spec]
    usable = clean_training(table, order)
    noisy = clip_target(add_noise(usable, key, sigma=sigma, seed=seed))
    return select_features(noisy, order, keep=[key, TARGET])


def train_models(
    table: DataFrame,
    spec: str = "v12",
    key: str = "house_id",
    settings: Settings | None = None,
    models: list[str] | None = None,
    root: str | None = None,
) -> Training:
    """Clean, add noise, split, fit every model, evaluate on the test part, store."""
    settings = settings or Settings()
    rows = prepare_training(table, spec, key, seed=settings.seed)
    train, test = train_test_split(rows, key, seed=settings.seed)
    fitted = fit_all(train, models or list(MODEL_REGISTRY), spec, settings, key=key, root=root)
    scored = score_all_models(test, fitted)
    return Training(fitted, eval_metrics(scored), scored)

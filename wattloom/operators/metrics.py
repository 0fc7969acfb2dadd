"""Model evaluation over rows (model, y, prediction)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _error() -> Column:
    return F.col("y") - F.col("prediction")


def rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def mae() -> Column:
    return F.avg(F.abs(_error()))


def r2() -> Column:
    """1 - SSres / SStot; for a constant y, 1 if every prediction is exact and 0 otherwise."""
    residual = F.sum(_error() * _error())
    total = F.var_pop("y") * F.count("y")
    constant = F.min("y") == F.max("y")
    return F.when(constant, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - F.try_divide(residual, total))


def mape_safe() -> Column:
    """Mean absolute percentage error over rows with y != 0; null if there is none."""
    ratio = F.abs(_error() / F.nullif(F.col("y"), F.lit(0.0)))
    return F.avg(ratio) * 100.0


def smape() -> Column:
    """Symmetric percentage error over rows where y or the prediction is not 0."""
    size = F.abs("y") + F.abs("prediction")
    return F.avg(2.0 * F.abs(_error()) / F.nullif(size, F.lit(0.0))) * 100.0


METRICS = {"RMSE": rmse, "MAE": mae, "R2": r2, "MAPE_safe": mape_safe, "SMAPE": smape}


def metric(scored: DataFrame, name: str) -> DataFrame:
    return scored.groupBy("model").agg(METRICS[name]().alias(name))


def eval_metrics(scored: DataFrame) -> DataFrame:
    """All metrics per model in one pass."""
    return scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), *[make().alias(name) for name, make in METRICS.items()])


def residuals(scored: DataFrame) -> DataFrame:
    return scored.withColumn("residual", _error())


def pred_vs_actual(scored: DataFrame) -> DataFrame:
    """Pairs of actual and predicted values with the ends of the model's diagonal."""
    bounds = scored.groupBy("model").agg(
        F.min(F.least("y", "prediction")).alias("diagonal_min"),
        F.max(F.greatest("y", "prediction")).alias("diagonal_max"))
    return scored.join(bounds, "model")


def rank_models(metrics: DataFrame) -> DataFrame:
    """Rank models by lowest MAPE, then highest R2; the table has one row per model."""
    best_first = Window.orderBy(
        F.col("MAPE_safe").asc_nulls_last(), F.col("R2").desc_nulls_last(), F.col("model"))
    return metrics.withColumn("rank", F.row_number().over(best_first))

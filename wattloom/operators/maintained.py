"""Statistics that are kept up to date: each delivery of rows is read once and leaves mergeable parts.

A part has, for one month and one column (and one key, such as a model), the number of values, their mean, the sum of
squared deviations from it, the smallest and largest value, and a KLL sketch of the values. Counts and moments merge exactly but
for rounding; a quantile of merged sketches has a rank within ``rank_error`` of the wanted one, and is exact while there
are no more values than ``SKETCH``. Parts of a delivery are stored under its name, so a repeated delivery replaces itself.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Size of the sketches: values that one holds before it starts to thin them out.
SKETCH = 32768


def rank_error(size: int = SKETCH) -> float:
    """Published bound of a KLL sketch's rank error, as a share of all values, at 99 % confidence."""
    return 2.296 / size ** 0.9021


def parts(rows: DataFrame, month: Column, values: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One row for each key, month and value name; nulls and NaN don't count."""
    keys = keys or []
    long = rows.select(*keys, month.alias("month"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.when(~F.isnan(x.cast("double")), x.cast("double") + 0.0).alias("x"))
        for name, x in values.items()])).alias("v")).select(*keys, "month", "v.*").filter("x IS NOT NULL")
    return long.groupBy(*keys, "month", "name").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"),
        F.min("x").alias("low"), F.max("x").alias("high"), F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("sketch"))


def deliver(new: DataFrame, root: str, name: str) -> None:
    """Store the parts of one delivery; earlier ones are not read."""
    new.write.mode("overwrite").partitionBy("month").parquet(f"{root}/delivery={name}")


def stored_parts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def merged(stored: DataFrame, by: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """count, mean, std (of the sample), std_pop, min, max and the named quantiles, for each ``by`` and name."""
    groups = [*by, "name"]
    of_group = Window.partitionBy(*groups)
    # A few parts a month; the mean of all first, so that squares of differences don't cancel.
    mean = F.sum(F.col("n") * F.col("mean")).over(of_group) / F.sum("n").over(of_group)
    spread = stored.withColumn("_mean", mean).withColumn(
        "_m2", F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    count, m2 = F.sum("n"), F.sum("_m2")
    one = spread.groupBy(*groups).agg(
        count.alias("count"), F.max("_mean").alias("mean"),
        F.when(count > 1, F.sqrt(m2 / F.nullif(count - 1, F.lit(0)))).alias("std"), F.sqrt(m2 / count).alias("std_pop"),
        F.min("low").alias("min"), F.max("high").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("_sketch"))
    return one.select(*groups, "count", "mean", "std", "std_pop", "min", "max", *[
        F.kll_sketch_get_quantile_double("_sketch", F.lit(q)).alias(q_name) for q_name, q in (quantiles or {}).items()])


def error_values(y: Column, prediction: Column) -> dict[str, Column]:
    """What the evaluation metrics are means of."""
    size = F.abs(y) + F.abs(prediction)
    return {
        "y": y, "error": y - prediction, "absolute": F.abs(y - prediction),
        "share": F.abs((y - prediction) / F.nullif(y, F.lit(0.0))),
        "two_sided": 2 * F.abs(prediction - y) / F.nullif(size, F.lit(0.0)),
    }


def metrics_of(stored: DataFrame, by: list[str]) -> DataFrame:
    """The evaluation metrics from stored parts of ``error_values``: n, RMSE, MAE, R2, MAPE_safe, SMAPE."""
    found = merged(stored, by).select(*by, "name", F.struct("count", "mean", "std_pop", "min", "max").alias("s"))

    def of(name: str, field: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("s")[field]))

    squares = of("error", "std_pop") * of("error", "std_pop") + of("error", "mean") * of("error", "mean")
    variance = of("y", "std_pop") * of("y", "std_pop")
    constant = of("y", "min") == of("y", "max")
    r2 = F.when(constant, F.when(squares == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(squares, variance))
    return found.groupBy(*by).agg(
        of("y", "count").alias("n"), F.sqrt(squares).alias("RMSE"), of("absolute", "mean").alias("MAE"), r2.alias("R2"),
        (of("share", "mean") * 100).alias("MAPE_safe"), (of("two_sided", "mean") * 100).alias("SMAPE"))

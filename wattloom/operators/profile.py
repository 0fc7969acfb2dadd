"""Profiles of the training table: target summary, thresholds, outlier flags."""

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.constants import TARGET
from wattloom.operators.quantiles import exact_quantiles, summaries
from wattloom.runtime import kept


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, quartiles, max."""
    with kept(df.select(*columns)) as values:
        stats = summaries(values, columns)
        quartiles = exact_quantiles(values, {c: [0.25, 0.5, 0.75] for c in columns}, stats)
    rows = [
        (c, s["count"], s["mean"], s["std"], s["min"], *quartiles[c], s["max"])
        for c, s in stats.items()
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "column string, count long, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double",
    )


def zero_target_rows(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.filter(F.col(target) == 0)


def count_zero_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.agg(F.count_if(F.col(target) == 0).alias("zeros"))


@dataclass
class Thresholds:
    grid_p95: float
    grid_p99: float
    monthly_min: float
    monthly_max: float
    total_power_p99: float

    def frame(self, spark: SparkSession) -> DataFrame:
        values = asdict(self)
        return spark.createDataFrame(
            [tuple(values.values())], ", ".join(f"{name} double" for name in values))


def thresholds(df: DataFrame) -> Thresholds:
    """Upper percentiles of grid consumption and power, range of the monthly hours."""
    grid, power, hours = "GridConsumption_kWh", "total_appliance_power", "MonthlyHours"
    with kept(df.select(grid, power, hours)) as values:
        stats = summaries(values, [grid, power, hours])
        found = exact_quantiles(values, {grid: [0.95, 0.99], power: [0.99]}, stats)
    return Thresholds(
        *found[grid], stats[hours]["min"], stats[hours]["max"], found[power][0])


def outlier_flags(df: DataFrame, limits: Thresholds) -> DataFrame:
    """Flag rows beyond the thresholds; a missing value is never an outlier."""
    grid, hours = F.col("GridConsumption_kWh"), F.col("MonthlyHours")
    flags = {
        "grid_above_p95": grid > limits.grid_p95,
        "grid_above_p99": grid > limits.grid_p99,
        "hours_outside": (hours < limits.monthly_min) | (hours > limits.monthly_max),
        "power_above_p99": F.col("total_appliance_power") > limits.total_power_p99,
    }
    return df.withColumns({n: F.coalesce(f, F.lit(False)) for n, f in flags.items()})

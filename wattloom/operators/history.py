"""The prediction history: lookups, recent rows, differences, chart data."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.constants import (
    BAND_GREEN_UP_TO,
    BAND_RED_ABOVE,
    HISTORY_DEFAULT,
    HISTORY_MAX,
    KWH_NAMES,
    RECENT_PER_HOUSE,
)
from wattloom.functions.rounding import half_up
from wattloom.operators.ordering import HOT_ROWS, number_in_order, previous_in_order


def household_by_id(records: DataFrame, house_id) -> DataFrame:
    """All records of one house; none for an unknown id."""
    return records.filter(F.col("house_id") == F.lit(house_id))


def households_by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """All records of the houses listed in ``ids(house_id)``."""
    return records.join(ids.select("house_id"), "house_id", "left_semi")


def filter_model(log: DataFrame, model: str | None) -> DataFrame:
    """The log of one model; no model or an empty name means all."""
    return log.filter(F.col("model") == model) if model else log


def prediction_history(
    log: DataFrame, limit: int = HISTORY_DEFAULT, model: str | None = None
) -> DataFrame:
    """The newest ``limit`` predictions, newest first; equal times are ordered by id."""
    if not 1 <= limit <= HISTORY_MAX:
        raise ValueError(f"limit must be between 1 and {HISTORY_MAX}")
    newest = [F.col("timestamp").desc(), F.col("_id").desc()]
    return filter_model(log, model).orderBy(*newest).limit(limit)


def recent_per_house(
    log: DataFrame, n: int = RECENT_PER_HOUSE, time: str = "timestamp", row_id: str = "_id"
) -> DataFrame:
    """The newest n rows of each house.

    The rank filter also runs before the shuffle, so a hot house sends n rows per input task.
    """
    newest = Window.partitionBy("house_id").orderBy(F.col(time).desc(), F.col(row_id).desc())
    return log.withColumn("_rank", F.row_number().over(newest)).filter(
        F.col("_rank") <= n).drop("_rank")


def change(value: Column, last: Column) -> tuple[Column, Column]:
    """(difference, direction) against the last value; both null without one."""
    delta = value - last
    return delta, F.when(delta >= 0, "up").when(delta < 0, "down")


def delta_vs_last(
    log: DataFrame,
    value: str = "predicted_value_kwh",
    time: str = "timestamp",
    row_id: str = "_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the house's previous value, the difference and its direction."""
    linked = previous_in_order(log, "house_id", [time, row_id], value, "last_kwh", hot_rows)
    delta, direction = change(F.col(value), F.col("last_kwh"))
    return linked.withColumn("delta_kwh", delta).withColumn("direction", direction)


def prediction_band(value: Column) -> Column:
    """Traffic-light band of a prediction."""
    return (
        F.when(value <= BAND_GREEN_UP_TO, "green")
        .when(value > BAND_RED_ABOVE, "red").otherwise("orange")
    )


def gauge_pct(value: Column, last: Column) -> Column:
    """Gauge position of a value relative to the last one, at most 100."""
    reference = F.greatest(F.lit(1.0), F.coalesce(F.nullif(last, F.lit(0.0)), value))
    return F.least(F.lit(100.0), half_up(value / reference * 50.0 + 10.0))


def chart_date(date: Column, at: Column) -> Column:
    """Label of a chart point: the date, else the day of the timestamp, else a dash."""
    day = F.substring(at.cast("string"), 1, 10)
    return F.coalesce(F.nullif(date, F.lit("")), day, F.lit("-"))


def first_present_kwh(records: DataFrame) -> Column:
    """The first kWh value a record carries under any accepted name, else 0."""
    present = [F.col(name) for name in KWH_NAMES if name in records.columns]
    return F.coalesce(*present, F.lit(0.0))


def chart_series(records: DataFrame, row_id: str = "_id") -> DataFrame:
    """Chart points (position, id, label, kwh), oldest first; a record without time comes first."""
    given = F.nullif(F.col("date"), F.lit("")).try_cast("timestamp_ntz")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    points = records.select(
        F.coalesce(given, F.col("timestamp"), epoch).alias("_at"),
        F.col(row_id).alias("_id"),
        chart_date(F.col("date"), F.col("timestamp")).alias("label"),
        first_present_kwh(records).alias("kwh"),
    )
    numbered = number_in_order(points, [F.col("_at").asc(), F.col("_id").asc()], "position")
    return numbered.select("position", "_id", "label", "kwh")


def monthly_trend(
    log: DataFrame, value: str = "predicted_value_kwh", time: str = "timestamp"
) -> DataFrame:
    """Sum and mean kWh per calendar month."""
    month = F.substring(F.col(time).cast("string"), 1, 7)
    return log.groupBy(month.alias("month")).agg(
        F.sum(value).alias("sum_kwh"), F.avg(value).alias("mean_kwh"))

"""Appliance inventories: rows (house_id, ord, name, power in W, hours per day, qty)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.constants import (
    DAYS_PER_MONTH,
    DEFAULT_WATTS,
    STANDBY_APPLIANCES,
    USAGE_MAP_NAMES,
)
from wattloom.functions.coercion import or_one, or_zero
from wattloom.functions.rounding import js_round


def daily_wh() -> Column:
    """Wh per day of an inventory row; an empty or zero quantity counts as one."""
    return or_zero(F.col("power")) * or_zero(F.col("hours")) * or_one(F.col("qty"))


def household_consumption(inventory: DataFrame) -> DataFrame:
    """Daily and monthly kWh per house."""
    return (
        inventory.groupBy("house_id")
        .agg((F.sum(daily_wh()) / 1000.0).alias("daily_kwh"))
        .withColumn("monthly_kwh", F.col("daily_kwh") * DAYS_PER_MONTH)
    )


def daily_total(inventory: DataFrame) -> DataFrame:
    """Daily and monthly kWh of all houses together."""
    total = F.sum(daily_wh()) / 1000.0
    return inventory.agg(total.alias("daily_kwh")).withColumn(
        "monthly_kwh", F.col("daily_kwh") * DAYS_PER_MONTH)


def import_appliances(inventory: DataFrame) -> DataFrame:
    """Total power, number of appliances and mean power per house; hours play no part.

    The mean divides the unrounded total. A count of zero falls back to the number of rows.
    """
    qty = or_one(F.col("qty"))
    sums = inventory.groupBy("house_id").agg(
        F.sum(or_zero(F.col("power")) * qty).alias("_power"),
        F.sum(qty).alias("_count"),
        F.count(F.lit(1)).cast("double").alias("_rows"),
    )
    counted = F.col("_count") != 0
    return sums.select(
        "house_id",
        js_round(F.col("_power")).alias("total_appliance_power"),
        F.when(counted, F.col("_count")).otherwise(F.col("_rows")).alias("appliance_count"),
        F.when(counted, js_round(F.col("_power") / F.col("_count"))).otherwise(0.0)
        .alias("avg_power_per_appliance"),
    )


def appliance_usage(inventory: DataFrame) -> DataFrame:
    """Usage (hours x quantity) per house and appliance; of equal names the last row counts.

    ``ord`` may be any orderable column; a number or timestamp aggregates by hash, a struct by
    sorting.
    """
    usage = or_zero(F.col("hours")) * or_one(F.col("qty"))
    return inventory.groupBy("house_id", "name").agg(
        F.max_by(usage, F.col("ord")).alias("usage"))


def appliance_usage_map(inventory: DataFrame) -> DataFrame:
    """``appliance_usage`` as one map per house.

    The list built per house holds its distinct appliance names, already reduced to one row each.
    """
    entries = F.collect_list(F.struct("name", "usage"))
    return (
        appliance_usage(inventory).groupBy("house_id")
        .agg(F.map_from_entries(entries).alias("appliance_usage"))
    )


def household_records(inventory: DataFrame, dates: DataFrame) -> DataFrame:
    """The record of each house: its date, usage map and monthly kWh as total consumption.

    ``dates`` has one (house_id, date) per house.
    """
    monthly = household_consumption(inventory).select(
        "house_id", F.col("monthly_kwh").alias("total_consumption_kwh"))
    return appliance_usage_map(inventory).join(monthly, "house_id").join(dates, "house_id")


def usage_by_appliance(records: DataFrame) -> DataFrame:
    """Total usage per appliance name over records that carry a usage map.

    The map is the first present one of the accepted column names; unreadable values count 0.
    """
    maps = [F.col(name) for name in USAGE_MAP_NAMES if name in records.columns]
    return (
        records.select(F.explode(F.coalesce(*maps)).alias("name", "value"))
        .groupBy("name")
        .agg(F.sum(or_zero(F.col("value"))).alias("usage"))
    )


def appliance_watts(
    rows: DataFrame, watts: dict[str, float] = DEFAULT_WATTS, name: str = "watts"
) -> DataFrame:
    """Watts of (name, mode, value): a count times the appliance's watts, or watts as given.

    Mode "power" passes the value through, any other or no mode counts appliances. Unknown
    appliances have 0 W, an empty value is 0.
    """
    return rows.withColumn(name, watts_of(F.col("name"), F.col("mode"), F.col("value"), watts))


def watts_of(
    name: Column, mode: Column, value: Column, watts: dict[str, float] = DEFAULT_WATTS
) -> Column:
    table = F.create_map(*[F.lit(x) for pair in watts.items() for x in pair])
    each = F.coalesce(F.try_element_at(table, name), F.lit(0.0))
    value = or_zero(value)
    return F.when(mode == "power", value).otherwise(js_round(value * each))


def standby_energy(
    inventory: DataFrame, standby: list[str] = STANDBY_APPLIANCES
) -> DataFrame:
    """Daily kWh of the standby appliances per house, and their share of the house's total."""
    idle = F.when(F.col("name").isin(*standby), daily_wh()).otherwise(0.0)
    return (
        inventory.groupBy("house_id")
        .agg((F.sum(idle) / 1000.0).alias("standby_kwh"),
             (F.sum(daily_wh()) / 1000.0).alias("daily_kwh"))
        .withColumn("standby_share", F.try_divide("standby_kwh", "daily_kwh"))
    )

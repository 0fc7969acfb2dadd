"""The domain's tables, derived from the star-schema and event tables at hand.

Some cells are blanked or damaged by rule so that defaults and rejections have rows to act on.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.constants import FEATURE_SPECS, TARGET
from wattloom.operators.appliances import appliance_usage_map, import_appliances
from wattloom.sources.tables import table

# What the generated codes stand for.
APPLIANCE_OF_TYPE = {
    "ECONOMY": "Fan",
    "LARGE": "AirConditioner",
    "MEDIUM": "Refrigerator",
    "PROMO": "Television",
    "SMALL": "Monitor",
    "STANDARD": "MotorPump",
}
MODEL_OF_PRIORITY = {"1-URGENT": "linear", "2-HIGH": "rf", "3-MEDIUM": "gbt"}
UNIT_OF_EVENT = {"view": "Wh", "click": "kWh", "purchase": "MWh", "signup": "kWh"}
COMPANY_CODES = {
    "AUTOMOBILE": 0.0, "BUILDING": 1.0, "FURNITURE": 2.0, "HOUSEHOLD": 3.0, "MACHINERY": 4.0,
}


def _lookup(table_: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in table_.items() for x in p]), key)


def _every(n: int, key: str, rest: int = 0) -> Column:
    return F.col(key) % n == rest


def _line_order() -> Column:
    """Line number, part, supplier, price and date as one number, so that the last row is found by hash."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    parts = [("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 9), (cents, 11), (F.unix_date(
        F.col("l_shipdate").cast("date")), 5)]
    digits = [F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), n, "0") for c, n in parts]
    return F.concat(*digits).cast("decimal(38,0)")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(house_id, ord, name, power, hours, qty): one row per order line."""
    lines = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("house_id"),
        _line_order().alias("ord"),
        _lookup(APPLIANCE_OF_TYPE, F.col("p_type")).alias("name"),
        (F.col("p_size") * 10).cast("double").alias("power"),
        (F.col("l_suppkey") % 25).cast("double").alias("hours"),
        (F.col("l_linenumber") - 1).cast("double").alias("qty"),
    )


def households(spark: SparkSession, folder: str) -> DataFrame:
    """Household records as they arrive: padded ids, dates in several notations, some invalid."""
    usage = appliance_usage_map(inventory(spark, folder))
    orders = table(spark, folder, "orders")
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    date = (
        F.when(_every(10, "o_orderkey", 1), F.concat(day, F.lit("T10:20:30")))
        .when(_every(10, "o_orderkey", 2), F.concat(day, F.lit(" 23:15:00+05:30")))
        .when(_every(10, "o_orderkey", 3), F.replace(day, F.lit("-"), F.lit("")))
        .when(_every(10, "o_orderkey", 4), F.concat(F.lit("  "), day, F.lit(" ")))
        .when(_every(10, "o_orderkey", 5), F.concat(day, F.lit("T01:02:03.250Z")))
        .when(_every(40, "o_orderkey", 6), F.substring(day, 1, 7))
        .when(_every(40, "o_orderkey", 7), F.concat(F.substring(day, 1, 5), F.lit("13-05")))
        .when(_every(40, "o_orderkey", 8), "yesterday")
        .otherwise(day)
    )
    broken = F.transform_values(
        "appliance_usage", lambda k, v: F.when(k == "Fan", -1.0 - v).otherwise(v))
    return orders.join(usage, F.col("o_orderkey") == F.col("house_id")).select(
        F.col("o_orderkey").alias("record_id"),
        F.when(_every(97, "o_orderkey"), "  ")
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("house_id"),
        date.alias("date"),
        F.when(_every(20, "o_orderkey"), broken).otherwise(F.col("appliance_usage"))
        .alias("appliance_usage"),
        (F.col("o_totalprice") / 1000).alias("total_consumption_kwh"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The prediction log: one row per order."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("_id"),
        F.col("o_custkey").alias("house_id"),
        F.col("o_orderdate").alias("timestamp"),
        (F.col("o_totalprice") / 1000).alias("predicted_value_kwh"),
        F.coalesce(_lookup(MODEL_OF_PRIORITY, F.col("o_orderpriority")), F.lit("unknown"))
        .alias("model"),
    )


def dashboard_records(spark: SparkSession, folder: str) -> DataFrame:
    """History records in the mixed shapes a dashboard gets: some without date, time or value."""
    log = predictions(spark, folder)
    value = F.col("predicted_value_kwh")
    return log.select(
        "_id",
        "house_id",
        F.when(_every(3, "_id"), F.substring(F.col("timestamp").cast("string"), 1, 10))
        .when(_every(3, "_id", 1), "").alias("date"),
        F.when(_every(5, "_id") | _every(5, "_id", 3), F.lit(None)).otherwise(F.col("timestamp"))
        .alias("timestamp"),
        F.when(_every(4, "_id"), value).alias("predicted_kwh"),
        F.when(_every(4, "_id", 1) | _every(8, "_id"), value + 1)
        .alias("total_consumption_kwh"),
        F.when(_every(4, "_id", 2), value + 2).alias("estimated_kwh"),
    )


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Appliance readings: one row per event."""
    return reading_columns(table(spark, folder, "events"))


def reading_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("user_id").alias("house_id"),
        "ts",
        F.col("event_type").alias("appliance"),
        F.col("value").alias("kwh"),
        F.get_json_object("props", "$.k").cast("double").alias("hours"),
    )


def readings_with_unit(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "value", _lookup(UNIT_OF_EVENT, F.col("event_type")).alias("unit"))


def event_records(events: DataFrame) -> DataFrame:
    """Household records out of events, for the ingest stream."""
    value = F.when(_every(20, "event_id"), -F.col("value")).otherwise(F.col("value"))
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    return events.select(
        F.col("event_id").alias("record_id"),
        "ts",
        F.when(_every(50, "event_id", 7), "").otherwise(F.col("user_id").cast("string"))
        .alias("house_id"),
        F.when(_every(30, "event_id", 1), F.substring(day, 1, 7)).otherwise(day).alias("date"),
        F.create_map(F.col("event_type"), value).alias("appliance_usage"),
        F.col("value").alias("total_consumption_kwh"),
    )


def houses_dim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("house_id"),
        (F.col("c_nationkey") % 6).alias("city_code"),
        F.col("c_mktsegment").alias("company"),
    )


def solar_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("request_id"),
        (F.col("p_retailprice") / 100).alias("daily_kwh"),
        (F.col("p_size") % 9).cast("double").alias("sun_hours"),
        (F.col("p_size") * 10).cast("double").alias("panel_watt"),
        F.when(~_every(3, "p_partkey"), 0.8).alias("efficiency"),
    )


def training(spark: SparkSession, folder: str) -> DataFrame:
    """One training row per house with the twelve features and a target without noise."""
    power = import_appliances(inventory(spark, folder)).withColumnRenamed("house_id", "_house")
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer")
    joined = power.join(orders, F.col("_house") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey"))
    base = joined.select(
        F.col("o_orderkey").alias("house_id"),
        "total_appliance_power",
        "appliance_count",
        "avg_power_per_appliance",
        (240 + 10 * (F.col("o_orderkey") % 50)).cast("double").alias("MonthlyHours"),
        (3 + F.col("o_custkey") % 10).cast("double").alias("TariffRate"),
        F.lit(0.0).alias("consumption_per_hour"),
        (F.col("o_orderkey") % 100).cast("double").alias("SolarGeneration_kWh"),
        (F.col("o_totalprice") / 1000).alias("GridConsumption_kWh"),
        F.month("o_orderdate").cast("double").alias("Month_num"),
        (F.col("c_nationkey") % 6).cast("double").alias("City_code"),
        _lookup(COMPANY_CODES, F.col("c_mktsegment")).alias("Company_code"),
    )
    sold = F.greatest(F.lit(0.0), F.col("SolarGeneration_kWh") - F.col("GridConsumption_kWh"))
    target = (
        0.0001 * F.col("total_appliance_power") * F.col("MonthlyHours") + 0.5 * F.col("Month_num"))
    return base.withColumn("EnergySold_kWh", sold).withColumn(TARGET, target).select(
        "house_id", *FEATURE_SPECS["v12"], TARGET)


def training_raw(spark: SparkSession, folder: str) -> DataFrame:
    """``training`` with missing, NaN and negative cells."""
    nan = F.lit(float("nan"))
    return training(spark, folder).withColumns({
        "GridConsumption_kWh": F.when(_every(37, "house_id"), F.lit(None))
        .otherwise(F.col("GridConsumption_kWh")),
        "MonthlyHours": F.when(_every(41, "house_id"), -F.col("MonthlyHours"))
        .otherwise(F.col("MonthlyHours")),
        "TariffRate": F.when(_every(43, "house_id"), nan).otherwise(F.col("TariffRate")),
        TARGET: F.when(_every(47, "house_id"), F.lit(None)).otherwise(F.col(TARGET)),
    })


def forms(spark: SparkSession, folder: str) -> DataFrame:
    """Form rows as text, with blank, unreadable and out-of-range fields."""
    key = "row_id"

    def text(column):
        return F.col(column).cast("string")

    rows = training(spark, folder).withColumnRenamed("house_id", key)
    return rows.select(
        key,
        F.when(_every(5, key), "").when(_every(17, key), "abc").when(_every(19, key), "-5")
        .when(_every(23, key), " 900 ").otherwise(text("MonthlyHours")).alias("MonthlyHours"),
        F.when(_every(29, key), F.lit(None)).otherwise(text("TariffRate")).alias("TariffRate"),
        F.when(_every(6, key), "  ").otherwise(text("SolarGeneration_kWh"))
        .alias("SolarGeneration_kWh"),
        F.when(_every(7, key), "").when(_every(31, key), "12,5")
        .otherwise(text("GridConsumption_kWh")).alias("GridConsumption_kWh"),
        text("EnergySold_kWh").alias("EnergySold_kWh"),
        F.when(_every(3, key), text("GridConsumption_kWh")).otherwise("").alias("NetBill"),
        (F.col(key) % 4).cast("string").alias("Fan"),
        F.when(_every(2, key), "1").otherwise("").alias("Refrigerator"),
        F.when(_every(11, key), "").when(_every(13, key), "25")
        .otherwise((F.col(key) % 3).cast("string")).alias("AirConditioner"),
        F.when(_every(9, key), "two").otherwise("2").alias("Television"),
        F.lit("1.5").alias("Monitor"),
        F.when(_every(8, key), "750").otherwise("0").alias("MotorPump"),
        F.when(_every(8, key), "power").otherwise("count").alias("MotorPump__mode"),
        F.when(_every(4, key), "").otherwise(text("total_appliance_power"))
        .alias("total_appliance_power"),
        F.when(_every(8, key), text("total_appliance_power")).otherwise("")
        .alias("TotalAppliancePower"),
        F.when(_every(21, key), "0").when(_every(22, key), "")
        .otherwise(text("appliance_count")).alias("appliance_count"),
        F.when(_every(10, key), "").otherwise(text("avg_power_per_appliance"))
        .alias("avg_power_per_appliance"),
        F.lit("0").alias("consumption_per_hour"),
        text("Month_num").alias("Month_num"),
        F.when(_every(12, key), "").otherwise(F.col("City_code").cast("int").cast("string"))
        .alias("City_code"),
        text("Company_code").alias("Company_code"),
    )


def vector_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction requests: twelve features in order, some short, some with a missing value."""
    rows = training(spark, folder)
    full = F.array(*FEATURE_SPECS["v12"])
    broken = F.transform(full, lambda x, i: F.when(i != 5, x))
    model = (
        F.when(_every(4, "house_id"), "linear").when(_every(4, "house_id", 1), "rf")
        .when(_every(4, "house_id", 2), "gbt").otherwise("unknown"))
    return rows.select(
        "house_id",
        model.alias("model"),
        F.when(_every(15, "house_id"), F.slice(full, 1, 11))
        .when(_every(25, "house_id"), broken).otherwise(full).alias("features"),
        F.when(_every(2, "house_id"), F.create_map(F.lit("source"), F.lit("form"))).alias("meta"),
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (house_id, model, y, prediction) of three fixed formulas standing in for models."""
    rows = training(spark, folder)
    label = F.col(TARGET)
    y = F.when(_every(50, "house_id"), 0.0).otherwise(label)
    by_model = {"a": label * 1.01, "b": label + 3.0, "c": F.lit(0.0)}
    pairs = F.array(*[
        F.struct(F.lit(m).alias("model"), p.alias("prediction")) for m, p in by_model.items()])
    return rows.select("house_id", y.alias("y"), F.explode(pairs).alias("p")).select(
        "house_id", "p.model", "y", "p.prediction")

"""Explicit schemas of the records the engine reads and writes."""

from pyspark.sql import types as T

from wattloom.constants import FEATURE_SPECS, TARGET


def training_schema(spec: str) -> T.StructType:
    """House id, the features of ``spec`` in order, and the target."""
    fields = [T.StructField("house_id", T.LongType())]
    fields += [T.StructField(name, T.DoubleType()) for name in FEATURE_SPECS[spec]]
    return T.StructType(fields + [T.StructField(TARGET, T.DoubleType())])


HOUSEHOLD = T.StructType([
    T.StructField("house_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("appliance_usage", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("total_consumption_kwh", T.DoubleType()),
])

PREDICTION_LOG = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("house_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("predicted_value_kwh", T.DoubleType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("timestamp", T.TimestampNTZType()),
])

SOLAR_REQUEST = T.StructType([
    T.StructField("daily_kwh", T.DoubleType()),
    T.StructField("sun_hours", T.DoubleType()),
    T.StructField("panel_watt", T.DoubleType()),
    T.StructField("efficiency", T.DoubleType()),
])

INVENTORY = T.StructType([
    T.StructField("house_id", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("power", T.DoubleType()),
    T.StructField("hours", T.DoubleType()),
    T.StructField("qty", T.DoubleType()),
])

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

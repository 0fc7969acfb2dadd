"""Writing accepted and rejected records, the prediction log, metrics and thresholds."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.operators.profile import Thresholds
from wattloom.operators.validation import outcome, validate_household


def _append(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Append to a partitioned parquet table.

    The rebalance collects the rows of a partition into full files and splits a partition too
    large for one task.
    """
    balanced = df.hint("rebalance", *[F.col(p) for p in partitions])
    balanced.write.mode("append").partitionBy(*partitions).parquet(path)


def _month(at: str) -> Column:
    return F.substring(F.col(at).cast("string"), 1, 7)


def ingest_households(records: DataFrame, path: str) -> None:
    """Validate records and append them in one pass, partitioned by outcome and month.

    outcome=accepted holds the valid records, outcome=rejected the others with their reason.
    """
    month = F.coalesce(_month("at"), F.lit("none"))
    checked = validate_household(records).withColumns({"outcome": outcome(), "month": month})
    _append(checked, path, ["outcome", "month"])


def append_prediction_log(log: DataFrame, path: str) -> None:
    """Append scored requests, partitioned by month."""
    _append(log.withColumn("month", _month("timestamp")), path, ["month"])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metrics table as JSON, one object per model."""
    metrics.write.mode("overwrite").json(path)


def write_thresholds(limits: Thresholds, spark: SparkSession, path: str) -> None:
    limits.frame(spark).coalesce(1).write.mode("overwrite").json(path)

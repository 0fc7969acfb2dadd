"""The registry of models and the models present in storage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wattloom.constants import FEATURE_SPECS, MODEL_REGISTRY


def registry_frame(spark: SparkSession, registry: dict = MODEL_REGISTRY) -> DataFrame:
    """The registry as a table; it has one row per entry of a Python dict, so it can be broadcast."""
    rows = [(key, path, label) for key, (path, label) in registry.items()]
    schema = T.StructType([
        T.StructField(name, T.StringType()) for name in ("model", "path", "label")])
    return spark.createDataFrame(rows, schema)


def stored_artifacts(spark: SparkSession, root: str, registry: dict = MODEL_REGISTRY) -> DataFrame:
    """Table of the registry paths that exist below ``root``, on any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [
        (path,) for path, _ in registry.values()
        if files.exists(jvm.org.apache.hadoop.fs.Path(base, path))
    ]
    return spark.createDataFrame(found, T.StructType([T.StructField("path", T.StringType())]))


def available_models(registry: DataFrame, artifacts: DataFrame, on: str = "path") -> DataFrame:
    """Registry rows whose artifact is present."""
    return registry.join(artifacts.select(on).distinct(), on, "left_semi").select("model", "label")


def known_model_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    return rows.join(registry.select("model"), "model", "left_semi")


def unknown_model_rows(rows: DataFrame, registry: DataFrame) -> DataFrame:
    return rows.join(registry.select("model"), "model", "left_anti")


def model_info(spark: SparkSession, root: str, spec: str = "v12") -> dict:
    """Stored models with labels, the feature order and the folder, for a quick look."""
    stored = available_models(registry_frame(spark), stored_artifacts(spark, root))
    return {
        "available_models": {row["model"]: row["label"] for row in stored.collect()},
        "feature_order": FEATURE_SPECS[spec],
        "model_dir": root,
    }

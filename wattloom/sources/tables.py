"""Reading tables, training files and streams with explicit schemas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattloom import schemas
from wattloom.constants import TARGET


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_training(
    spark: SparkSession, path: str, spec: str = "v12", target: str = TARGET,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A training table from CSV files with a header, or from parquet if ``path`` ends so.

    The header must name the columns of the schema; a table without the target is an error.
    """
    schema = schema or schemas.training_schema(spec)
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        header = spark.read.option("header", True).csv(path).columns
        if target not in header:
            raise ValueError(f"target column {target} is missing in {path}")
        # Column by column in file order, so a reordered file reads the same.
        types = {f.name: f.dataType for f in schema.fields}
        in_file = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
        df = spark.read.schema(in_file).option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    return df.select(*[f.name for f in schema.fields])


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table as a stream, with ``ts`` as a timestamp that watermarks accept."""
    reader = spark.readStream.schema(schemas.EVENTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern the path may name a single file or a folder of files.
    events = reader.parquet(f"{folder}/events.parque[t]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))

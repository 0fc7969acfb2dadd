"""Intermediate tables in the shared folder, removed when they are no longer needed."""

import gc

from pyspark.sql import DataFrame, SparkSession

from wattloom.runtime import scratch_path


class Scratch:
    """Stored steps of one operator run. Only call ``drop`` when no lazy result reads the table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def store(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read again."""
        path = self.paths[name] = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def release(self) -> None:
        """Have Spark's cleaner remove shuffle files of finished steps: it waits for the driver's garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete stored tables and release what their steps shuffled."""
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

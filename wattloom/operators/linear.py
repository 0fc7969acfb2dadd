"""Least squares from one pass of covariances, also where features determine each other."""

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers get what they run from here with the task; they need no path to this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Directions of the scaled features with less than this share of the largest variance count as none.
LEAST_VARIANCE = 1e-10


@dataclass
class LinearModel:
    """``intercept`` plus the features ``order`` times ``coefficients``."""

    order: list[str]
    coefficients: list[float]
    intercept: float

    def score(self, features: list[Column], where: Column | None = None) -> Column:
        """Prediction for the features in order; ``where`` is for models that take longer over a row."""
        total = F.lit(self.intercept)
        for x, c in zip(features, self.coefficients):
            total = total + F.lit(c) * x
        return total

    def predict(self, df: DataFrame, name: str) -> DataFrame:
        missing = F.raise_error(F.lit("a feature is missing")).cast("double")
        return df.withColumn(name, self.score([F.coalesce(F.col(f).cast("double"), missing) for f in self.order]))

    def save(self, spark: SparkSession, path: str) -> None:
        row = [(self.order, self.coefficients, self.intercept)]
        spark.createDataFrame(row, "features array<string>, coefficients array<double>, intercept double").coalesce(
            1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "LinearModel":
        row = spark.read.parquet(path).first()
        return cls(list(row["features"]), list(row["coefficients"]), row["intercept"])


Moments = tuple[np.ndarray, np.ndarray, np.ndarray]


def _merged(a: Moments, b: Moments) -> Moments:
    n, apart = a[0] + b[0], b[1] - a[1]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    # A part without rows has no mean.
    apart = np.where(a[0] * b[0] > 0, apart, 0.0)
    return n, np.where(a[0] > 0, a[1], b[1]) + apart * share, a[2] + b[2] + apart * apart.T * a[0] * share


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By pair of columns, over a task's rows that have both: their number, the first's mean and the sum of the products of
    deviations; one row."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        x = np.where(there > 0, x, 0.0)
        with np.errstate(invalid="ignore", over="ignore"):
            # Close to their means, squares lose nothing.
            center = x.sum(0) / np.maximum(there.sum(0), 1.0)
            x = np.where(there > 0, x - center, 0.0)
            n, s = there.T @ there, x.T @ there
            mean = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
            own = n, mean + center[:, None], x.T @ x - mean * mean.T * n
            total = own if total is None else _merged(total, own)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(m).tobytes()], pa.binary()) for m in total],
                                         names=["n", "mean", "product"])


def fit_linear(train: DataFrame, order: list[str], target: str) -> LinearModel:
    """The least-squares line; of equally good ones, that whose coefficients of the scaled features are smallest.

    Means and covariances merge stably, so the rows are read once, in any layout; a task gives one row of them. Features are scaled by their deviation; directions
    without variance, as of a constant column or of one-hot columns that always add up to 1, get no coefficient.
    """
    columns = train.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*order, target])])
    parts = columns.mapInArrow(_moments, "n binary, mean binary, product binary").collect()
    found = [[np.frombuffer(x).reshape(len(order) + 1, -1) for x in part] for part in parts]
    if not any(n[0, 0] for n, _, _ in found):
        raise ValueError("no rows to fit")
    n, mean, product = reduce(_merged, found)
    with np.errstate(invalid="ignore"):
        means, covariance = np.diag(mean), product / n
    deviation = np.sqrt(np.maximum(np.diag(covariance)[:-1], 0.0))
    scale = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    shares, directions = np.linalg.eigh(covariance[:-1, :-1] * np.outer(scale, scale))
    used = shares > LEAST_VARIANCE * shares.max(initial=0.0)
    along = directions[:, used]
    scaled = along @ ((along.T @ (covariance[:-1, -1] * scale)) / shares[used])
    coefficients = scaled * scale
    return LinearModel(list(order), coefficients.tolist(), float(means[-1] - coefficients @ means[:-1]))

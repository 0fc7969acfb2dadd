"""Positions and neighbours in a sorted order, without putting a whole group into one task.

A window over one hot key, or over the whole table, sorts everything in a single task. Here the
table is cut into consecutive ranges of the full sort key instead: a hot key spans many ranges,
each range is a task, and only one row per range crosses between them.
"""

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.runtime import pinned

_RANGE = "_range"

# A key with more rows than this is spread over ranges rather than sorted in one task.
HOT_ROWS = 5_000_000

# Rows that one task sorts with ease.
ROWS_PER_RANGE = 2_000_000


def in_ranges(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """``df`` with a column ``_range`` that grows along ``order_by``.

    Range borders come from a sample, so the result is pinned: two readers of an unpinned cut
    could see different borders. The number of ranges follows the number of rows.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, df.count() // ROWS_PER_RANGE + 1)
    cut = df.repartitionByRange(ranges, *order_by).withColumn(_RANGE, F.spark_partition_id())
    return pinned(cut)


def number_in_order(df: DataFrame, order_by: list[Column], name: str) -> DataFrame:
    """Number all rows 1, 2, ... along ``order_by``, which should identify a row."""
    cut = in_ranges(df, order_by)
    # One count per range, so as many as there are partitions.
    sizes = sorted(cut.groupBy(_RANGE).agg(F.count(F.lit(1)).cast("long")).collect())
    ends = accumulate(size for _, size in sizes)
    starts = df.sparkSession.createDataFrame(
        [(which, end - size) for (which, size), end in zip(sizes, ends)],
        f"{_RANGE} int, _start long")
    within = F.row_number().over(Window.partitionBy(_RANGE).orderBy(*order_by))
    return (
        cut.withColumn("_within", within)
        .join(F.broadcast(starts), _RANGE)
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop(_RANGE, "_within", "_start")
    )


def previous_in_order(
    df: DataFrame,
    key: str,
    order_by: list[str],
    value: str,
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the ``value`` of the preceding row of the same ``key``; null on the first row.

    Keys with up to ``hot_rows`` rows take a plain window; the few larger ones (at most
    rows / hot_rows of them) are cut into ranges.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = [row[0] for row in sizes.filter(F.col("_rows") > hot_rows).select(key).collect()]
    per_key = Window.partitionBy(key).orderBy(*order_by)
    if not hot:
        return df.withColumn(name, F.lag(value).over(per_key))
    hot_keys = F.broadcast(df.sparkSession.createDataFrame(
        [(k,) for k in hot], df.select(F.col(key).alias("_hot")).schema))
    same = F.col(key).eqNullSafe(F.col("_hot"))
    ordinary = df.join(hot_keys, same, "left_anti").withColumn(name, F.lag(value).over(per_key))
    spread = _previous_across_ranges(
        df.join(hot_keys, same, "left_semi"), key, order_by, value, name)
    return ordinary.unionByName(spread)


def _previous_across_ranges(df, key, order_by, value, name):
    cut = in_ranges(df, [F.col(c) for c in [key, *order_by]])
    per_piece = Window.partitionBy(_RANGE, key).orderBy(*order_by)
    # One row per range and hot key: the last value, handed to the key's next range.
    last = F.max_by(F.struct(value), F.struct(*order_by)).alias("_last")
    ends = cut.groupBy(_RANGE, key).agg(last)
    handed = F.lag("_last").over(Window.partitionBy(key).orderBy(_RANGE))
    carried = ends.select(
        F.col(_RANGE).alias("_to"), F.col(key).alias("_key"), handed[value].alias("_carried"))
    place = F.row_number().over(per_piece)
    return (
        cut.withColumn("_place", place)
        .withColumn(name, F.lag(value).over(per_piece))
        .join(F.broadcast(carried),
              (F.col(_RANGE) == F.col("_to")) & F.col(key).eqNullSafe(F.col("_key")))
        .withColumn(name, F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col(name)))
        .select(*df.columns, name)
    )

"""Totals of groups beside each of their rows, where one group may hold most of the rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has at least one of so many rows; there are at most as many heavy keys.
HEAVY = 1024


def join_totals(rows: DataFrame, keys: list[str], total: Column, name: str) -> DataFrame:
    """``rows`` with the aggregate ``total`` over rows of equal keys (nulls are equal) as ``name``.

    The totals of heavy keys, at most ``HEAVY`` rows, go to every task; all other keys have few rows each and are joined by
    shuffling. ``rows`` is read several times and should be a stored table.
    """
    totals = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        total.alias(name), F.count(F.lit(1)).alias("_rows"))
    all_rows = rows.count()
    heavy = F.col("_rows") * HEAVY >= all_rows
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    extra = [f"_{k}" for k in keys] + ["_rows"]
    of_heavy = F.broadcast(totals.filter(heavy))
    with_heavy = rows.join(of_heavy, same, "left")
    found = with_heavy.filter("_rows IS NOT NULL").drop(*extra)
    others = with_heavy.filter("_rows IS NULL").drop(*extra, name)
    return found.unionByName(others.join(totals.filter(~heavy), same).drop(*extra))

"""Exact quantiles of whole columns by repeated counting.

``percentile`` keeps every distinct value in one task's memory. Instead, a sketch proposes three
values of the current bracket close around the wanted rank; a second pass counts the values
before, between and after them (partially aggregated before the shuffle), and the part that holds
the rank is the next bracket. A round leaves a few ten-thousandths of the values whatever their
range, infinities included, nothing is sorted, and the driver sees counts only.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Relative error of the sketch is 1 / ACCURACY; the proposals stand twice as far from the rank.
ACCURACY = 10_000
# A bracket with this many values or fewer is finished by listing its distinct values.
LISTED = 10_000


@dataclass
class _Bracket:
    """The values lo..hi of ``column``: ``rank`` is sought, ``below`` values are smaller than lo."""

    column: str
    rank: int
    lo: float
    hi: float
    below: int
    size: int

    @property
    def span(self):
        return (self.column, self.lo, self.hi)

    @property
    def found(self):
        return self.lo == self.hi

    def narrow(self, groups):
        """Move to the group holding the rank; groups are (lo, hi, size) in ascending order."""
        for lo, hi, size in groups:
            if self.rank < self.below + size:
                self.lo, self.hi, self.size = lo, hi, size
                return
            self.below += size
        raise RuntimeError(f"rank {self.rank} of {self.column} is outside the counted values")


def _value(column):
    """The column as a double, null for NaN; adding 0.0 turns -0.0 into 0.0."""
    x = F.col(column).cast("double") + 0.0
    return F.when(~F.isnan(x), x)


def _proposals(df: DataFrame, brackets: list[_Bracket]) -> list[list[float]]:
    """Three values of each bracket around its rank, from a sketch of the bracket's values."""
    aggs = []
    for i, b in enumerate(brackets):
        x = _value(b.column)
        at = (b.rank - b.below + 0.5) / b.size
        shares = [min(1.0, max(0.0, at + side * 2 / ACCURACY)) for side in (-1, 0, 1)]
        aggs.append(F.percentile_approx(
            F.when(x.between(b.lo, b.hi), x), shares, ACCURACY).alias(f"p{i}"))
    row = df.agg(*aggs).first()
    return [list(row[f"p{i}"]) for i in range(len(brackets))]


def _count_groups(df: DataFrame, spans: list[tuple], cuts: list[list[float]] | None) -> list[list]:
    """Per span, its values grouped by the cuts (by value without cuts) as ascending (lo, hi, size)."""
    picks = []
    for i, (column, lo, hi) in enumerate(spans):
        x = _value(column)
        if cuts is None:
            part, value = F.lit(0), x
        else:
            first, middle, last = (F.lit(c) for c in cuts[i])
            part = (F.when(x < first, 0).when(x < middle, 1).when(x == middle, 2)
                    .when(x <= last, 3).otherwise(4))
            value = F.lit(None).cast("double")
        picks.append(F.when(x.between(lo, hi), F.struct(
            F.lit(i).alias("span"), part.alias("part"), value.alias("value"), x.alias("x"))))
    rows = (
        df.select(F.explode(F.array_compact(F.array(*picks))).alias("p")).select("p.*")
        .groupBy("span", "part", "value")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
        .collect()
    )
    groups: list[list] = [[] for _ in spans]
    for row in rows:
        groups[row["span"]].append((row["lo"], row["hi"], row["n"]))
    return [sorted(found) for found in groups]


def summaries(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Count, mean, sample deviation, min and max of each column in one pass, without null or NaN."""
    aggs = []
    for i, column in enumerate(columns):
        x = _value(column)
        aggs += [F.count(x).alias(f"count{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
                 F.max(x).alias(f"max{i}")]
    row = df.agg(*aggs).first()
    return {
        column: {stat: row[f"{stat}{i}"] for stat in ("count", "mean", "std", "min", "max")}
        for i, column in enumerate(columns)
    }


def order_statistics(
    df: DataFrame,
    wanted: dict[str, list[int]],
    known: dict[str, dict] | None = None,
    listed: int = LISTED,
) -> dict[tuple[str, int], float]:
    """The value at each 0-based rank of each column, as {(column, rank): value}."""
    known = known or summaries(df, list(wanted))
    brackets = [
        _Bracket(c, rank, known[c]["min"], known[c]["max"], 0, known[c]["count"])
        for c, ranks in wanted.items() for rank in dict.fromkeys(ranks)
    ]
    while todo := [b for b in brackets if not b.found]:
        large = [b for b in todo if b.size > listed]
        # The small brackets are finished together, once no large one needs a counting pass.
        if large:
            groups = _count_groups(df, [b.span for b in large], _proposals(df, large))
        else:
            groups = _count_groups(df, [b.span for b in todo], None)
        for b, found in zip(large or todo, groups):
            size = b.size
            b.narrow(found)
            if not b.found and b.size >= size:
                raise RuntimeError(f"counting did not narrow {b.column}")
    return {(b.column, b.rank): b.lo for b in brackets}


def exact_quantiles(
    df: DataFrame,
    wanted: dict[str, list[float]],
    known: dict[str, dict] | None = None,
    listed: int = LISTED,
) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring ranks, per column.

    ``known`` may hold ``summaries`` of the columns already computed. An empty column gives None.
    """
    known = known or summaries(df, list(wanted))
    places = {
        column: [p * (known[column]["count"] - 1) for p in ps]
        for column, ps in wanted.items() if known[column]["count"]
    }
    values = order_statistics(
        df,
        {c: [r for at in ats for r in (math.floor(at), math.ceil(at))] for c, ats in places.items()},
        known, listed)

    def interpolated(column, at):
        lo, hi = values[column, math.floor(at)], values[column, math.ceil(at)]
        # Equal neighbours first: infinity minus itself is no number.
        return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))

    return {
        c: [interpolated(c, at) for at in places[c]] if c in places else [None] * len(ps)
        for c, ps in wanted.items()
    }

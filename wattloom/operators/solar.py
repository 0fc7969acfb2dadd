"""Solar panel sizing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.constants import SOLAR_EFFICIENCY, SOLAR_PANEL_WATT
from wattloom.functions.coercion import or_zero
from wattloom.functions.rounding import exact_round, fixed_digits, floor_divide


def _efficiency() -> Column:
    return F.coalesce(F.col("efficiency"), F.lit(SOLAR_EFFICIENCY))


def _panel_wh() -> Column:
    return F.col("panel_watt") * F.col("sun_hours") * _efficiency()


def _positive(x: Column) -> Column:
    """x > 0, false for null and NaN."""
    return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def validate_solar(requests: DataFrame) -> DataFrame:
    """Add ``reason``: why a request cannot be sized, or null."""
    inputs = [_positive(F.col(c)) for c in ("daily_kwh", "sun_hours", "panel_watt")]
    return requests.withColumn(
        "reason",
        F.when(~(inputs[0] & inputs[1] & inputs[2]), "inputs must be positive")
        .when(~_positive(_panel_wh()), "panel yields no energy"),
    )


def solar_sizing(requests: DataFrame) -> DataFrame:
    """Panels, generation and panel yield of each valid request.

    The number of panels is ``(needed + panel - 1) // panel`` on floats. That is a ceiling for
    whole numbers only: 4500.5 Wh with 1500 Wh panels gives 3. ``solar_sizing_ceil`` gives 4.
    """
    panel = _panel_wh()
    needed = F.col("daily_kwh") * 1000.0
    return (
        validate_solar(requests).filter(F.col("reason").isNull()).drop("reason")
        .withColumn("_panel", panel)
        .withColumn("_panels", floor_divide(needed + F.col("_panel") - 1.0, F.col("_panel")))
        .withColumn("panels_required", F.col("_panels").cast("bigint"))
        .withColumn("estimated_daily_generation_kwh",
                    exact_round(F.col("_panel") * F.col("_panels") / 1000.0, 4))
        .withColumn("panel_daily_wh", exact_round(F.col("_panel"), 2))
        .drop("_panel", "_panels")
    )


def solar_rejects(requests: DataFrame) -> DataFrame:
    return validate_solar(requests).filter(F.col("reason").isNotNull())


def solar_sizing_ceil(requests: DataFrame) -> DataFrame:
    """The calculator's variant: true ceiling, fixed efficiency, two digits.

    A missing or zero panel size means the default panel. Requests without consumption or sun,
    or with a negative panel, are left out.
    """
    watt = or_zero(F.col("panel_watt"))
    watt = F.when(watt == 0, SOLAR_PANEL_WATT).otherwise(watt)
    usable = _positive(F.col("daily_kwh")) & _positive(F.col("sun_hours")) & (F.col("_watt") > 0)
    return (
        requests.withColumn("_watt", watt).filter(usable)
        .withColumn("_panel", F.col("_watt") * F.col("sun_hours") * SOLAR_EFFICIENCY)
        .withColumn("panels_required", F.ceil(F.col("daily_kwh") * 1000.0 / F.col("_panel")))
        .withColumn("estimated_daily_generation_kwh",
                    fixed_digits(F.col("_panel") * F.col("panels_required") / 1000.0, 2))
        .drop("_watt", "_panel")
    )

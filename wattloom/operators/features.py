"""Feature engineering: lookups, autofill, vector assembly, scaling, energy balance."""

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.constants import (
    CITY_LETTERS,
    DEFAULT_CITY_LETTER,
    DEFAULT_WATTS,
    FEATURE_ALIASES,
    FEATURE_SPECS,
    HOURS_WITH_AC,
    HOURS_WITHOUT_AC,
    NOISE_SIGMA,
    SEED,
    TARGET,
    UNIT_TO_KWH,
)
from wattloom.functions.coercion import Fields, or_zero, with_numbers
from wattloom.functions.hashing import gaussian
from wattloom.functions.rounding import js_round
from wattloom.operators.appliances import watts_of
from wattloom.operators.ordering import number_in_order


def parse_feature_order(text: str) -> list[str]:
    """The feature list of a JSON text: {"feature_order": [...]} or a bare list."""
    payload = json.loads(text)
    order = payload.get("feature_order") if isinstance(payload, dict) else payload
    if not isinstance(order, list):
        raise ValueError("feature order must be a list or an object with a feature_order list")
    return order


def load_feature_order(spark: SparkSession, path: str) -> list[str]:
    """The feature list in a JSON file on any file system Spark reads."""
    return parse_feature_order(spark.read.text(path, wholetext=True).first()["value"])


def select_features(df: DataFrame, order: list[str], keep: list[str] | None = None) -> DataFrame:
    """The features in order, without the target should the list contain it."""
    missing = [c for c in order if c not in df.columns]
    if missing:
        raise ValueError(f"features missing from the table: {missing}")
    return df.select(*(keep or []), *[c for c in order if c != TARGET])


def clip_target(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Raise negative targets to 0; null and NaN stay."""
    return df.withColumn(target, F.when(F.col(target) < 0, 0.0).otherwise(F.col(target)))


def add_noise(
    df: DataFrame,
    key: str,
    target: str = TARGET,
    sigma: float = NOISE_SIGMA,
    seed: int = SEED,
) -> DataFrame:
    """Add normal noise to the target. The noise of a row depends on its key and the seed only."""
    noise = gaussian(F.col(key), f"noise{seed}")
    return df.withColumn(target, F.col(target) + sigma * noise)


def city_letter(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in CITY_LETTERS.items() for x in (float(k), v)])
    return F.coalesce(F.try_element_at(table, code.cast("double")), F.lit(DEFAULT_CITY_LETTER))


def _city_flag(feature: str, letter: Column) -> Column:
    return (letter == feature.rsplit("_", 1)[-1]).cast("double")


def city_columns(spec: str = "v16") -> list[str]:
    return [f for f in FEATURE_SPECS[spec] if f.startswith("City_") and f != "City_code"]


def city_one_hot(df: DataFrame, code: str = "city_code") -> DataFrame:
    """One 1/0 column per city; an unknown, missing or unreadable code means the first city."""
    parsed, fields = with_numbers(df, [code])
    letter = city_letter(fields.number(code))
    flags = [_city_flag(f, F.col("_letter")).alias(f) for f in city_columns()]
    return parsed.withColumn("_letter", letter).select(*df.columns, *flags)


def _given_or_computed_bill(fields: Fields) -> Column:
    grid = F.coalesce(fields.number("GridConsumption_kWh"), F.lit(0.0))
    tariff = F.coalesce(fields.number("TariffRate"), F.lit(0.0))
    given = F.coalesce(fields.number("NetBill"), F.lit(0.0))
    return F.when(fields.blank("NetBill"), js_round(grid * tariff)).otherwise(given)


def net_bill(df: DataFrame, name: str = "net_bill") -> DataFrame:
    """The given bill, or grid consumption times tariff with missing factors as 0."""
    parsed, fields = with_numbers(df, ["NetBill", "GridConsumption_kWh", "TariffRate"])
    return parsed.select(*df.columns, _given_or_computed_bill(fields).alias(name))


def _feature_value(feature: str, fields: Fields) -> Column:
    if feature.startswith("City_") and feature != "City_code":
        return _city_flag(feature, city_letter(fields.number("City_code")))
    if feature in DEFAULT_WATTS:
        mode = F.col(f"{feature}__mode") if f"{feature}__mode" in fields else F.lit("count")
        return watts_of(F.lit(feature), mode, fields.number(feature))
    if feature == "NetBill":
        return _given_or_computed_bill(fields)
    value = fields.number(feature)
    if feature in FEATURE_ALIASES:
        alias = fields.number(FEATURE_ALIASES[feature])
        value = F.when(fields.blank(feature), alias).otherwise(value)
    return F.coalesce(value, F.lit(0.0))


def assemble_vector(
    df: DataFrame, spec: str | list[str], name: str = "features"
) -> DataFrame:
    """The model input of each form row: one number per feature, 0 where nothing usable is given.

    Columns named after features hold numbers or form text; ``<appliance>__mode`` says whether
    an appliance field counts appliances or gives watts.
    """
    order = FEATURE_SPECS[spec] if isinstance(spec, str) else spec
    inputs = [*order, *FEATURE_ALIASES.values(), "City_code", "NetBill"]
    parsed, fields = with_numbers(df, inputs)
    values = F.array(*[_feature_value(f, fields) for f in order])
    return parsed.select(*df.columns, values.alias(name))


def vector_to_columns(
    df: DataFrame, spec: str | list[str], features: str = "features"
) -> DataFrame:
    """Spread a feature array over columns named after the features, in place of the array."""
    order = FEATURE_SPECS[spec] if isinstance(spec, str) else spec
    kept = [c for c in df.columns if c != features and c not in order]
    return df.select(*kept, *[F.col(features)[i].alias(name) for i, name in enumerate(order)])


def autofill(df: DataFrame, force: bool = False) -> DataFrame:
    """Fill total power, bill, monthly hours and mean power from the other fields, in that order.

    Each step sees the results of the steps before it. Only blank fields are filled unless
    ``force``. The four fields come back as numbers, null where still blank or unreadable.
    """
    power, count = "total_appliance_power", "appliance_count"
    mean, bill, hours = "avg_power_per_appliance", "NetBill", "MonthlyHours"
    grid, rate, cooling = "GridConsumption_kWh", "TariffRate", "AirConditioner"
    parsed, given = with_numbers(df, [power, count, mean, bill, hours, grid, rate, cooling])

    def open_(name):
        return F.lit(True) if force else given.blank(name)

    product = given.number(mean) * given.number(count)
    can_total = (
        open_(power) & ~given.blank(mean) & ~given.blank(count)
        & F.coalesce(product > 0, F.lit(False))
    )
    total = F.when(can_total, js_round(product)).otherwise(given.number(power))
    no_total = ~can_total & given.blank(power)

    tariff = F.when(given.blank(rate), 0.0).otherwise(given.number(rate))
    cost = given.number(grid) * tariff
    can_bill = open_(bill) & ~given.blank(grid) & cost.isNotNull()

    cooled = F.coalesce(given.number(cooling) > 0, F.lit(False))
    suggested = F.when(cooled, HOURS_WITH_AC).otherwise(HOURS_WITHOUT_AC)

    known_total = F.when(no_total, 0.0).otherwise(total)
    share = known_total / F.nullif(given.number(count), F.lit(0.0))
    can_mean = (
        open_(mean) & F.coalesce(given.number(count) > 0, F.lit(False)) & share.isNotNull()
    )
    filled = {
        power: total,
        bill: F.when(can_bill, js_round(cost)).otherwise(given.number(bill)),
        hours: F.when(open_(hours), suggested).otherwise(given.number(hours)),
        mean: F.when(can_mean, js_round(share)).otherwise(given.number(mean)),
    }
    kept = [c for c in df.columns if c not in filled]
    return parsed.select(*kept, *[value.alias(name) for name, value in filled.items()])


def import_and_autofill(forms: DataFrame, imported: DataFrame, key: str = "row_id") -> DataFrame:
    """Forms that take over the three figures of an imported inventory, then forced autofill.

    The total is then that of the rounded mean, not the imported one.
    """
    figures = ["total_appliance_power", "appliance_count", "avg_power_per_appliance"]
    taken = imported.select(F.col("house_id").alias(key), *figures)
    return autofill(forms.drop(*figures).join(taken, key), force=True)


def month_num(df: DataFrame, at: str = "at") -> DataFrame:
    return df.withColumn("Month_num", F.month(at).cast("double"))


def label_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """(value, code) for the distinct values of ``column``, coded 0, 1, ... alphabetically."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    numbered = number_in_order(values, [F.col(column).asc()], "_number")
    return numbered.select(column, (F.col("_number") - 1).cast("double").alias(name))


def label_encode(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add an integer code per column, {column: name of the code}; null keeps a null code."""
    for column, name in columns.items():
        # The planner broadcasts the codes if their bytes allow; else it splits skewed partitions.
        df = df.join(label_codes(df, column, name), column, "left")
    return df


@dataclass
class ScalerStats:
    """Mean and population deviation per feature."""

    mean: dict[str, float]
    std: dict[str, float]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f, self.mean[f], self.std[f]) for f in self.mean]
        return spark.createDataFrame(rows, "feature string, mean double, std double")


def scaler_stats(train: DataFrame, features: list[str]) -> ScalerStats:
    """One pass over the training rows."""
    aggs = [a for i, f in enumerate(features)
            for a in (F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}"))]
    row = train.agg(*aggs).first()
    return ScalerStats(
        {f: row[f"m{i}"] for i, f in enumerate(features)},
        {f: row[f"s{i}"] for i, f in enumerate(features)},
    )


def standardize(df: DataFrame, stats: ScalerStats) -> DataFrame:
    """(x - mean) / std with the training statistics; a constant feature becomes 0."""
    return df.withColumns({
        f: (F.col(f) - stats.mean[f]) / (stats.std[f] or 1.0) for f in stats.mean
    })


def units_to_kwh(df: DataFrame, value: str = "value", unit: str = "unit") -> DataFrame:
    """Add ``kwh`` and, for an unknown unit or a missing value, ``reason``."""
    factors = F.create_map(*[F.lit(x) for pair in UNIT_TO_KWH.items() for x in pair])
    factor = F.try_element_at(factors, F.col(unit))
    return df.withColumn("kwh", F.col(value) * factor).withColumn(
        "reason",
        F.when(factor.isNull(), "unknown unit").when(F.col(value).isNull(), "value is missing"))


# Columns that cannot be negative in a training row.
NON_NEGATIVE = [
    "MonthlyHours", "TariffRate", "SolarGeneration_kWh", "GridConsumption_kWh", "EnergySold_kWh",
]


def clean_training(df: DataFrame, features: list[str], target: str = TARGET) -> DataFrame:
    """Rows whose features and target are all finite and whose energy, hours and tariff are >= 0."""
    usable = F.lit(True)
    for name in [*features, target]:
        usable = usable & F.col(name).isNotNull() & (F.abs(F.col(name)) < float("inf"))
    for name in NON_NEGATIVE:
        if name in features:
            usable = usable & (F.col(name) >= 0)
    return df.filter(usable)


def predicted_bill(df: DataFrame, kwh: str, tariff: str = "TariffRate") -> DataFrame:
    """Monthly bill before solar."""
    return df.withColumn("predicted_bill", js_round(F.col(kwh) * F.col(tariff)))


def solar_offset(df: DataFrame, generation: str, consumption: str) -> DataFrame:
    """Percentage of the demand met by solar, at most 100; null without demand."""
    share = F.col(generation) / F.nullif(F.col(consumption), F.lit(0.0)) * 100.0
    return df.withColumn("solar_offset_pct", F.when(share > 100.0, 100.0).otherwise(share))


def surplus_energy(df: DataFrame, generation: str, consumption: str) -> DataFrame:
    """Energy left to sell and energy to draw from the grid."""
    balance = or_zero(F.col(generation)) - or_zero(F.col(consumption))
    return df.withColumn("surplus_kwh", F.greatest(balance, F.lit(0.0))).withColumn(
        "grid_need_kwh", F.greatest(-balance, F.lit(0.0)))

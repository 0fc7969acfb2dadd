"""Reading numbers out of form fields and loosely typed records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters of plain decimal notation. A cast alone would also take "5d",
# "Infinity", "NaN" and hexadecimal.
_NUMBER_CHARACTERS = r"^[0-9+\-.eE\s]+$"


def is_blank(raw: Column) -> Column:
    return raw.isNull() | (F.trim(raw) == "")


def to_number(raw: Column) -> Column:
    """The number a text field holds, or null."""
    return F.when(raw.rlike(_NUMBER_CHARACTERS), F.trim(raw).try_cast("double"))


class Fields:
    """Column access by field name that treats an absent column as blank.

    ``number`` is null for a blank or unreadable field; ``blank`` tells the two apart.
    """

    def __init__(self, df: DataFrame, parsed: dict[str, str]):
        self._types = {f.name: f.dataType for f in df.schema.fields}
        self._parsed = parsed

    def __contains__(self, name: str) -> bool:
        return name in self._types

    def blank(self, name: str) -> Column:
        if name not in self:
            return F.lit(True)
        if name in self._parsed:
            return is_blank(F.col(name))
        return self.number(name).isNull()

    def number(self, name: str) -> Column:
        if name not in self:
            return F.lit(None).cast("double")
        if name in self._parsed:
            return F.col(self._parsed[name])
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)


def with_numbers(df: DataFrame, names: list[str]) -> tuple[DataFrame, Fields]:
    """Parse the text columns among ``names`` once, into helper columns the Fields refer to."""
    texts = [
        f.name for f in df.schema.fields
        if f.name in names and isinstance(f.dataType, T.StringType)
    ]
    parsed = {name: f"_number_{name}" for name in texts}
    wider = df.withColumns({parsed[name]: to_number(F.col(name)) for name in texts})
    return wider, Fields(df, parsed)


def or_zero(x: Column) -> Column:
    """0 for null and NaN."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def or_one(x: Column) -> Column:
    """1 for null, NaN and 0: a quantity left empty or at zero counts as one."""
    return F.when(x.isNull() | F.isnan(x) | (x == 0), 1.0).otherwise(x)

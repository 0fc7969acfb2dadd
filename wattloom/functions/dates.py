"""Record dates: ISO text in, canonical ISO text and moment out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted notations.
_DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_USUAL = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:\d{2})?$"
_TIME_COLONS = r"\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?"
_TIME_COMPACT = r"\d{2}(?:\d{2}(?:\d{2}(?:[.,]\d+)?)?)?"
_OFFSET = r"Z|[+-]\d{2}(?::?\d{2})?"
_ISO = rf"^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(?:.({_TIME_COLONS}|{_TIME_COMPACT})({_OFFSET})?)?$"
# The time is at least 12 characters in, so the dashes of a date are never taken for an offset.
_TRAILING_OFFSET = r"^.{11,}?(Z|[+-]\d{2}(?::?\d{2})?)$"

_WEEK_DATE = r"^(\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)(.*)$"

_IS_DATE, _IS_USUAL, _IS_OTHER_ISO = 1, 2, 3


def _without_week(text: Column) -> Column:
    """A text that starts with an ISO week date, with that date as yyyy-MM-dd; others unchanged.

    Null if the year has no such week.
    """
    digits = F.replace(F.regexp_extract(text, _WEEK_DATE, 1), F.lit("-"), F.lit(""))
    year, week = F.substring(digits, 1, 4).cast("int"), F.substring(digits, 6, 2).cast("int")
    weekday = F.coalesce(F.substring(digits, 8, 1).try_cast("int"), F.lit(1))
    # The week of January 4 is the first; a week belongs to the year of its Thursday.
    monday = F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (week - 1) * 7)
    exists = (week >= 1) & (F.year(F.date_add(monday, 3)) == year)
    day = F.date_add(monday, weekday - 1).cast("string")
    calendar = F.when(exists, F.concat(day, F.regexp_extract(text, _WEEK_DATE, 2)))
    return F.when(text.rlike(_WEEK_DATE), calendar).otherwise(text)


def _spelled_out(text: Column) -> Column:
    """A compact or unusual ISO text as yyyy-MM-dd HH:mm:ss.ffffff, without its offset."""
    day = F.replace(F.regexp_extract(text, _ISO, 1), F.lit("-"), F.lit(""))
    time = F.translate(F.regexp_extract(text, _ISO, 2), ",:", ".")
    clock = F.rpad(F.substring_index(time, ".", 1), 6, "0")
    fraction = F.when(time.contains("."), F.substring(F.substring_index(time, ".", -1), 1, 6))
    return F.concat(
        F.substring(day, 1, 4), F.lit("-"), F.substring(day, 5, 2), F.lit("-"),
        F.substring(day, 7, 2), F.lit(" "), F.substring(clock, 1, 2), F.lit(":"),
        F.substring(clock, 3, 2), F.lit(":"), F.substring(clock, 5, 2),
        F.lit("."), F.rpad(F.coalesce(fraction, F.lit("")), 6, "0"))


def parse_record_date(df: DataFrame, raw: str, iso: str, at: str) -> DataFrame:
    """Add ``iso``, the canonical text, and ``at``, the moment in UTC; both null if not ISO.

    A date alone means midnight. ``iso`` keeps the given offset; text without an offset is taken
    as UTC. A bare year or year and month is rejected. Each step is a projection of its own, so
    every pattern is matched once per row.
    """
    text, kind = F.col("_text"), F.col("_kind")
    local, offset = F.col("_local"), F.col("_offset")
    has_week = F.substring(text, 5, 1).isin("W", "-") & text.contains("W")
    steps = df.withColumn("_text", F.trim(raw))
    steps = steps.withColumn("_text", F.when(has_week, _without_week(text)).otherwise(text))
    steps = steps.withColumn(
        "_kind",
        F.when(text.rlike(_DATE), _IS_DATE).when(text.rlike(_USUAL), _IS_USUAL)
        .when(text.rlike(_ISO), _IS_OTHER_ISO))
    steps = steps.withColumns({
        "_local": F.when(kind == _IS_OTHER_ISO, _spelled_out(text)).when(kind.isNotNull(), text)
        .try_cast("timestamp_ntz"),
        "_offset": F.when(kind.isin(_IS_USUAL, _IS_OTHER_ISO) & (F.length(text) > 11),
                          F.regexp_extract(text, _TRAILING_OFFSET, 1)).otherwise(""),
    })
    digits = F.rpad(F.replace(F.substring(offset, 2, 5), F.lit(":"), F.lit("")), 4, "0")
    named = ~offset.isin("", "Z")
    steps = steps.withColumns({
        "_hours": F.when(named, F.substring(digits, 1, 2).cast("int")).otherwise(0),
        "_minutes": F.when(named, F.substring(digits, 3, 2).cast("int")).otherwise(0),
        "_shown": F.when(F.year(local) >= 1, local.cast("string")),
    })
    hours, minutes, shown = F.col("_hours"), F.col("_minutes"), F.col("_shown")
    seconds = F.replace(F.substring_index(shown, ".", 1), F.lit(" "), F.lit("T"))
    micros = F.when(shown.contains("."), F.concat(
        F.lit("."), F.rpad(F.substring_index(shown, ".", -1), 6, "0"))).otherwise("")
    zone = F.when(offset == "", "").when((hours == 0) & (minutes == 0), "+00:00").otherwise(
        F.concat(F.substring(offset, 1, 1), F.lpad(hours.cast("string"), 2, "0"), F.lit(":"),
                 F.lpad(minutes.cast("string"), 2, "0")))
    real = shown.isNotNull() & (hours < 24) & (minutes < 60)
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    moment = local - F.make_dt_interval(F.lit(0), sign * hours, sign * minutes)
    result = F.struct(
        F.when(real, F.concat(seconds, micros, zone)).alias("iso"),
        F.when(real, moment).alias("at"))
    # A filter on the result stops at this one-element explode. Pushed further down it would
    # repeat every step for each of its uses.
    parsed = steps.select(*df.columns, F.explode(F.array(result)).alias("_parsed"))
    return parsed.select(
        *df.columns, F.col("_parsed.iso").alias(iso), F.col("_parsed.at").alias(at))

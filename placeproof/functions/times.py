"""Time column functions: one clock (UTC), local reading in Asia/Kolkata."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from placeproof import policy

LOCAL_ZONE = "Asia/Kolkata"


def parse_ts(text: Column) -> Column:
    """Text to UTC instant.  Offset or Z is honoured; a naive value is local; else date prefix."""
    s = F.trim(text)
    zoned = s.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]")
    naive = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(s, "T", " ")), LOCAL_ZONE)
    by_date = F.to_utc_timestamp(F.try_to_timestamp(F.substring(s, 1, 10)), LOCAL_ZONE)
    return F.coalesce(F.when(zoned, F.try_to_timestamp(s)).otherwise(naive), by_date)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def age_days(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (micros(as_of) - micros(ts)) / 86400e6)


def local_hour(ts: Column) -> Column:
    return F.hour(F.from_utc_timestamp(ts, LOCAL_ZONE))


def local_weekday(ts: Column) -> Column:
    """Monday = 0."""
    return F.weekday(F.from_utc_timestamp(ts, LOCAL_ZONE))


def recency_factor(ts: Column, as_of: Column, granularity: Column) -> Column:
    half_life = F.lit(12.0)
    for name, months in policy.HALF_LIFE_MONTHS.items():
        half_life = F.when(granularity == name, F.lit(months)).otherwise(half_life)
    return F.round(F.pow(F.lit(0.5), age_days(ts, as_of) / 30.44 / half_life), 6)

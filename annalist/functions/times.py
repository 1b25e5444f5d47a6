"""Time buckets and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_keys(df: DataFrame, ts: str, tz: str = "UTC") -> DataFrame:
    """Add hour_key, day_key, month_key, year_key, hour and weekday (Monday 0) in a zone."""
    t = F.from_utc_timestamp(F.col(ts).cast("timestamp"), tz)
    return df.withColumns({"hour_key": F.date_format(t, "yyyy-MM-dd HH"), "day_key": F.date_format(t, "yyyy-MM-dd"), "month_key": F.date_format(t, "yyyy-MM"), "year_key": F.date_format(t, "yyyy"), "hour": F.hour(t), "weekday": F.weekday(t)})


def weeks_from(date: Column, anchor: str) -> Column:
    """Whole weeks from an anchor date, rounded down."""
    return F.floor(F.datediff(date, F.lit(anchor).cast("date")) / 7)


def in_period(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows of [start, end)."""
    return df.where((F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType)) & (F.col(ts) < F.lit(end).cast(df.schema[ts].dataType)))


def zero_fill(df: DataFrame, bucket: str, value: str, step: str = "INTERVAL 1 DAY") -> DataFrame:
    """Every bucket between the first and the last, with 0 where it is missing."""
    spine = df.agg(F.explode(F.expr(f"sequence(min({bucket}), max({bucket}), {step})")).alias(bucket))
    return spine.join(df, bucket, "left").select(bucket, F.coalesce(value, F.lit(0)).alias(value))


def period_bounds(date: str, unit: str, offset: int = 0) -> Column:
    """struct<start, end, previous>: the day, week (from Monday), month or year of a date, so many units later; [start, end) and the start of the one before."""
    step = {"day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit]
    start = F.date_trunc(unit, F.expr(f"CAST('{date}' AS TIMESTAMP_NTZ) + {offset} * {step}")).cast("date")
    one = F.expr(step)
    return F.struct(start.alias("start"), (start + one).cast("date").alias("end"), (start - one).cast("date").alias("previous"))


def average_per(n: Column, start: Column, end: Column, as_of: Column) -> Column:
    """n per day of the part of [start, end) that has passed, a day at least."""
    return n / F.greatest(F.datediff(F.least(end, as_of), start), F.lit(1))

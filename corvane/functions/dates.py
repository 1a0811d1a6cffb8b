"""Times and buckets of time. ``now`` is always a parameter."""

from __future__ import annotations

from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType


@F.pandas_udf(TimestampType())
def mail_date(text: pd.Series) -> pd.Series:
    """RFC 2822 dates as UTC; null if they can't be read."""

    def parse(x):
        try:
            t = pd.Timestamp(parsedate_to_datetime(x))
            return (t.tz_convert("UTC") if t.tzinfo else t.tz_localize("UTC")).tz_localize(None)
        except (TypeError, ValueError, IndexError):
            return pd.NaT

    return pd.to_datetime(text.map(parse))


def since_2001(seconds: Column) -> Column:
    """Seconds since 2001-01-01 as a timestamp."""
    return F.timestamp_seconds(seconds + 978307200)


def month_bucket(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def iso_of_millis(millis: Column) -> Column:
    """Epoch milliseconds, maybe as text, in ISO form."""
    return F.date_format(F.timestamp_millis(millis.cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss")


def day_buckets(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(bucket, low, high): runs of ``days`` days from start, the last one cut at end; bucket is low_to_high."""
    one = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.date_sub(F.to_date(F.lit(end)), 1), F.make_dt_interval(F.lit(days)))).alias("low"))
    high = F.least(F.date_add("low", days), F.to_date(F.lit(end)))
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    return one.select(F.concat(text(F.col("low")), F.lit("_to_"), text(high)).alias("bucket"), text(F.col("low")).alias("low"), text(high).alias("high"))


def bucket_age(bucket: Column, now: str, all_time: str = "all_time", whole: float = 365.0) -> Column:
    """Days from a bucket's start to ``now``, 0 at least; a fixed age for the bucket of all time."""
    begin = F.unix_timestamp(F.to_timestamp(F.split(bucket, "_to_")[0], "yyyy-MM-dd"))
    days = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - begin) / 86400.0
    return F.when(bucket == all_time, F.lit(whole)).otherwise(F.greatest(F.lit(0.0), days))


def more_recent(a: Column, b: Column, all_time: str = "all_time") -> Column:
    """Whether bucket a is later than b, as text; never for the bucket of all time."""
    return (a != all_time) & (b != all_time) & (a > b)

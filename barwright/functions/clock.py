"""Time arithmetic on ``timestamp_ntz`` that does not depend on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def epoch_micros(ts: Column) -> Column:
    whole_minutes = F.unix_date(ts.cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")
    return whole_minutes * 60000000 + micros


def floor_hour(ts: Column) -> Column:
    day = ts.cast("date").cast("timestamp_ntz")
    return (day + F.make_dt_interval(hours=F.hour(ts))).cast("timestamp_ntz")


def slot(ts: Column, seconds: int) -> Column:
    """Number of the fixed-width time slot that holds ``ts``."""
    return F.floor(epoch_seconds(ts) / F.lit(seconds)).cast("bigint")

"""Reading CSV by header names, and timestamps that no session zone changes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barwright.schema import BAR_SCHEMA
from barwright.sources.bars import hourly_bars
from barwright.sources.readers import parse_timestamp, read_bars_csv, read_csv_pair


def write(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_columns_follow_the_header(spark, tmp_path):
    path = write(tmp_path, "a.csv", "volume,low,ts,note,series_id,close,open,high,spread", "9,0.5,2024-01-01 00:00:00,hello,X,4,1,5,0.25", "8,,2024-01-01 01:00:00,,Y,3,2,6,1")
    rows = read_bars_csv(spark, path).orderBy("series_id").collect()
    first = rows[0].asDict()
    assert (first["series_id"], first["open"], first["high"], first["low"], first["close"], first["volume"]) == ("X", 1.0, 5.0, 0.5, 4.0, 9.0)
    assert first["ts"] == dt.datetime(2024, 1, 1) and first["note"] == "hello" and first["spread"] == 0.25
    assert rows[1]["low"] is None and rows[1]["note"] is None


def test_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path, "b.csv", "series_id,ts,open,high,low,volume", "X,2024-01-01 00:00:00,1,5,0.5,9")
    with pytest.raises(ValueError, match="close"):
        read_bars_csv(spark, path)


def test_renamed_and_malformed(spark, tmp_path):
    path = write(tmp_path, "c.csv", "series_id,DATETIME,open,high,low,close,volume", "X,2024-01-01 00:00:00,1,5,0.5,4,9", "X,2024-01-01 01:00:00,oops,5,0.5,4,9")
    df = read_bars_csv(spark, path, rename={"DATETIME": "ts"}, corrupt="bad").cache()
    assert df.count() == 2 and df.where("bad IS NOT NULL").count() == 1
    assert df.where("bad IS NULL").collect()[0]["close"] == 4.0


def test_pair_by_name(spark, tmp_path):
    a = write(tmp_path, "r.csv", "y,x", "1,2")
    b = write(tmp_path, "s.csv", "x,y", "2,1")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    assert [tuple(df.collect()[0]) for df in read_csv_pair(spark, a, b, schema)] == [(2.0, 1.0), (2.0, 1.0)]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin", "America/New_York"])
def test_timestamps_in_any_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-31 02:30:00", "2024-03-31T02:30:00+02:00", "2024-03-31 02:30:00Z", "2024-03-31", "no time", None]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r[0] for r in parse_timestamp(df, "t").orderBy("i").select(F.substring(F.col("ts").cast("string"), 1, 16)).collect()]
        assert got == ["2024-03-31 02:30", "2024-03-31 00:30", "2024-03-31 02:30", "2024-03-31 00:00", None, None]
        own = spark.createDataFrame([("31.03.2024 02:30",), ("x",)], "t string")
        got = [r[0] for r in parse_timestamp(own, "t", "dd.MM.yyyy HH:mm").select(F.substring(F.col("ts").cast("string"), 1, 16)).collect()]
        assert got == ["2024-03-31 02:30", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_event_without_tie_breaker_counts(spark):
    events = spark.createDataFrame(
        [(None, dt.datetime(2024, 1, 1, 0, 1), 5.0), (2, dt.datetime(2024, 1, 1, 0, 2), 7.0)], "event_id long, ts timestamp_ntz, value double"
    )
    bar = hourly_bars(events).collect()[0]
    assert (bar["open"], bar["close"], bar["volume"]) == (5.0, 7.0, 2.0)
    assert BAR_SCHEMA.fieldNames()[0] == "series_id"

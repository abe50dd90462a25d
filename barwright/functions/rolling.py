"""Rolling aggregates that are NULL until the frame is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def roll(agg: Callable[[Column], Column], column: Column, n: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, agg(column).over(frame))

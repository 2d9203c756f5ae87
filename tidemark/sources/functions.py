"""Sources as table-valued functions of Spark SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="first date, last date")
class DayRanges:
    """Half-open ranges of at most ``days`` days that cover a window; none for an empty window."""

    def eval(self, start: date, end: date, days: int):
        if days < 1:
            raise ValueError("a range has a day at least")
        while start < end:
            to = min(end, start + timedelta(days=days))
            yield start, to
            start = to


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL: ``SELECT * FROM day_ranges(DATE '2024-01-01', DATE '2024-02-01', 7)``."""
    spark.udtf.register("day_ranges", DayRanges)

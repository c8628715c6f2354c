"""Filing deadlines and tax years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# For each schedule its deadlines as (years after the tax year, month, day, label); day 0 is the month's last.
SCHEDULES = {
    "quarterly_20": [(0, 4, 20, "1T"), (0, 7, 20, "2T"), (0, 10, 20, "3T"), (1, 1, 20, "4T")],
    "quarterly_20_4t_30": [(0, 4, 20, "1T"), (0, 7, 20, "2T"), (0, 10, 20, "3T"), (1, 1, 30, "4T")],
    "annual_jan_30": [(1, 1, 30, "Ejercicio")],
    "annual_feb_last": [(1, 2, 0, "Ejercicio")],
    "annual_mar_31": [(1, 3, 31, "Ejercicio")],
    "annual_jun_30": [(1, 6, 30, "Ejercicio")],
    "annual_jul_25": [(1, 7, 25, "Ejercicio")],
    "instalments_20": [(0, 4, 20, "1P"), (0, 10, 20, "2P"), (0, 12, 20, "3P")],
}


def next_business_day(day: Column) -> Column:
    """Saturdays and Sundays move to Monday; holidays are not known."""
    return F.when(F.weekday(day) >= 5, F.next_day(day, "MON")).otherwise(day)


def deadlines(events: DataFrame, years: list[int]) -> DataFrame:
    """`events` (schedule among the columns) for each year with deadline and period."""
    spark = events.sparkSession
    rows = [(name, *d) for name, ds in SCHEDULES.items() for d in ds]
    parts = spark.createDataFrame(rows, "schedule string, shift int, month int, dom int, label string")
    of = spark.createDataFrame([(y,) for y in years], "year int")
    day = F.when(F.col("dom") == 0, F.last_day(F.make_date(F.col("year") + F.col("shift"), F.col("month"), F.lit(1)))).otherwise(F.make_date(F.col("year") + F.col("shift"), F.col("month"), F.greatest("dom", F.lit(1))))
    full = events.join(parts, "schedule").crossJoin(F.broadcast(of))
    return full.withColumn("deadline", next_business_day(day)).withColumn("period", F.concat_ws(" ", "label", F.col("year").cast("string"))).drop("shift", "month", "dom", "label")


def upcoming(events: DataFrame, today: Column, today_year: int, window_days: int, segments: list[str] | None = None) -> DataFrame:
    """Deadlines from today to today + window_days, soonest first, with days_left; segments must overlap `applicable_to`."""
    found = deadlines(events, [today_year + k for k in (-2, -1, 0, 1)]).where(F.col("deadline").between(today, F.date_add(today, window_days)))
    if segments:
        found = found.where(F.arrays_overlap("applicable_to", F.array(*map(F.lit, segments))))
    return found.withColumn("days_left", F.datediff("deadline", today)).orderBy("deadline", "code")


def fiscal_years(spark: SparkSession, today: Column) -> DataFrame:
    """One row: the year in progress, the last closed one, the one that can be declared now, and whether the campaign is open."""
    year = F.year(today)
    is_open = today.between(F.make_date(year, F.lit(4), F.lit(1)), F.make_date(year, F.lit(6), F.lit(30)))
    return spark.range(1).select(year.alias("in_progress"), (year - 1).alias("closed"), F.when(is_open, year - 1).alias("declarable"), is_open.alias("campaign_open"))

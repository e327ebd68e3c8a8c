"""Calendar expressions. Weeks start on Monday and are named by that day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martloom.config import SplitDates
from martloom.functions.numeric import as_col


def day(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def month_start(ts: Column | str) -> Column:
    return F.trunc(F.to_date(as_col(ts)), "month")


def week_start(ts: Column | str) -> Column:
    return F.to_date(F.date_trunc("week", as_col(ts)))


def iso_year(week: Column | str) -> Column:
    """ISO year of a Monday: the year its Thursday falls in."""
    return F.year(F.date_add(as_col(week), 3))


def iso_week(week: Column | str) -> Column:
    return F.weekofyear(as_col(week))


def is_weekend(ts: Column | str) -> Column:
    """Friday, Saturday or Sunday."""
    return F.dayofweek(as_col(ts)).isin(1, 6, 7)


def day_name(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "EEEE")


def split_label(date: Column | str, splits: SplitDates) -> Column:
    d = as_col(date)
    return (
        F.when(d <= F.lit(splits.train_end).cast("date"), "TRAIN")
        .when(d <= F.lit(splits.validation_end).cast("date"), "VALIDATION")
        .when(d <= F.lit(splits.test_end).cast("date"), "TEST")
        .otherwise("UNSEEN_COMPARISON")
    )

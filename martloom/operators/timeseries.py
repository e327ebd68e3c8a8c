"""Lags, trailing statistics, gap filling and split windows per entity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from martloom.config import SplitDates


def series(keys: list[str], time: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def trailing(keys: list[str], time: str, rows: int) -> WindowSpec:
    """The given number of rows before the current one, the current one excluded."""
    return series(keys, time).rowsBetween(-rows, -1)


def all_prior(keys: list[str], time: str) -> WindowSpec:
    return series(keys, time).rowsBetween(Window.unboundedPreceding, -1)


def if_full(stat: Column, frame: WindowSpec, rows: int) -> Column:
    """A trailing statistic only where the frame holds all its rows."""
    return F.when(F.count(F.lit(1)).over(frame) == rows, stat)


def next_value_if(column: str, time: str, keys: list[str], step_days: int, default: int) -> Column:
    """The next row's value if that row lies exactly step_days later, otherwise the default."""
    w = series(keys, time)
    adjacent = F.lead(time).over(w) == F.date_add(F.col(time), step_days)
    return F.coalesce(F.when(adjacent, F.lead(column).over(w)), F.lit(default))


def calendar_spine(
    df: DataFrame, keys: list[str], date: str, zeros: list[str], until: dt.date | None = None
) -> DataFrame:
    """One row per key and day, from the key's first day to the last day seen anywhere.

    Days without a row get 0 in the named columns. `until` ends the calendar earlier, so
    that a corrupt late date does not fill centuries; rows after it stay as they are.
    """
    if until is not None:
        df, late = df.filter(F.col(date) <= F.lit(until)), df.filter(F.col(date) > F.lit(until))
        filled = calendar_spine(df, keys, date, zeros)
        return filled.unionByName(late.select(*filled.columns))
    last = df.agg(F.max(date)).scalar()
    spine = (
        df.groupBy(*keys)
        .agg(F.min(date).alias("first_day"))
        .select(*keys, F.explode(F.sequence(F.col("first_day"), last)).alias(date))
    )
    filled = spine.join(df, [*keys, date], "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in zeros})


def split_dates(first: dt.date, last: dt.date) -> SplitDates:
    """Chronological windows for a history.

    A full calendar year splits by month (eight, two, one, rest); anything shorter by
    67, 17 and 8 percent of its days.
    """
    days = (last - first).days + 1
    if days >= 365 and (first.month, first.day) == (1, 1):
        return SplitDates(
            train_end=f"{first.year}-08-31",
            validation_end=f"{first.year}-10-31",
            test_end=f"{first.year}-11-30",
        )
    train, validation, test = (max(1, days * share // 100) for share in (67, 17, 8))
    ends = [train, train + validation, train + validation + test]
    texts = [(first + dt.timedelta(days=n - 1)).isoformat() for n in ends]
    return SplitDates(*texts)

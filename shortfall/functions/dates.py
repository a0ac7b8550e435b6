"""Date columns used by every planning operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON = 28
SEASON = 7


def day_span(start: Column, end: Column) -> Column:
    """Array of the dates start..end, both included."""
    return F.sequence(start, end, F.expr("INTERVAL 1 DAY"))


def week_start(day: Column) -> Column:
    """Monday of the week that holds the day."""
    return F.date_trunc("week", day).cast("date")


def cutoff_dates(anchor: Column, periods: int, step_days: int) -> list[Column]:
    """Evaluation dates before the anchor, oldest first; the anchor itself is left out."""
    if periods <= 0 or step_days <= 0:
        raise ValueError("periods and step_days must be positive")
    return [F.date_sub(anchor, step_days * k) for k in range(periods, 0, -1)]


def earliest(days: Sequence[Column]) -> Column:
    return F.least(*days) if len(days) > 1 else days[0]


def latest(days: Sequence[Column]) -> Column:
    return F.greatest(*days) if len(days) > 1 else days[0]


def each_cutoff(frame: DataFrame, cutoffs: Sequence[Column], keep: Callable[[Column], Column]) -> DataFrame:
    """Every row once per cutoff that `keep` accepts, with the cutoff as eval_date."""
    if len(cutoffs) == 1:
        return frame.where(keep(cutoffs[0])).withColumn("eval_date", cutoffs[0])
    matching = F.explode(F.array(*[F.when(keep(c), c) for c in cutoffs]))
    return frame.select("*", matching.alias("eval_date")).where(F.col("eval_date").isNotNull())


# Fixed date patterns. A month/day pair is only taken for a date when that day exists.
LEAP_YEAR = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
ANY_YEAR = r"(?:\d\d\d[1-9]|\d\d[1-9]\d|\d[1-9]\d\d|[1-9]\d\d\d)"


def calendar_pattern(after_year: str, after_month: str, after_day: str) -> str:
    """Regular expression for an existing calendar day with the given separators."""
    long_month = r"(?:0?[13578]|1[02])" + after_month + r"(?:0?[1-9]|[12]\d|3[01])"
    short_month = r"(?:0?[469]|11)" + after_month + r"(?:0?[1-9]|[12]\d|30)"
    february = r"0?2" + after_month + r"(?:0?[1-9]|1\d|2[0-8])"
    leap_day = LEAP_YEAR + after_year + r"0?2" + after_month + r"29"
    return (
        f"(?:{leap_day}|{ANY_YEAR}{after_year}(?:{long_month}|{short_month}|{february})){after_day}"
    )

"""Calendar semantics: Monday weeks, ISO year and week, calendar parts of the Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def week_start(date: str | Column) -> Column:
    """Monday of the date's ISO week."""
    return F.trunc(_c(date), "week")


def iso_year(date: str | Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(date)).cast("int")


def iso_week(date: str | Column) -> Column:
    return F.weekofyear(_c(date))


def day_of_week(date: str | Column) -> Column:
    """0 = Monday."""
    return F.weekday(_c(date))


def month_start(date: str | Column) -> Column:
    return F.trunc(_c(date), "month")


def first_monday_on_or_after(date: str | Column) -> Column:
    return week_start(F.date_add(_c(date), 6))


def week_sequence(first: str | Column, last: str | Column) -> Column:
    """Array of Mondays, first and last included."""
    return F.sequence(_c(first), _c(last), F.expr("interval 7 days"))


def weeks_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole weeks, floored."""
    return F.floor(F.datediff(_c(later), _c(earlier)) / 7).cast("int")


def cyclic(position: str | Column, period: float, harmonic: int = 1) -> tuple[Column, Column]:
    angle = F.lit(2.0 * harmonic) * F.pi() * _c(position) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)

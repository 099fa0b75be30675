"""Column functions over dates and quarters written YYYYqN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_first(text: Column) -> Column:
    """A date written d/M/yyyy; null for anything else."""
    return F.try_to_timestamp(text, F.lit("d/M/yyyy")).cast("date")


def quarter_of(day: Column) -> Column:
    return F.concat(F.year(day), F.lit("q"), F.quarter(day))


def year_and_quarter(quarter: Column) -> tuple[Column, Column]:
    """The numbers in YYYYqN; null where it isn't one."""
    part = lambda k: F.nullif(F.regexp_extract(quarter, r"^(\d{4})q([1-4])$", k), F.lit("")).try_cast("int")
    return part(1), part(2)


def period(quarter: Column, cutoff: tuple[int, int] = (2020, 2)) -> Column:
    """``post`` from the cutoff quarter on, else ``pre``; null for no quarter."""
    y, q = year_and_quarter(quarter)
    return F.when(y.isNull(), None).when((y > cutoff[0]) | ((y == cutoff[0]) & (q >= cutoff[1])), "post").otherwise("pre")


def after(quarter: Column, cutoff: str = "2020q2") -> Column:
    """1 strictly after the cutoff by string order, else 0."""
    return (quarter > cutoff).cast("int")

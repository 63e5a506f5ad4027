"""Scalar functions whose meaning differs from Spark's own of a like name, as expressions of built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nulls_last(*columns: Column) -> list[Column]:
    """Ascending with nulls last; Spark puts them first."""
    return [c.asc_nulls_last() for c in columns]


def int_divide(a: Column, b: Column) -> Column:
    """Whole quotient toward zero; a zero divisor is an error under ANSI."""
    return F.call_function("div", a, b)


def to_int(c: Column) -> Column:
    """Number to integer by rounding half away from zero; a plain cast would cut."""
    return F.round(c).cast("long")


def slice_text(c: Column, first: int, last: int) -> Column:
    """Characters first to last, both from 1 and both included."""
    return F.substring(c, first, last - first + 1)


def part(c: Column, separator: str, n: int) -> Column:
    """The n-th part (from 1) between separators, null beyond the last."""
    return F.get(F.split(c, f"\\Q{separator}\\E"), n - 1)


def list_ordered(value: Column, *order: Column) -> Column:
    """Values of a group as a list in an order."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("__v")))), lambda x: x["__v"])


def number_text(c: Column) -> Column:
    """A finite double as SQL writes it: its shortest digits, in full from 1e-4 to below 1e16."""
    own, plain = c.cast("string"), F.regexp_replace(c.cast("decimal(38,21)").cast("string"), "0+$", "")
    power = F.substring_index(own, "E", -1).cast("int")
    short = F.concat(F.regexp_replace(F.substring_index(own, "E", 1), r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    full = (c == 0) | F.abs(c).between(1e-4, 9.999999999999998e15)
    return F.when(full, F.concat(plain, F.when(plain.endswith("."), "0").otherwise(""))).when(c.isNotNull(), short)


def mad(value: Column, median: Column) -> Column:
    """Median absolute deviation, given the group's median as a column of the row."""
    return F.median(F.abs(value - median))


def weekday_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def epoch_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, read as UTC."""
    return F.unix_millis(c.cast("timestamp"))

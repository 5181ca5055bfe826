"""Text and number expressions. Everything here is a built-in Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(value: Column) -> Column:
    """Strip every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit("")).rlike(r"(?U)^\s*$")


def upper_keep_sharp_s(value: Column) -> Column:
    """Upper-case letter by letter: a sharp s has no single upper-case letter and stays as it is."""
    return F.translate(F.upper(F.translate(value, "ß", "\u0001")), "\u0001", "ß")


def first_line(value: Column) -> Column:
    return trim_all(F.split(value, "\n", 2).getItem(0))


def extension(file_name: Column) -> Column:
    """Lower-case extension from the last dot on; a lone trailing dot is no extension."""
    return F.lower(F.regexp_extract(file_name, r"(\.[^.]+)$", 1))


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def money(value: Column) -> Column:
    """1.234,50"""
    return F.translate(F.format_number(F.round(value, 2), 2), ",.", ".,")


def whole(value: Column) -> Column:
    """1.234"""
    return F.translate(F.format_number(value, 0), ",", ".")


def day(value: Column) -> Column:
    """dd.MM.yyyy"""
    return F.date_format(value, "dd.MM.yyyy")


def percent_of(amount: Column, percent: Column) -> Column:
    """round(amount * percent / 100, 2), half away from zero, without a division that would lose digits."""
    product = amount.try_cast("decimal(28,8)") * percent.cast("decimal(9,4)")
    return (F.round(product, 0).cast("decimal(26,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(28,2)")


def strict_date(value: Column) -> Column:
    """yyyy-MM-dd exactly, anything else is null."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))

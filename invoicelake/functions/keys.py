"""Normalized keys for duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import upper_keep_sharp_s

MIN_VAT_KEY_LENGTH = 4


def alphanumeric_upper(value: Column) -> Column:
    """Letters and decimal digits only, upper-cased; null becomes the empty key."""
    return upper_keep_sharp_s(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^\p{L}\p{Nd}]", ""))


def supplier_key(vat_id: Column, name: Column) -> Column:
    vat = alphanumeric_upper(vat_id)
    return (F.when(F.length(vat) >= MIN_VAT_KEY_LENGTH, F.concat(F.lit("VAT:"), vat))
            .otherwise(F.concat(F.lit("NAME:"), alphanumeric_upper(name))))


def invoice_number_key(number: Column) -> Column:
    return alphanumeric_upper(number)

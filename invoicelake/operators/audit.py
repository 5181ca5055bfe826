"""Integrity of the stored tables, as one row per check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import INVOICES_TABLE, LINES_TABLE, LOG_STATUSES, LOG_TABLE
from .lookup import union_all


def _nulls(df: DataFrame, table: T.StructType, name: str) -> DataFrame:
    """Nulls in required columns: all columns of a table in one pass."""
    required = [f.name for f in table.fields if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counts.unpivot([], required, "column", "violations").select(
        F.concat(F.lit(f"{name}.not_null."), F.col("column")).alias("check"), "violations")


def _one(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(check).alias("check"), "violations")


def _orphans(df: DataFrame, column: str, invoices: DataFrame) -> DataFrame:
    keys = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return (keys.join(invoices.select(F.col("id").alias(column)), column, "left_anti")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("violations")))


def integrity_audit(invoices: DataFrame, lines: DataFrame, log: DataFrame) -> DataFrame:
    """check, violations (0 everywhere in a consistent store)."""
    unique = [(["file_sha256"], "invoices.unique.file_sha256"), (["supplier_key", "invoice_number_key"], "invoices.unique.supplier_number")]
    return union_all([
        _nulls(invoices, INVOICES_TABLE, "invoices"),
        _nulls(lines, LINES_TABLE, "invoice_lines"),
        _nulls(log, LOG_TABLE, "processing_log"),
        _one(log.where(~F.col("status").isin(*LOG_STATUSES)), "processing_log.status"),
        _orphans(lines, "invoice_id", invoices).select(F.lit("invoice_lines.references").alias("check"), "violations"),
        _orphans(log, "invoice_id", invoices).select(F.lit("processing_log.references").alias("check"), "violations"),
        *[_one(invoices.groupBy(*keys).count().where("count > 1"), check) for keys, check in unique],
    ])

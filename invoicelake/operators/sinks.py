"""Projections onto the stored tables and the file dispositions, as plain DataFrames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import invoice_number_key, supplier_key
from ..functions.labels import archive_path
from ..functions.text import stem
from ..schemas import INVOICES_TABLE, LINES_TABLE, LOG_STATUSES, LOG_TABLE, to_storage
from ..session import cut
from .lookup import hot_keys, left_lookup

REPORT_SUFFIX = ".fehler.txt"


def _time(at: datetime) -> Column:
    return F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def invoice_rows(imported: DataFrame, at: datetime) -> DataFrame:
    """Header rows of imported documents (header columns plus arrival_seq, file_name, sha256, source_format)."""
    return to_storage(imported, INVOICES_TABLE, {
        "id": F.col("arrival_seq"),
        "supplier_key": supplier_key(F.col("supplier_vat_id"), F.col("supplier_name")),
        "invoice_number_key": invoice_number_key(F.col("invoice_number")),
        "source_file": F.col("file_name"),
        "archive_path": archive_path(F.col("invoice_date"), F.col("sha256"), F.col("file_name")),
        "file_sha256": F.col("sha256"),
        "imported_at": _time(at),
    })


def line_rows(lines: DataFrame) -> DataFrame:
    """Line rows from flat lines (invoice_id, id and the line columns)."""
    return to_storage(lines, LINES_TABLE)


def log_rows(outcomes: DataFrame, at: datetime | None = None) -> DataFrame:
    """Log rows: no retries, errors joined by line breaks, null if there are none."""
    errors = F.when(F.size("errors") > 0, F.array_join("errors", "\n"))
    values = {"errors": errors, "file_sha256": F.col("sha256")}
    if at is not None:
        values |= {"id": F.col("arrival_seq"), "processed_at": _time(at)}
    return to_storage(outcomes.where(F.col("status").isin(*LOG_STATUSES)), LOG_TABLE, values)


def archive_rows(imported: DataFrame, *more: str) -> DataFrame:
    """Where each imported original goes, with `more` of its columns (the store keeps the locator)."""
    path = archive_path(F.col("invoice_date"), F.col("sha256"), F.col("file_name"))
    return imported.select("arrival_seq", *more, F.date_format("invoice_date", "yyyy").alias("year"),
                           F.date_format("invoice_date", "MM").alias("month"), path.alias("archive_path"))


def disposition(status: Column) -> Column:
    return (F.when(status == "imported", "delete").when(status == "duplicate", "duplicates")
            .when(status.isin("validation_failed", "failed"), "failed").otherwise("keep"))


def inbox_manifest(outcomes: DataFrame, taken: DataFrame, at: datetime) -> DataFrame:
    """What happens to every inbox file. `taken` lists (disposition, file_name) already present in the target folders.

    A name that is taken, in the folder or by an earlier file of the batch, gets a time stamp; when that alone would not
    be unique the arrival number follows. Names are resolved with one aggregation per target name, not by numbering a
    group of equal names in one task.
    """
    moved = outcomes.withColumn("disposition", disposition(F.col("status")))
    names = moved.where(F.col("disposition").isin("duplicates", "failed")).groupBy("disposition", "file_name").agg(
        F.min("arrival_seq").alias("first_seq"), F.count(F.lit(1)).alias("same_name"))
    names = names.join(taken.select("disposition", "file_name").distinct().withColumn("exists", F.lit(True)),
                       ["disposition", "file_name"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    names = cut(names)
    on = ["disposition", "file_name"]
    found = left_lookup(moved, names, on, hot_keys(names, on, rows="same_name"))
    is_first = F.col("arrival_seq") == F.col("first_seq")
    free = is_first & ~F.col("exists")
    alone = F.when(F.col("exists"), is_first).otherwise(F.col("same_name") == 2)
    stamp = at.strftime("%Y%m%d-%H%M%S")
    suffix = F.when(alone, F.lit(f"_{stamp}")).otherwise(F.concat(F.lit(f"_{stamp}-"), F.col("arrival_seq")))
    renamed = F.concat(stem(F.col("file_name")), suffix, F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    target = F.when(F.col("disposition").isin("duplicates", "failed"), F.when(free, F.col("file_name")).otherwise(renamed))
    return (found.withColumn("target_name", target).drop("first_seq", "same_name", "exists")
            .withColumn("report_name", F.when(F.col("disposition") == "failed", F.concat("target_name", F.lit(REPORT_SUFFIX)))))


def report_head(manifest: DataFrame, at: datetime) -> DataFrame:
    """The first three lines of every error report, as rows (arrival_seq, report_name, section, line_number, text)."""
    failed = manifest.where(F.col("disposition") == "failed")
    head = F.array(
        F.struct(F.lit(1).alias("n"), F.concat(F.lit("Datei:     "), F.col("target_name")).alias("text")),
        F.struct(F.lit(2).alias("n"), F.lit("Zeitpunkt: " + at.strftime("%d.%m.%Y %H:%M:%S")).alias("text")),
        F.struct(F.lit(3).alias("n"), F.concat(F.lit("Ergebnis:  "), F.col("message")).alias("text")))
    return (failed.select("arrival_seq", "report_name", F.explode(head).alias("h"))
            .select("arrival_seq", "report_name", F.lit(0).alias("section"), F.col("h.n").alias("line_number"), F.lit("").alias("rule"), "h.text"))


def report_errors(manifest: DataFrame, errors: DataFrame) -> DataFrame:
    """One report line per error row (arrival_seq, section, line_number, rule, text)."""
    failed = manifest.where(F.col("disposition") == "failed").select("arrival_seq", "report_name")
    return (errors.join(failed, "arrival_seq")
            .select("arrival_seq", "report_name", "section", "line_number", "rule", F.concat(F.lit("  - "), F.col("text")).alias("text")))


def error_report(file: Column, at: datetime, message: Column, errors: Column) -> Column:
    """The whole report of a document whose errors are an array."""
    head = F.array(F.concat(F.lit("Datei:     "), file), F.lit("Zeitpunkt: " + at.strftime("%d.%m.%Y %H:%M:%S")), F.concat(F.lit("Ergebnis:  "), message))
    body = F.transform(errors, lambda e: F.concat(F.lit("  - "), e))
    return F.concat(F.array_join(F.concat(head, body), "\n"), F.lit("\n"))



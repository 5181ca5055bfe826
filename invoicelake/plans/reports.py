"""Read side: newest invoices and log rows, lines of an invoice, and the three accounting reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import log_state, status_text

LIST_LIMIT = 500


def line_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("invoice_id").agg(F.count(F.lit(1)).alias("line_count"))


def latest_invoices(invoices: DataFrame, lines: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """The newest invoices with their line counts; only lines of these invoices are counted."""
    newest = invoices.select(
        "id", "supplier_name", "supplier_vat_id", "invoice_number", "invoice_date", "due_date", "currency", "net_total",
        "tax_total", "gross_total", "source_format", "source_file", "archive_path", "imported_at").orderBy(F.desc("id")).limit(limit)
    # `limit` bounds the broadcast side.
    own = lines.select("invoice_id").join(F.broadcast(newest.select(F.col("id").alias("invoice_id"))), "invoice_id", "left_semi")
    return (newest.join(line_counts(own).withColumnRenamed("invoice_id", "id"), "id", "left")
            .withColumn("line_count", F.coalesce("line_count", F.lit(0))).orderBy(F.desc("id")))


def lines_of(lines: DataFrame, invoice_id: int) -> DataFrame:
    return (lines.where(F.col("invoice_id") == invoice_id)
            .select("line_number", "article_number", "description", "quantity", "free_quantity", "unit", "unit_price",
                    "discount_percent", "discount_amount", "net_amount", "vat_rate", "id")
            .orderBy("line_number", "id").drop("id"))


def latest_log(log: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    return (log.select("id", "processed_at", "file_name", "status", "source_format", "invoice_id", "message", "errors", "duration_ms")
            .orderBy(F.desc("id")).limit(limit))


def report_invoices(invoices: DataFrame, lines: DataFrame, ordered: bool = True) -> DataFrame:
    out = invoices.join(line_counts(lines).withColumnRenamed("invoice_id", "id"), "id", "left").select(
        "id", F.col("supplier_name").alias("lieferant"), F.col("invoice_number").alias("rechnungsnr"),
        F.col("invoice_date").alias("datum"), F.col("net_total").alias("netto"), F.col("tax_total").alias("ust"),
        F.col("gross_total").alias("brutto"), F.coalesce("line_count", F.lit(0)).alias("positionen"),
        F.col("source_format").alias("quelle"))
    return out.orderBy("id") if ordered else out


def report_lines(invoices: DataFrame, lines: DataFrame, ordered: bool = True) -> DataFrame:
    """Lines with their invoice's number. An invoice with very many lines is split by adaptive execution in the join, and
    the line id as last sort key lets the sort split it as well."""
    numbers = invoices.select(F.col("id").alias("invoice_id"), F.col("invoice_number").alias("rechnungsnr"))
    out = lines.join(numbers, "invoice_id")
    if ordered:
        out = out.orderBy("invoice_id", "line_number", "id")
    return out.select(
        "rechnungsnr", F.col("line_number").alias("pos"), F.col("article_number").alias("artikelnr"),
        F.col("description").alias("bezeichnung"), F.col("quantity").alias("menge"), F.col("free_quantity").alias("gratis"),
        F.col("unit").alias("einheit"), F.col("unit_price").alias("einzelpreis"), F.col("discount_percent").alias("rabatt_proz"),
        F.col("discount_amount").alias("rabatt"), F.col("net_amount").alias("betrag"), F.col("vat_rate").alias("ust_satz"))


def report_log(log: DataFrame, ordered: bool = True) -> DataFrame:
    """Times are rounded to the second, half up."""
    out = log.orderBy("id") if ordered else log
    return out.select(
        F.date_trunc("second", F.col("processed_at") + F.expr("interval 500 milliseconds")).alias("zeit"),
        F.col("file_name").alias("datei"), "status", F.col("source_format").alias("quelle"),
        F.col("invoice_id").alias("rechnung_id"), F.col("message").alias("meldung"), F.col("errors").alias("fehler"))


def log_view(log: DataFrame, zone: str) -> DataFrame:
    """Log rows with local time, German status text and state."""
    return log.select("id", F.from_utc_timestamp("processed_at", zone).alias("local_time"), "file_name", "status",
                      status_text(F.col("status")).alias("status_text"), log_state(F.col("status")).alias("state"))

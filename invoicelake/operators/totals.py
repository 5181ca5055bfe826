"""Invoice totals computed from lines (the calculation behind a printed invoice)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_of


def calculated_lines(lines: DataFrame) -> DataFrame:
    """Add line gross, line discount and line net from quantity, unit price and discount percent."""
    gross = F.round((F.col("quantity") * F.col("unit_price")).cast("decimal(36,14)"), 2).cast("decimal(20,2)")
    discount = percent_of(F.col("line_gross"), F.coalesce("discount_percent", F.lit(0))).cast("decimal(20,2)")
    return (lines.withColumn("line_gross", gross).withColumn("line_discount", discount)
            .withColumn("line_net", (F.col("line_gross") - F.col("line_discount")).cast("decimal(20,2)")))


def rate_groups(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Calculated lines summed per document and rate, with what the totals need further up."""
    return lines.groupBy(doc, "vat_rate").agg(
        F.sum("line_net").cast("decimal(28,2)").alias("net"),
        F.count(F.lit(1)).alias("lines"),
        F.min("line_number").alias("first_line"),
        F.bool_or(F.col("line_discount") != 0).alias("has_discount"),
        F.bool_or(F.coalesce("free_quantity", F.lit(0)) != 0).alias("has_free_goods"),
    )


def invoice_totals(groups: DataFrame, terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Totals per document.

    `terms` has one row per document: allowance_percent and printed_net (null unless the printed net total is forced;
    then tax follows the printed net total at the rate of the first line). An allowance over several rates has no
    defined split: such documents get allowance_rejected = true and null totals.
    """
    dec = "decimal(28,2)"
    sums = groups.groupBy(doc).agg(
        F.sum("net").cast(dec).alias("line_total"),
        F.sum("lines").alias("line_count"),
        F.count("vat_rate").alias("rate_count"),
        F.sum(percent_of(F.col("net"), F.col("vat_rate"))).cast(dec).alias("rate_tax"),
        F.max("vat_rate").alias("top_rate"),
        F.min_by("vat_rate", F.struct("first_line", -F.col("vat_rate"))).alias("first_rate"),
        F.bool_or("has_discount").alias("has_discount"),
        F.bool_or("has_free_goods").alias("has_free_goods"),
    )
    joined = (terms.join(sums, doc, "left")
              .withColumn("line_total", F.coalesce("line_total", F.lit(0).cast(dec)))
              .withColumn("line_count", F.coalesce("line_count", F.lit(0)))
              .withColumn("rate_count", F.coalesce("rate_count", F.lit(0)))
              .withColumn("has_discount", F.coalesce("has_discount", F.lit(False)))
              .withColumn("has_free_goods", F.coalesce("has_free_goods", F.lit(False))))
    return (joined
            .withColumn("allowance", percent_of(F.col("line_total"), F.coalesce("allowance_percent", F.lit(0))))
            .withColumn("allowance_rejected", (F.col("allowance") != 0) & (F.col("rate_count") > 1))
            .withColumn("net", F.when(~F.col("allowance_rejected"), F.coalesce("printed_net", F.col("line_total") - F.col("allowance"))).cast(dec))
            .withColumn("tax", F.when(~F.col("allowance_rejected"), F.coalesce(
                F.when(F.col("printed_net").isNotNull(), percent_of(F.col("printed_net"), F.col("first_rate")))
                .when(F.col("allowance") != 0, percent_of(F.col("line_total") - F.col("allowance"), F.col("top_rate")))
                .otherwise(F.col("rate_tax")), F.lit(0).cast(dec))).cast(dec))
            .withColumn("gross", (F.col("net") + F.col("tax")).cast(dec))
            .withColumn("several_rates", F.col("rate_count") > 1))


def vat_breakdown(groups: DataFrame, allowances: DataFrame | None = None, doc: str = "doc_id") -> DataFrame:
    """Basis and tax per document and rate. `allowances` (one row per document) lowers the basis."""
    if allowances is not None:
        groups = groups.join(allowances.select(doc, "allowance"), doc, "left")
        basis = F.col("net") - F.coalesce("allowance", F.lit(0).cast("decimal(28,2)"))
    else:
        basis = F.col("net")
    return (groups.withColumn("basis", basis.cast("decimal(28,2)"))
            .withColumn("tax", percent_of(F.col("basis"), F.col("vat_rate")))
            .select(doc, "vat_rate", "basis", "tax", "lines"))

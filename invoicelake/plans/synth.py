"""The invoice view over order tables: one invoice per order, faults by fixed rules on the order key k.

This is the synthetic data of the engine (known faults, second deliveries); all of it is derived from the given tables
by Spark, so it grows with them.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.totals import calculated_lines, invoice_totals, rate_groups
from ..operators.validate import Settings
from ..schemas import AMOUNT, HEADER_COLUMNS, LINE_COLUMNS, PERCENT, PRICE, QUANTITY

AS_OF = date(2006, 1, 1)
COPY_STRIDE = 1_000_000_000_000
BROADCAST_SUPPLIERS = 1_000_000
# The unit codes given to the lines, by part key.
UNIT_CODES = ["H87", "C62", "KGM", "LTR", "XBX", "XCS", "XCR", "XPK", "XRO", "HUR", "MTR"]


def settings() -> Settings:
    return Settings(as_of=AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(n: int, rest: int = 0, key: str = "doc_id") -> Column:
    return F.col(key) % n == rest


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as invoice lines without faults."""
    li = table(spark, sf_dir, "lineitem")
    k, part = F.col("l_orderkey"), F.col("l_partkey")
    codes = F.array(*[F.lit(c) for c in UNIT_CODES])
    lines = li.select(
        k.alias("doc_id"),
        F.col("l_linenumber").cast("int").alias("line_number"),
        F.concat(F.lit("P-"), part).alias("article_number"),
        F.concat(F.lit("Artikel "), part).alias("description"),
        F.col("l_quantity").cast(QUANTITY).alias("quantity"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast(QUANTITY).alias("free_quantity"),
        F.element_at(codes, (part % len(UNIT_CODES) + 1).cast("int")).alias("unit_code"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(PRICE).alias("unit_price"),
        F.round(F.col("l_discount") * 100).cast(PERCENT).alias("discount_percent"),
        F.when((k % 2 == 0) | (F.col("l_linenumber") % 2 == 1), 19).otherwise(7).cast(PERCENT).alias("vat_rate"),
    )
    return calculated_lines(lines)


def printed_lines(clean: DataFrame, misread: bool = True) -> DataFrame:
    """Lines as printed: faults on single lines, a third of the documents with discount amounts.

    `misread` puts the first line of every 17th document off by 1.00.
    """
    from ..functions.labels import unit_text

    def first(n: int) -> Column:
        return every(n) & (F.col("line_number") == 1)

    return clean.select(
        "doc_id", "line_number", "article_number",
        F.when(every(43) & (F.col("line_number") == 2), F.lit(" ")).otherwise(F.col("description")).alias("description"),
        "quantity",
        F.when(every(47) & (F.col("line_number") == 3), -1).otherwise(F.col("free_quantity")).cast(QUANTITY).alias("free_quantity"),
        unit_text(F.col("unit_code")).alias("unit"),
        "unit_code", "unit_price", "discount_percent",
        F.when(every(3), F.col("line_discount")).cast(AMOUNT).alias("discount_amount"),
        (F.col("line_net") + F.when(first(17) & F.lit(misread), 1).otherwise(0)).cast(AMOUNT).alias("net_amount"),
        F.when(~first(11), F.col("vat_rate")).alias("vat_rate"),
    )


def with_right_net(printed: DataFrame) -> DataFrame:
    """Add `right_net` to printed lines: the net amount without the misread one (see printed_lines)."""
    misread = F.when(every(17) & (F.col("line_number") == 1), 1).otherwise(0)
    return printed.withColumn("right_net", (F.col("net_amount") - misread).cast(AMOUNT))


def as_read(df: DataFrame) -> DataFrame:
    """Nested invoices by attempt: attempt 2 has the right net amounts. Lines equal up to them are equal in them too, so their order is the same."""
    net = lambda x: F.when(F.col("attempt") == 2, x["right_net"]).otherwise(x["net_amount"])
    lines = F.transform("invoice.lines", lambda x: x.withField("net_amount", net(x)).dropFields("right_net"))
    return df.withColumn("invoice", F.col("invoice").withField("lines", lines))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their terms: 2 % allowance on some single-rate documents, no forced net total."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_custkey",
        F.add_months(F.to_date("o_orderdate"), 60).alias("base_date"))
    return (rows.withColumn("allowance_percent", F.when(every(26), 2).otherwise(0).cast(PERCENT))
            .withColumn("printed_net", F.lit(None).cast("decimal(28,2)")))


def printed_headers(spark: SparkSession, sf_dir: str, clean: DataFrame) -> DataFrame:
    """Headers as printed."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n_suppliers = suppliers.agg(F.max("s_suppkey") + 1).scalar()
    # A shuffle by supplier would move every header twice, to its supplier and back to its document.
    if suppliers.limit(BROADCAST_SUPPLIERS + 1).count() <= BROADCAST_SUPPLIERS:
        suppliers = F.broadcast(suppliers)
    totals = invoice_totals(rate_groups(clean), orders(spark, sf_dir))
    k = F.col("doc_id")
    # Four orders in a row share a supplier, eight a running number: numbers collide within and between suppliers at
    # every size, and no number key grows with the data.
    base = totals.withColumn("s_suppkey", F.floor(k / 4) % n_suppliers).join(suppliers, "s_suppkey")
    number = F.format_string("RE-%d-%05d", F.year("base_date"), F.floor(k / 8))
    charge = F.when(every(53), 5).otherwise(0).cast("decimal(10,2)")
    late = F.when(every(31), F.lit("0.50")).otherwise(F.lit("0")).cast("decimal(10,2)")
    return base.select(
        "doc_id",
        F.when(every(41), F.lit(" ")).otherwise(F.col("s_name")).alias("supplier_name"),
        F.concat(F.lit("DE"), (F.lit(811000000) + F.col("s_suppkey")).cast("string")).alias("supplier_vat_id"),
        F.concat(F.lit("Werkstraße "), F.col("s_suppkey") + 1).alias("supplier_street"),
        F.format_string("%05d", F.lit(80000) + F.col("s_nationkey")).alias("supplier_postal_code"),
        F.concat(F.lit("Ort "), F.col("s_nationkey")).alias("supplier_city"),
        F.when(every(23), F.lit(" ")).otherwise(number).alias("invoice_number"),
        F.when(every(37), F.add_months("base_date", -84)).otherwise(F.col("base_date")).alias("invoice_date"),
        F.date_add("base_date", 30).alias("due_date"),
        F.when(every(29), F.lit("EURO")).otherwise(F.lit("EUR")).alias("currency"),
        F.concat(F.lit("EK-"), F.col("o_custkey")).alias("order_reference"),
        F.col("allowance").cast(AMOUNT).alias("allowance_total"),
        charge.cast(AMOUNT).alias("charge_total"),
        (F.col("net") + charge + F.when(every(19), 9).otherwise(0)).cast(AMOUNT).alias("net_total"),
        (F.col("tax") + late).cast(AMOUNT).alias("tax_total"),
        (F.col("net") + charge + F.col("tax") + late).cast(AMOUNT).alias("gross_total"),
    )


def invoice_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) as printed."""
    clean = clean_lines(spark, sf_dir)
    return printed_headers(spark, sf_dir, clean), printed_lines(clean)


def deliveries(headers: DataFrame) -> DataFrame:
    """Every header delivered once, some twice: without VAT ID, as the identical file, or in another spelling."""
    copies = F.when(F.col("doc_id") % 10 < 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return _as_delivered(headers.withColumn("copy", F.explode(copies)))


def first_deliveries(headers: DataFrame) -> DataFrame:
    """Every header delivered once."""
    return _as_delivered(headers.withColumn("copy", F.lit(0)))


def _as_delivered(out: DataFrame) -> DataFrame:
    kind = F.col("doc_id") % 10
    again = F.col("copy") == 1
    vat, number = F.col("supplier_vat_id"), F.col("invoice_number")
    spelled_vat = F.concat(F.lower(F.substring(vat, 1, 2)), F.lit(" "), F.substring(vat, 3, 3), F.lit(" "), F.substring(vat, 6, 6))
    return (out
            .withColumn("supplier_vat_id", F.when(again & (kind == 0), F.lit(None)).when(again & (kind == 2), spelled_vat).otherwise(vat))
            .withColumn("invoice_number", F.when(again & (kind == 2), F.lower(F.translate(number, "-", " "))).otherwise(number))
            .withColumn("arrival_seq", F.col("copy").cast("bigint") * COPY_STRIDE + F.col("doc_id"))
            .withColumn("file_name", F.concat(F.lit("inv_"), F.col("doc_id"), F.lit(".xml")))
            .withColumn("sha256", F.sha2(F.concat_ws("|", F.lit("inv"), F.col("doc_id"), F.when(again & (kind != 1), 1).otherwise(0)).cast("binary"), 256))
            .withColumn("source_format", F.when(every(2), "XRechnung UBL").otherwise("XRechnung CII")))


def nested_invoices(headers: DataFrame, lines: DataFrame, extra_line_columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with its lines in printed order. A document is one file, so its lines fit in one row."""
    columns = [*LINE_COLUMNS, *extra_line_columns]
    gathered = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("lines"))
    empty = F.array().cast(gathered.schema["lines"].dataType)
    joined = headers.join(gathered, "doc_id", "left").withColumn("lines", F.coalesce("lines", empty))
    return joined.select("doc_id", F.struct(*HEADER_COLUMNS, "lines").alias("invoice"))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processing outcomes; a retry must never reach the log."""
    events = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for x in (
        "purchase", "imported", "click", "duplicate", "view", "validation_failed", "error", "failed", "signup", "retry")])
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("processed_at"),
        F.format_string("f_%d.xml", F.col("user_id")).alias("file_name"),
        F.sha2(F.col("user_id").cast("string").cast("binary"), 256).alias("sha256"),
        status[F.col("event_type")].alias("status"),
        F.lit("XRechnung UBL").alias("source_format"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("invoice_id"),
        F.concat(F.lit("Meldung "), F.col("event_type")).alias("message"),
        F.when(F.col("event_type") == "view", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.round("value").cast("int").alias("duration_ms"),
    )

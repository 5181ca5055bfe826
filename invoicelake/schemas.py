"""Types of the invoice model in flight and of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, types as T
from pyspark.sql import functions as F

# In flight: wide enough that validation sees what the document printed.
QUANTITY = T.DecimalType(16, 6)
PRICE = T.DecimalType(28, 16)
AMOUNT = T.DecimalType(20, 6)
PERCENT = T.DecimalType(9, 4)

LINE = T.StructType([
    T.StructField("line_number", T.IntegerType()),
    T.StructField("article_number", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", QUANTITY),
    T.StructField("free_quantity", QUANTITY),
    T.StructField("unit", T.StringType()),
    T.StructField("unit_price", PRICE),
    T.StructField("discount_percent", PERCENT),
    T.StructField("discount_amount", AMOUNT),
    T.StructField("net_amount", AMOUNT),
    T.StructField("vat_rate", PERCENT),
])

HEADER_FIELDS = [
    T.StructField("supplier_name", T.StringType()),
    T.StructField("supplier_vat_id", T.StringType()),
    T.StructField("supplier_street", T.StringType()),
    T.StructField("supplier_postal_code", T.StringType()),
    T.StructField("supplier_city", T.StringType()),
    T.StructField("invoice_number", T.StringType()),
    T.StructField("invoice_date", T.DateType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("currency", T.StringType()),
    T.StructField("order_reference", T.StringType()),
    T.StructField("allowance_total", AMOUNT),
    T.StructField("charge_total", AMOUNT),
    T.StructField("net_total", AMOUNT),
    T.StructField("tax_total", AMOUNT),
    T.StructField("gross_total", AMOUNT),
]
HEADER_COLUMNS = [f.name for f in HEADER_FIELDS]
LINE_COLUMNS = [f.name for f in LINE.fields]

INVOICE = T.StructType([*HEADER_FIELDS, T.StructField("lines", T.ArrayType(LINE))])

# What every reader returns for a document, next to the document's own columns.
READ_COLUMNS = ["invoice", "source_format", "description", "read_status", "read_message", "errors", "second_read"]

_MONEY = T.DecimalType(18, 2)
_FINE = T.DecimalType(18, 4)


def _field(name: str, kind: T.DataType, required: bool = False) -> T.StructField:
    return T.StructField(name, kind, not required)


INVOICES_TABLE = T.StructType([
    _field("id", T.LongType(), True),
    _field("supplier_name", T.StringType(), True),
    _field("supplier_vat_id", T.StringType()),
    _field("supplier_street", T.StringType()),
    _field("supplier_postal_code", T.StringType()),
    _field("supplier_city", T.StringType()),
    _field("supplier_key", T.StringType(), True),
    _field("invoice_number", T.StringType(), True),
    _field("invoice_number_key", T.StringType(), True),
    _field("invoice_date", T.DateType(), True),
    _field("due_date", T.DateType()),
    _field("currency", T.StringType(), True),
    _field("order_reference", T.StringType()),
    _field("allowance_total", _MONEY, True),
    _field("charge_total", _MONEY, True),
    _field("net_total", _MONEY, True),
    _field("tax_total", _MONEY, True),
    _field("gross_total", _MONEY, True),
    _field("source_format", T.StringType(), True),
    _field("source_file", T.StringType(), True),
    _field("archive_path", T.StringType()),
    _field("file_sha256", T.StringType(), True),
    _field("imported_at", T.TimestampType(), True),
])

LINES_TABLE = T.StructType([
    _field("id", T.LongType(), True),
    _field("invoice_id", T.LongType(), True),
    _field("line_number", T.IntegerType(), True),
    _field("article_number", T.StringType()),
    _field("description", T.StringType(), True),
    _field("quantity", _FINE, True),
    _field("free_quantity", _FINE, True),
    _field("unit", T.StringType()),
    _field("unit_price", _FINE, True),
    _field("discount_percent", PERCENT),
    _field("discount_amount", _MONEY),
    _field("net_amount", _MONEY, True),
    _field("vat_rate", T.DecimalType(5, 2)),
])

LOG_TABLE = T.StructType([
    _field("id", T.LongType(), True),
    _field("processed_at", T.TimestampType(), True),
    _field("file_name", T.StringType(), True),
    _field("file_sha256", T.StringType(), True),
    _field("status", T.StringType(), True),
    _field("source_format", T.StringType()),
    _field("invoice_id", T.LongType()),
    _field("message", T.StringType(), True),
    _field("errors", T.StringType()),
    _field("duration_ms", T.IntegerType()),
])

# Columns that are 0 when the source leaves them out.
ZERO_DEFAULTS = {"allowance_total", "charge_total", "free_quantity"}

LOG_STATUSES = ["imported", "duplicate", "validation_failed", "failed"]


def fits_storage(invoice: Column) -> Column:
    """Whether the stored tables can hold every number of an invoice, and the value of every line."""
    def fits(get, table: T.StructType) -> list[Column]:
        found = []
        for field in table.fields:
            if isinstance(field.dataType, T.DecimalType):
                value = get[field.name]
                missing = F.lit(field.nullable or field.name in ZERO_DEFAULTS)
                found.append(F.when(value.isNull(), missing).otherwise(value.try_cast(field.dataType).isNotNull()))
        return found

    def line_fits(x: Column) -> Column:
        return _all([*fits(x, LINES_TABLE), (x["quantity"] * x["unit_price"]).try_cast(_MONEY).isNotNull()])

    return _all([*fits(invoice, INVOICES_TABLE), F.forall(invoice["lines"], line_fits)])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def to_storage(df, table: T.StructType, values: dict[str, Column] | None = None):
    """Project onto a stored table: defaults, then rounding to the table's scale."""
    values = values or {}
    out = []
    for field in table.fields:
        value = values.get(field.name, F.col(field.name) if field.name in df.columns else F.lit(None))
        if field.name in ZERO_DEFAULTS:
            value = F.coalesce(value, F.lit(0))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)

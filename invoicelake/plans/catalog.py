"""The registered queries: each takes (spark, sf_dir) and runs over the whole tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import alphanumeric_upper, invoice_number_key, supplier_key
from ..functions.text import extension
from ..operators import dedup, outcome, sinks, totals, validate
from ..operators.audit import integrity_audit as audit_tables
from ..operators.lookup import hot_keys, left_lookup
from ..operators.store import Store
from ..schemas import HEADER_COLUMNS, LINE_COLUMNS
from ..session import cut, scratch_path, staged
from ..sources import answers, attachments, einvoice, readers
from ..streaming import inbox
from . import importing, render, reports, synth

RUN_TIME = datetime(2006, 1, 1, 12, 30, 15)


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so results compare by value with any other engine."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


# Totals and validation ---------------------------------------------------------------------------------------------

def invoice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G6-G8 with forced net totals on some orders and an allowance on all of every 13th (several rates: rejected)."""
    k = F.col("doc_id")
    terms = synth.orders(spark, sf_dir).select(
        "doc_id", F.when(k % 13 == 0, 2).otherwise(0).cast("decimal(9,4)").alias("allowance_percent"),
        F.when((k % 19 == 0) & (k % 13 != 0), F.lit(1234.56)).cast("decimal(28,2)").alias("printed_net"))
    out = totals.invoice_totals(totals.rate_groups(synth.clean_lines(spark, sf_dir)), terms)
    return plain(out.select("doc_id", "line_total", "line_count", "rate_count", "has_discount", "has_free_goods", "several_rates",
                            "allowance", "allowance_rejected", "net", "tax", "gross"))


def vat_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basis and tax per order and rate, highest rate first."""
    groups = totals.rate_groups(synth.clean_lines(spark, sf_dir))
    return plain(totals.vat_breakdown(groups).orderBy("doc_id", F.desc("vat_rate")))


def line_arithmetic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7-V9 on every line."""
    _, lines = synth.invoice_view(spark, sf_dir)
    return validate.flat_line_errors(lines, synth.settings()).drop("section")


def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1-V6, V10, V11 with the sums they use."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    t = validate.with_totals(headers, lines)
    found = F.concat(validate.opening_findings(F.col, synth.settings()), validate.closing_findings(F.col, synth.settings()))
    codes = F.transform(F.filter(found, lambda f: f["rule"] != "V12"), lambda f: f["rule"])
    return plain(t.select("doc_id", "line_count", "line_sum", "net_total", "tax_total", "gross_total", F.array_join(codes, ",").alias("broken")))


def tax_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected tax, number of rates and whether the printed tax is off."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    t = validate.with_totals(headers, lines)
    found = F.filter(validate.closing_findings(F.col, synth.settings()), lambda f: f["rule"] == "V12")
    return plain(t.select("doc_id", "rate_count", "has_open_rate", validate.expected_tax(F.col).cast("decimal(28,2)").alias("expected_tax"),
                          "tax_total", (F.size(found) > 0).alias("broken")))


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every validation error of every invoice, in reporting order within the invoice."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    return validate.flat_errors(headers, lines, synth.settings())


def rejected_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices that stay out, with their number of errors."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    counted = validate.flat_error_counts(headers, lines, synth.settings())
    return plain(counted.where("error_count > 0").select("doc_id", "invoice_number", "supplier_name", "gross_total", "error_count"))


# Keys and duplicates -----------------------------------------------------------------------------------------------

def supplier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C22, C23 on every supplier: with VAT ID, with one that is too short, and by name."""
    s = synth.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    vat = F.when(k % 3 == 0, F.concat(F.lit("de 811."), k)).when(k % 3 == 1, F.lit("D-1"))
    name = F.concat(F.lit("Groß & Söhne² "), F.col("s_name"))
    return s.select("s_suppkey", supplier_key(vat, name).alias("supplier_key"), alphanumeric_upper(name).alias("name_key"))


def invoice_number_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C24 on every delivery."""
    headers, _ = synth.invoice_view(spark, sf_dir)
    d = synth.deliveries(headers)
    return d.select("arrival_seq", "invoice_number", invoice_number_key(F.col("invoice_number")).alias("number_key"))


def file_hash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical texts among the documents; every copy points to the first file of its content."""
    docs = synth.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("arrival_seq"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    contents = cut(docs.groupBy("sha256").agg(F.min("arrival_seq").alias("first_seq"), F.count(F.lit(1)).alias("rows")))
    copies = left_lookup(docs, contents.drop("rows"), ["sha256"], hot_keys(contents, ["sha256"], rows="rows"))
    return copies.select("arrival_seq", F.format_string("doc_%d.txt", F.col("arrival_seq")).alias("file_name"), "sha256", "first_seq",
                         (F.col("arrival_seq") != F.col("first_seq")).alias("is_copy"))


def _keyed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, _ = synth.invoice_view(spark, sf_dir)
    return outcome.with_keys(synth.deliveries(headers))


def content_duplicates_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second deliveries looked up among the first ones (all taken as stored)."""
    d = cut(_keyed_headers(spark, sf_dir).select("copy", "arrival_seq", "number_key", "supplier_key", "invoice_date", "gross_total",
                                                "invoice_number", "supplier_name", "file_name"))
    stored = d.where("copy = 0").select(
        F.col("arrival_seq").alias("id"), "supplier_key", F.col("number_key").alias("invoice_number_key"), "invoice_date",
        F.col("gross_total").cast("decimal(18,2)").alias("gross_total"), "invoice_number", "supplier_name", F.col("file_name").alias("source_file"))
    incoming = cut(d.where("copy = 1").select("arrival_seq", "number_key", "supplier_key", "invoice_date", "gross_total"))
    found = dedup.find_duplicates(incoming, stored)
    return found.select("arrival_seq", F.col("hit.id").alias("duplicate_of"), F.col("hit.invoice_number").alias("their_number"),
                        F.col("hit.source_file").alias("their_file"))


def sequential_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 over all deliveries (valid or not): which are imported when taken one by one."""
    d = _keyed_headers(spark, sf_dir).select("arrival_seq", "number_key", "supplier_key", "invoice_date", "gross_total")
    return dedup.greedy_imports(d).select("arrival_seq", "number_key", "supplier_key")


# The import --------------------------------------------------------------------------------------------------------

def deliveries_with_status(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """All deliveries with their own status, as a checkpointed table: the header columns that decisions need, and `more`."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    needed = [c for c in HEADER_COLUMNS if c in (*outcome.DOCUMENT_COLUMNS, *more)]
    counted = validate.flat_error_counts(headers, lines, synth.settings()).select("doc_id", "error_count", *needed)
    d = synth.deliveries(counted)
    return cut(d.withColumn("own_status", F.when(F.col("error_count") == 0, "valid").otherwise("validation_failed"))
               .withColumn("own_message", F.lit(None).cast("string")).withColumn("second_read", F.lit(False)))


def outcomes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return outcome.decide(deliveries_with_status(spark, sf_dir, *more))


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome per delivery."""
    return outcomes(spark, sf_dir).select("arrival_seq", "file_name", "sha256", "status", "source_format", "invoice_id", "message")


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run (one run per invoice month) and its summary line."""
    o = outcomes(spark, sf_dir).select("status", F.date_format("invoice_date", "yyyy-MM").alias("run"))
    return outcome.run_summary(o, "run")


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts per delivery."""
    o = outcomes(spark, sf_dir, "currency", "supplier_street", "supplier_postal_code", "supplier_city")
    o = (o.withColumn("description", F.when(F.col("was_read"), F.concat(F.col("source_format"), F.lit(" – gelesen"))))
         .withColumn("duration_ms", F.col("doc_id") % 2500))
    return outcome.item_texts(o).drop("file_name")


def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive location of every imported original."""
    return sinks.archive_rows(outcomes(spark, sf_dir).where("status = 'imported'"))


def _taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that already lie in the target folders: one per seventh order."""
    k = synth.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).where("k % 7 = 0")
    return k.select(F.when(F.col("k") % 2 == 0, "duplicates").otherwise("failed").alias("disposition"),
                    F.concat(F.lit("inv_"), F.col("k"), F.lit(".xml")).alias("file_name"))


def inbox_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to every delivered file and under which name."""
    m = sinks.inbox_manifest(cut(outcomes(spark, sf_dir).select("arrival_seq", "file_name", "status", "message")), _taken(spark, sf_dir), RUN_TIME)
    return m.select("arrival_seq", "disposition", "target_name", "report_name")


def error_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every error report."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    o = cut(outcomes(spark, sf_dir).select("doc_id", "arrival_seq", "file_name", "status", "message"))
    m = sinks.inbox_manifest(o, _taken(spark, sf_dir), RUN_TIME)
    failed = m.where("disposition = 'failed'").select("doc_id", "arrival_seq", "report_name")
    errors = validate.flat_errors(headers, lines, synth.settings()).join(failed.select("doc_id", "arrival_seq"), "doc_id")
    return sinks.report_head(m, RUN_TIME).unionByName(sinks.report_errors(failed.withColumn("disposition", F.lit("failed")), errors))


# Stored tables and reports -----------------------------------------------------------------------------------------

def stored_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored view: every order as a stored invoice (id = order key) with its lines."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    invoices = sinks.invoice_rows(synth.first_deliveries(headers), RUN_TIME)
    rows = lines.withColumn("invoice_id", F.col("doc_id")).withColumn(
        "id", F.col("doc_id") * 8 + F.col("line_number"))
    return invoices, sinks.line_rows(rows)


def report_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, J4, G4."""
    return plain(reports.report_invoices(*stored_tables(spark, sf_dir)))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, J3."""
    return plain(reports.report_lines(*stored_tables(spark, sf_dir)))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.log_rows(synth.log_entries(spark, sf_dir))


def report_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries never appear, times are rounded to the second."""
    return reports.report_log(_log(spark, sf_dir))


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log with German texts, state and local time."""
    return reports.log_view(_log(spark, sf_dir), "Europe/Berlin").withColumn("local_time", F.date_format("local_time", "yyyy-MM-dd HH:mm:ss"))


def latest_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the newest 500 invoices with their line counts."""
    return plain(reports.latest_invoices(*stored_tables(spark, sf_dir)).drop("imported_at"))


def latest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the newest 500 log rows."""
    return reports.latest_log(_log(spark, sf_dir)).drop("processed_at")


def invoice_lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of one invoice in printed order."""
    _, lines = stored_tables(spark, sf_dir)
    return plain(reports.lines_of(lines, 100))


def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11, J6 over the stored view: unchecked orders break the number rule."""
    invoices, lines = stored_tables(spark, sf_dir)
    return audit_tables(invoices, lines, _log(spark, sf_dir))


# Documents as XML and JSON -----------------------------------------------------------------------------------------

_HEADER_OUT = ["supplier_name", "supplier_vat_id", "supplier_street", "supplier_postal_code", "supplier_city", "invoice_number", "invoice_date",
               "due_date", "currency", "order_reference", "allowance_total", "charge_total", "net_total", "tax_total", "gross_total"]


def _parsed(rendered: DataFrame) -> DataFrame:
    return einvoice.parse_xml(rendered.select("doc_id", F.col("xml").cast("binary").alias("content")))


def _flat_invoices(parsed: DataFrame) -> DataFrame:
    """One row per line; documents without lines keep one row."""
    rows = parsed.select("doc_id", "syntax", "invoice", F.explode_outer("invoice.lines").alias("l"))
    return plain(rows.select("doc_id", "syntax", *[F.col(f"invoice.{c}").alias(c) for c in _HEADER_OUT], *[F.col(f"l.{c}").alias(c) for c in LINE_COLUMNS]))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.prepared(*synth.invoice_view(spark, sf_dir))


def ubl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice written as UBL and read back."""
    return _flat_invoices(_parsed(render.ubl_xml(_prepared(spark, sf_dir))))


def cii_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every invoice written as CII and read back."""
    return _flat_invoices(_parsed(render.cii_xml(_prepared(spark, sf_dir))))


def _mixed_xml(prepared: DataFrame) -> DataFrame:
    """UBL for even, CII for odd order keys: one CASE over the row, so each invoice is written once."""
    return render.mixed_xml(prepared)


def syntax_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages and rendered invoices as files; pages are no invoices and other extensions have no reader."""
    pages = synth.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("seite_"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, ".XML").otherwise(".html")).alias("file_name"),
        F.col("html").cast("binary").alias("content"))
    invoices = _mixed_xml(_prepared(spark, sf_dir)).select(
        F.concat(F.lit("inv_"), F.col("doc_id"), F.lit(".xml")).alias("file_name"), F.col("xml").cast("binary").alias("content"))
    docs = pages.unionByName(invoices).select("file_name", F.col("file_name").alias("path"), extension(F.col("file_name")).alias("ext"),
                                              F.sha2("content", 256).alias("sha256"), "content")
    read = readers.read_all(docs, synth.settings(), readers.builtin_readers(synth.settings()))
    return read.select("file_name", "ext", "source_format", "read_status", "read_message")


def _attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments of one PDF per order: a text file, a foreign XML file, the invoice, and sometimes a second copy of it."""
    k = F.col("doc_id")
    xml = _mixed_xml(_prepared(spark, sf_dir)).select("doc_id", F.col("xml").alias("xml"))
    forbidden = F.concat(F.lit("<!DOCTYPE x [<!ENTITY e 'x'>]>\n"), F.regexp_replace("xml", r"^<\?xml[^>]*>\s*", ""))
    rows = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("notiz.txt").alias("name"), F.col("xml").alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("bestellung.xml").alias("name"), F.lit("<Order><Id>1</Id></Order>").alias("text")),
        F.struct(F.lit(3).alias("seq"), F.when(k % 2 == 0, F.lit("Factur-X.xml")).otherwise(F.concat(F.lit("rechnungen/re_"), k, F.lit(".XML"))).alias("name"),
                 F.when(k % 5 == 0, forbidden).otherwise(F.col("xml")).alias("text")),
        F.struct(F.lit(4).alias("seq"), F.when(k % 4 < 2, F.lit("xrechnung.xml")).otherwise(F.lit("kopie.xml")).alias("name"),
                 F.when(k % 3 == 0, F.lit("kein XML")).otherwise(F.col("xml")).alias("text")))
    return (xml.select("doc_id", F.explode(rows).alias("a"))
            .select(F.sha2(F.concat(F.lit("pdf|"), k).cast("binary"), 256).alias("sha256"), k.alias("doc_id"), "a.seq", "a.name", F.col("a.text").cast("binary").alias("content")))


def embedded_xml_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attachment of each PDF is read, and what the reader makes of it."""
    read = attachments.parse_embedded(_attachments(spark, sf_dir))
    return plain(read.select("doc_id", "seq", "name", "syntax", "profile", F.col("invoice.invoice_number").alias("invoice_number"),
                             F.col("invoice.gross_total").alias("gross_total")))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers per order; the second one is right where the first misread a line (every 17th order)."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    both = render.prepared(headers, synth.with_right_net(lines), ("right_net",))
    attempts = F.when(F.col("doc_id") % 7 != 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return _as_answers(render.answer_json(synth.as_read(both.withColumn("attempt", F.explode(attempts)))).select("doc_id", "attempt", "json"))


def _as_answers(df: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    first = F.col("attempt") == 1
    none = F.lit(None).cast("string")
    kind = F.when(first & (k % 37 == 0), "http").when(first & (k % 37 == 1), "network").when(first & (k % 37 == 2), "no_key")
    text = (F.when(k % 47 == 0, F.lit("null")).when(k % 47 == 1, F.lit('{"is_invoice": tr'))
            .when(k % 53 == 1, F.replace("json", F.lit('"is_invoice":true'), F.lit('"is_invoice":false')))
            .when(k % 59 == 0, F.regexp_replace("json", r'"invoice_date":"[^"]*"', '"invoice_date":"31.12.2005"'))
            .when(k % 61 == 0, F.regexp_replace("json", r'"due_date":"[^"]*"', '"due_date":"2005-02-30"')).otherwise(F.col("json")))
    return df.select(
        "doc_id", F.sha2(F.concat(F.lit("pdf|"), k).cast("binary"), 256).alias("sha256"), "attempt", kind.alias("error_kind"),
        F.when(kind == "http", F.lit(" Anfrage abgelehnt \r\nDetails")).when(kind == "network", F.lit("Zeitüberschreitung")).alias("error"),
        F.when(kind == "http", F.when(k % 2 == 0, 400).otherwise(500)).when(kind.isNull(), 200).alias("http_status"),
        F.when(k % 43 == 0, "length").otherwise("stop").alias("finish_reason"), F.when(k % 41 == 0, "Nicht lesbar").otherwise(none).alias("refusal"),
        F.lit("modell-1").alias("model"), (F.lit(2500) + k % 1000).alias("total_tokens"), F.when(kind.isNull(), text).alias("json"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first answer classified and mapped."""
    headers, lines = synth.invoice_view(spark, sf_dir)
    first = render.answer_json(render.prepared(headers, lines)).select("doc_id", F.lit(1).alias("attempt"), "json")
    df = _as_answers(first)
    read = answers.read_answers(df.withColumn("sha256", F.col("doc_id").cast("string")))
    return plain(read.select(F.col("sha256").cast("bigint").alias("doc_id"), "read_status", "read_message", "source_format", "description",
                             F.col("invoice.invoice_number").alias("invoice_number"), F.col("invoice.currency").alias("currency"),
                             F.col("invoice.due_date").alias("due_date"), F.col("invoice.gross_total").alias("gross_total"),
                             F.size("invoice.lines").alias("line_count")))


def second_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt 2 replaces a first answer that fails the validation."""
    df = _answers(spark, sf_dir).withColumn("sha256", F.col("doc_id").cast("string"))
    out = answers.resolve_attempts(df, synth.settings())
    return out.select(F.col("sha256").cast("bigint").alias("doc_id"), "read_status", "read_message", "second_read", F.size("errors").alias("error_count"), "description")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries as XML documents named by arrival."""
    df = render.delivered(_prepared(spark, sf_dir))
    xml = _mixed_xml(df)
    name = F.concat(F.lit("inv_"), F.col("copy"), F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".xml"))
    return xml.select("copy", name.alias("path"), name.alias("file_name"), F.lit(".xml").alias("ext"), F.sha2(F.col("xml").cast("binary"), 256).alias("sha256"),
                      F.col("xml").cast("binary").alias("content"), (F.col("copy").cast("bigint") * synth.COPY_STRIDE + F.col("doc_id")).alias("arrival_seq"))


def check_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read and validate every rendered invoice without storing it."""
    docs = _mixed_xml(_prepared(spark, sf_dir)).select(
        "doc_id", F.concat(F.lit("inv_"), F.col("doc_id"), F.lit(".xml")).alias("file_name"), F.lit(".xml").alias("ext"), F.lit("").alias("sha256"),
        F.col("xml").cast("binary").alias("content"))
    out = importing.check_run(docs.withColumn("path", F.col("doc_id").cast("string")), synth.settings())
    return out.select(F.col("path").cast("bigint").alias("doc_id"), "result", "error_count", F.array_join(F.array_sort("errors"), "\n").alias("errors"))


def xml_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 from XML documents: parse, validate, deduplicate all deliveries."""
    batch = importing.import_batch(_documents(spark, sf_dir).drop("copy"), synth.settings(), at=RUN_TIME)
    return batch.outcomes.select("arrival_seq", "status", "invoice_id", "source_format", "message")


def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries packed into an inbox folder, imported by the stream in two runs; returns the log."""
    root = scratch_path(spark, "stream")
    store = Store(spark, f"{root}/store").create()
    docs = _documents(spark, sf_dir).drop("arrival_seq")
    for run in (0, 1):  # each run renders its own deliveries, straight into the inbox
        docs.where(F.col("copy") == run).drop("copy").write.mode("append").option("compression", "zstd").parquet(f"{root}/inbox")
        inbox.start_import(inbox.watch_packed(spark, f"{root}/inbox"), store, synth.settings(), f"{root}/checkpoint", at=RUN_TIME).awaitTermination()
    errors = F.array_join(F.array_sort(F.split("errors", "\n")), "\n")
    return store.table("processing_log").select("file_name", "status", "source_format", errors.alias("errors"))


def store_two_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch and two streams, each with batch number 0, fill one store; its log, and the stored rows and lines of each logged invoice."""
    root = scratch_path(spark, "writers")
    store = Store(spark, f"{root}/store").create()
    packed = staged(_documents(spark, sf_dir), "packed", "zstd")
    half = packed.agg(F.expr("(min(arrival_seq) filter (where copy = 1) + max(arrival_seq)) div 2")).first()[0]
    columns = [c for c in packed.columns if c not in ("copy", "arrival_seq")]
    importing.import_into(store, 0, packed.where("copy = 0").select(*columns), synth.settings(), at=RUN_TIME)
    for name, part in (("low", F.col("arrival_seq") <= half), ("high", F.col("arrival_seq") > half)):
        packed.where((F.col("copy") == 1) & part).select(*columns).write.parquet(f"{root}/{name}")
        inbox.start_import(inbox.watch_packed(spark, f"{root}/{name}"), store, synth.settings(), f"{root}/checkpoint-{name}", at=RUN_TIME).awaitTermination()
    stored = store.table("invoices").groupBy(F.col("id").alias("invoice_id")).agg(F.count(F.lit(1)).alias("stored"))
    lines = store.table("invoice_lines").groupBy("invoice_id").agg(F.count_distinct("id").alias("line_ids"), F.count(F.lit(1)).alias("lines"))
    log = store.table("processing_log").join(stored, "invoice_id", "left").join(lines, "invoice_id", "left")
    return log.select("file_name", "status", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce(F.col("line_ids") == F.col("lines"), F.lit(False)).alias("has_lines"))


def incremental_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries in two batches, second ones as a third that looks up the stored index (a level is merged on the way).

    Returns the third batch: status, whether the contents were read, and whether the invoice it repeats was stored before."""
    root = scratch_path(spark, "incremental")
    store = Store(spark, f"{root}/store", index_fan=2).create()
    packed = staged(_documents(spark, sf_dir), "packed", "zstd")
    columns = [c for c in packed.columns if c not in ("copy", "arrival_seq")]
    half = packed.where("copy = 0").agg(F.expr("(min(arrival_seq) + max(arrival_seq)) div 2")).first()[0]
    for number, part in enumerate((F.col("arrival_seq") <= half, F.col("arrival_seq") > half)):
        importing.import_into(store, number, packed.where((F.col("copy") == 0) & part).select(*columns), synth.settings(), at=RUN_TIME)
    before = store.snapshot().next_seq
    batch = importing.import_into(store, 2, packed.where("copy = 1").select(*columns), synth.settings(), at=RUN_TIME)
    read = batch.read.select("doc", F.lit(True).alias("was_read"))
    return batch.outcomes.drop("was_read").join(read, "doc", "left").select(
        "file_name", "status", F.coalesce("was_read", F.lit(False)).alias("was_read"), F.coalesce(F.col("invoice_id") < before, F.lit(False)).alias("repeats_stored"))


def stored_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a batch - invoices, and the text documents, which no reader takes - by disposition, with the hash of the bytes kept."""
    root = scratch_path(spark, "originals")
    store = Store(spark, f"{root}/store").create()
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(name.alias("path"), name.alias("file_name"), F.lit(".txt").alias("ext"), F.sha2(content, 256).alias("sha256"), content.alias("content"))
    invoices = _documents(spark, sf_dir).select(*texts.columns)
    importing.import_into(store, 0, texts.unionByName(invoices), synth.settings(), at=RUN_TIME)
    kept = store.with_content(store.table("dispositions").select("doc", "file_name", "disposition")).withColumn("kept", F.sha2("content", 256)).drop("content")
    named = store.table("originals").select("doc", "sha256", "ext")
    return kept.join(named, "doc").select("file_name", "disposition", (F.col("kept") == F.col("sha256")).alias("intact"), F.when(F.col("ext") == ".txt", F.col("kept")).alias("kept_sha256"))


def store_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text documents as PDFs without an answer, then a second batch with a refusal for half of them; what waits and what is logged."""
    root = scratch_path(spark, "pending")
    store = Store(spark, f"{root}/store").create()
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".pdf"))
    content = F.coalesce("text", F.lit("")).cast("binary")
    pdfs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(name.alias("path"), name.alias("file_name"), F.lit(".pdf").alias("ext"), F.sha2(content, 256).alias("sha256"), content.alias("content"))
    none = F.lit(None).cast("string")
    answers = pdfs.where("sha256 < '8'").select("sha256", F.lit(1).alias("attempt"), none.alias("error_kind"), none.alias("error"), F.lit(200).alias("http_status"), F.lit("stop").alias("finish_reason"),
                                                F.lit("Nicht lesbar").alias("refusal"), F.lit("modell-1").alias("model"), F.lit(2500).alias("total_tokens"), none.alias("json"))
    importing.import_into(store, 0, pdfs, synth.settings(), at=RUN_TIME)
    importing.import_into(store, 1, pdfs.limit(0), synth.settings(), at=RUN_TIME, answers=answers)
    logged = store.table("processing_log").select("file_name", F.col("status").alias("state"), F.col("file_sha256").alias("sha256"))
    return logged.unionByName(store.pending().select("file_name", F.lit("waiting").alias("state"), "sha256"))


QUERIES = {f.__name__: f for f in (
    validation_report, invoice_totals, vat_breakdown, line_arithmetic_errors, header_checks, tax_checks, rejected_invoices,
    supplier_keys, invoice_number_keys, file_hash_duplicates, content_duplicates_lookup, sequential_dedup,
    import_outcomes, run_summary, item_texts, archive_paths, inbox_disposition, error_reports,
    report_invoices, report_lines, report_log, log_view, latest_invoices, latest_log, invoice_lines_of, integrity_audit,
    ubl_round_trip, cii_round_trip, syntax_routing, embedded_xml_choice, model_answers, second_read, check_run, xml_import, stream_import,
    store_two_writers, incremental_import, stored_originals, store_pending,
)}

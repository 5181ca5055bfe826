"""Keys, texts and validation rules on literal invoices."""

from __future__ import annotations

from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from invoicelake.functions import labels, text
from invoicelake.functions.keys import invoice_number_key, supplier_key
from invoicelake.operators import validate
from invoicelake.operators.validate import Rule, Settings
from invoicelake.schemas import HEADER_COLUMNS, LINE_COLUMNS
from samples import AS_OF, frame, invoice, line

SETTINGS = Settings(as_of=AS_OF)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def findings(spark, *invoices, settings=SETTINGS):
    rows = validate.with_findings(frame(spark, *invoices), settings).orderBy("doc_id").collect()
    return [[(f["rule"], f["text"]) for f in r["findings"]] for r in rows]


def test_keys(spark):
    def vat(v, name="X"):
        return value(spark, supplier_key(F.lit(v), F.lit(name)))

    assert vat("DE309457216") == vat("de 309 457 216") == "VAT:DE309457216"
    assert vat(None, "Nordhafen Büroausstattung GmbH") == "NAME:NORDHAFENBÜROAUSSTATTUNGGMBH"
    assert vat("D-1", "Groß & Söhne²") == "NAME:GROßSÖHNE"
    assert value(spark, invoice_number_key(F.lit("BN-2026-00318"))) == value(spark, invoice_number_key(F.lit("bn 2026 00318")))
    assert value(spark, invoice_number_key(F.lit(None).cast("string"))) == ""


def test_texts(spark):
    assert value(spark, text.money(F.lit(D("-1234.505")))) == "-1.234,51"
    assert value(spark, text.percent_of(F.lit(D("2.345")), F.lit(D("100")))) == D("2.35")
    assert value(spark, text.extension(F.lit("a.b.PDF"))) == ".pdf"
    assert value(spark, text.extension(F.lit("ohne"))) == ""
    assert value(spark, text.strict_date(F.lit("2026-02-30"))) is None
    assert value(spark, text.trim_all(F.lit("  a b\t\n"))) == "a b"
    assert value(spark, text.first_line(F.lit(" eins \r\nzwei"))) == "eins"
    assert value(spark, labels.duration_text(F.lit(25))) == "25 ms"
    assert value(spark, labels.duration_text(F.lit(12345))) == "12,3 s"
    assert value(spark, labels.address_text(F.lit("Weg 1"), F.lit(None).cast("string"), F.lit("Ort"))) == "Weg 1, Ort"
    assert value(spark, labels.unit_text(F.lit("XCR"))) == "Kiste"
    assert value(spark, labels.unit_text(F.lit("MTR"))) == "MTR"
    assert value(spark, labels.unit_text(F.lit(None).cast("string"))) is None
    assert value(spark, labels.archive_path(F.lit(date(2026, 9, 3)), F.lit("0123456789abcdef"), F.lit("x.xml"))) == "2026/09/0123456789ab_x.xml"


def test_validator_cases(spark):
    cases = [
        invoice(),
        invoice([line(1, "1", "218", "218.00")], net="281.00", tax="53.39", gross="334.39"),
        invoice([line(net="93.00")], net="93.00", tax="17.67", gross="110.67"),
        invoice(gross="60"),
        invoice([line(1, "1", "100", "100"), line(2, "1", "100", "100", rate="7")], net="200", tax="38", gross="238"),
        invoice([line(1, "10", "52.347", "523.47")], net="513.00", tax="97.47", gross="610.47", allowance_total=D("10.47")),
        invoice([line(), line(2, "4", "131", "471.60", discount_percent="10"), line(3, "0", "0", "0", free_quantity="50")]),
        invoice(invoice_number=" ", invoice_date=date(2026, 10, 31)),
        invoice(supplier_name=" ", currency="EURO", invoice_date=date(1999, 12, 31)),
        invoice([], net="0", tax="0", gross="0"),
        invoice([line(description=" "), line(2, "-1", "5", "-5", free_quantity="-1")], net="34.00", tax="6.46", gross="40.46"),
        invoice([line(rate=None)], net="39.00", tax="1", gross="40.00"),
        invoice([line(1, "1", "100", "100"), line(2, "1", "100", "100", rate="7")], net="190", tax="1", gross="191", allowance_total=D(10)),
        invoice([line(1, "1", "100", "100", rate="19.00"), line(2, "1", "100", "100", rate="19")], net="200", tax="38.00", gross="238"),
        invoice([line(1, "1", "100", "95", discount_amount="5", discount_percent="50")], net="95", tax="18.05", gross="113.05"),
        invoice([line(1, "1", "100", "100")], net="100", tax="19.02", gross="119.04"),
        invoice([line(1, "1", "100", "100")], net="90", tax="17.10", gross="107.10", charge_total=D(5)),
    ]
    got = findings(spark, *cases)
    rules = [[r for r, _ in g] for g in got]
    assert rules == [[], ["V10"], ["V9"], ["V11"], ["V12"], [], [], ["V1", "V4"], ["V2", "V3", "V5"], ["V6"], ["V7", "V8"], [], [], [], [], [], ["V10"]]
    assert got[1][0][1] == "Summe der Positionen 218,00 ≠ Nettobetrag 281,00."
    assert got[2][0][1] == "Position 1: Menge × Preis − Rabatt = 39,00, auf der Rechnung steht 93,00."
    assert got[4][0][1] == "USt laut Steuersätzen 26,00 ≠ USt auf der Rechnung 38,00."
    assert got[7][1][1] == "Rechnungsdatum 31.10.2026 liegt in der Zukunft."
    assert got[8][1][1] == 'Ungültige Währung "EURO".'
    assert got[16][0][1] == "Positionen 100,00 − Abschläge 0,00 + Zuschläge 5,00 = 105,00 ≠ Nettobetrag 90,00."


def test_flat_equals_nested(spark):
    cases = [invoice(), invoice(gross="60", invoice_number=""), invoice([line(net="93.00"), line(2, rate="7", description="")]),
             invoice([], net="0", tax="0", gross="0"), invoice([line(rate=None)])]
    df = frame(spark, *cases)
    headers = df.select("doc_id", *[F.col(f"invoice.{c}").alias(c) for c in HEADER_COLUMNS])
    lines = df.select("doc_id", F.explode("invoice.lines").alias("l")).select("doc_id", *[F.col(f"l.{c}").alias(c) for c in LINE_COLUMNS])
    flat = validate.flat_errors(headers, lines, SETTINGS).collect()
    by_doc = {i: [] for i in range(len(cases))}
    for r in sorted(flat, key=lambda r: (r["section"], r["line_number"] or 0, int(r["rule"][1:]))):
        by_doc[r["doc_id"]].append((r["rule"], r["text"]))
    nested = findings(spark, *cases)
    assert [by_doc[i] for i in range(len(cases))] == nested
    counts = {r["doc_id"]: r["error_count"] for r in validate.flat_error_counts(headers, lines, SETTINGS).collect()}
    assert [counts[i] for i in range(len(cases))] == [len(n) for n in nested]


def test_extra_rule(spark):
    rule = Rule("X1", lambda g, s: g("order_reference").isNull(), lambda g, s: F.lit("Bestellung fehlt."))
    settings = Settings(as_of=AS_OF, extra_header_rules=[rule])
    assert findings(spark, invoice(order_reference=None), settings=settings) == [[("X1", "Bestellung fehlt.")]]

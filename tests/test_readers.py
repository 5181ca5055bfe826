"""Reading XML, attachments and answers."""

from __future__ import annotations

import json
from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from invoicelake.operators.validate import Settings
from invoicelake.sources import answers, attachments, einvoice, readers
from samples import AS_OF, FIRST_EDITION, cii, ubl

SETTINGS = Settings(as_of=AS_OF)


def docs(spark, **files):
    rows = [(n, n.replace("__", "."), c if isinstance(c, bytes) else c.encode()) for n, c in files.items()]
    df = spark.createDataFrame([(n, f, bytearray(c)) for n, f, c in rows], "path string, file_name string, content binary")
    return df.withColumn("ext", F.lower(F.regexp_extract("file_name", r"(\.[^.]+)$", 1))).withColumn("sha256", F.sha2("content", 256))


def read(spark, **files):
    out = readers.read_all(docs(spark, **files), SETTINGS, readers.builtin_readers(SETTINGS))
    return {r["path"]: r for r in out.collect()}


def test_syntaxes(spark):
    got = read(spark, u__xml=ubl(), c__XML=cii(), n__xml=ubl(root="ubl:CreditNote", line_tag="CreditNoteLine", quantity_tag="CreditedQuantity"), f__xml=FIRST_EDITION)
    assert {k: (r["read_status"], r["source_format"]) for k, r in got.items()} == {
        "u__xml": ("ok", "XRechnung UBL"), "c__XML": ("ok", "E-Rechnung CII"), "n__xml": ("ok", "XRechnung UBL"), "f__xml": ("ok", "E-Rechnung CII")}
    u = got["u__xml"]["invoice"]
    assert (u["invoice_number"], u["supplier_name"], u["supplier_vat_id"], u["supplier_city"]) == ("RE-1", "Papierhof & Söhne", "DE309457216", "Bremen")
    assert (u["invoice_date"], u["due_date"], u["gross_total"], u["allowance_total"]) == (date(2026, 9, 17), date(2026, 10, 17), D("730.07"), D(0))
    item = u["lines"][0]
    assert (item["unit_price"], item["unit"], item["net_amount"], item["vat_rate"]) == (D("61.35"), "Pack", D("613.50"), D(19))
    assert got["n__xml"]["invoice"]["lines"] == u["lines"]
    assert got["c__XML"]["invoice"]["supplier_vat_id"] == "DE 309 457 216"
    assert got["f__xml"]["invoice"]["gross_total"] == D("119.00") and got["f__xml"]["invoice"]["lines"][0]["quantity"] == D(10)
    assert all(r["errors"] == [] for k, r in got.items())
    assert got["u__xml"]["description"] == "XRechnung (UBL-XML) – strukturiert ausgelesen, ohne KI"


def test_encodings(spark):
    text = ubl()
    latin = text.replace('encoding="utf-8"', "encoding='ISO-8859-1'").encode("latin-1")
    utf16 = text.replace('encoding="utf-8"', 'encoding="UTF-16"')
    got = read(spark, latin__xml=latin, bom__xml=b"\xef\xbb\xbf" + text.encode(), le__xml=b"\xff\xfe" + utf16.encode("utf-16-le"),
               be__xml=b"\xfe\xff" + utf16.encode("utf-16-be"), odd__xml=b"\xff\xfe" + utf16.encode("utf-16-le") + b"x",
               surrogate__xml=b"\xfe\xff\xd8\x00\x00A" + utf16.encode("utf-16-be"), bad__xml=text.encode().replace("ö".encode(), b"\xff"),
               nodecl__xml=text.split("\n", 1)[1])
    names = {k: r["invoice"] and r["invoice"]["supplier_name"] for k, r in got.items()}
    good = "Papierhof & Söhne"
    assert names == {"latin__xml": good, "bom__xml": good, "le__xml": good, "be__xml": good, "odd__xml": None, "surrogate__xml": None, "bad__xml": None, "nodecl__xml": good}


def test_rejected(spark):
    got = read(spark, order__xml="<Order><Id>1</Id></Order>", dtd__xml=ubl(head="<!DOCTYPE x [<!ENTITY e 'x'>]>\n"), junk__xml="kein XML", empty__xml="",
               broken__xml=ubl()[:-20], number__xml=ubl(gross="viel"), nodate__xml=ubl().replace("<cbc:IssueDate>2026-09-17</cbc:IssueDate>", ""),
               prefix__xml=ubl().replace(' xmlns:ubl="urn:ubl"', ""), late__xml="\n" + ubl(), notiz__txt="Hallo")
    assert {r["read_status"] for r in got.values()} == {"failed"}
    none = "Auslesen fehlgeschlagen: " + einvoice.NO_EINVOICE
    messages = {k: r["read_message"] for k, r in got.items()}
    assert {k for k, m in messages.items() if m == none} == {"order__xml", "dtd__xml", "junk__xml", "empty__xml", "prefix__xml", "late__xml"}
    assert messages["broken__xml"] == messages["number__xml"] == "Auslesen fehlgeschlagen: " + einvoice.BROKEN
    assert messages["nodate__xml"] == "Auslesen fehlgeschlagen: " + einvoice.NO_DATE
    assert messages["notiz__txt"] == 'Dateiformat ".txt" wird nicht unterstützt (PDF oder XML).'


def test_numbers_out_of_range(spark):
    """A number no stored table can hold is the fault of its document; the others go on."""
    base = ubl()
    total = '<cbc:LineExtensionAmount currencyID="EUR">613.50</cbc:LineExtensionAmount>'
    many = base.replace(">10</cbc:InvoicedQuantity>", ">1000000000</cbc:InvoicedQuantity>").replace(">6135</cbc:PriceAmount>", ">10000000000</cbc:PriceAmount>")
    per_six = (base.replace(">10</cbc:InvoicedQuantity>", ">10000000</cbc:InvoicedQuantity>").replace(">6135</cbc:PriceAmount>", ">1</cbc:PriceAmount>")
               .replace(">100</cbc:BaseQuantity>", ">6</cbc:BaseQuantity>").replace("613.50", "1666666.67").replace("116.57", "316666.67").replace("730.07", "1983333.34"))
    got = read(spark, good__xml=base, many__xml=many, open__xml=many.replace(total, ""), rate__xml=base.replace(">19<", ">1900<"), six__xml=per_six,
               date__xml=base.replace("2026-09-17", "2026-09-17kaputt"), zone__xml=base.replace("2026-09-17", "2026-09-17+02:00"),
               zeros__xml=base.replace("<cbc:ID>1</cbc:ID>", "<cbc:ID>000000000007</cbc:ID>"))
    failed = {k: r["read_message"].removeprefix("Auslesen fehlgeschlagen: ") for k, r in got.items() if r["read_status"] == "failed"}
    assert failed == {"many__xml": einvoice.OUT_OF_RANGE, "open__xml": einvoice.OUT_OF_RANGE, "rate__xml": einvoice.OUT_OF_RANGE, "date__xml": einvoice.NO_DATE}
    assert got["six__xml"]["errors"] == [] and got["good__xml"]["errors"] == []
    assert got["zone__xml"]["invoice"]["invoice_date"] == date(2026, 9, 17) and got["zeros__xml"]["invoice"]["lines"][0]["line_number"] == 7


def test_unusual_prologs(spark):
    """Long comments, processing instructions, quoted angle brackets; the whole prolog counts."""
    got = read(spark, comment__xml=ubl(head="<!--" + "lang > " * 300_000 + "-->\n" + "<!-- x --><?a b?>\n" * 200),
               quoted__xml=ubl().replace('xmlns:ubl="urn:ubl"', """note="a>b" more='c>"d' xmlns:ubl = "urn:ubl" """),
               bare__xml=ubl(root="Invoice").replace("<Invoice ", "<Invoice\n\t"), other__xml="<!-- <Invoice/> --><Rechnung><Invoice/></Rechnung>", closed__xml="<Invoice/>")
    assert {k: r["read_status"] for k, r in got.items()} == {"comment__xml": "ok", "quoted__xml": "ok", "bare__xml": "ok", "other__xml": "failed", "closed__xml": "failed"}
    assert got["closed__xml"]["read_message"].endswith(einvoice.NO_DATE)


def answer(number="RE-1", tax="7.41", **more):
    line = dict(line_number=1, article_number=None, description=" Papier ", quantity=10, free_quantity=0, unit="Pack", unit_price=3.90,
                discount_percent=None, discount_amount=None, net_amount=39.00, vat_rate=19)
    doc = dict(is_invoice=True, supplier=dict(name=" Büro ", vat_id=None, street=None, postal_code=None, city=None), invoice_number=number, invoice_date="2026-09-17",
               due_date="2026-02-31", currency=" eur", order_reference=None, allowance_total=None, charge_total=None, net_total=39.00, tax_total=float(tax),
               gross_total=round(39.00 + float(tax), 2), lines=[line])
    return json.dumps(doc | more)


SCHEMA = "sha256 string, attempt int, error_kind string, error string, http_status int, finish_reason string, refusal string, model string, total_tokens int, json string"


def row(sha, attempt, text, **more):
    values = dict(error_kind=None, error=None, http_status=200, finish_reason="stop", refusal=None, model="m", total_tokens=2800) | more
    return (sha, attempt, *[values[k] for k in ("error_kind", "error", "http_status", "finish_reason", "refusal", "model", "total_tokens")], text)


def test_answers_and_second_read(spark):
    wrong, right = answer(tax="6.41"), answer()
    rows = [row("once", 1, right), row("once", 1, right), row("fixed", 1, wrong), row("fixed", 2, right), row("twice", 1, wrong), row("twice", 2, wrong), row("waits", 1, wrong),
            row("unread", 1, wrong), row("unread", 2, None, error_kind="http", http_status=422, error="zu groß"), row("later", 1, wrong),
            row("later", 2, None, error_kind="network", error="weg"), row("spare", 1, right), row("spare", 2, wrong), row("nojson", 1, '{"a":'), row("null", 1, "null"),
            row("part", 1, answer(lines=None)), row("date", 1, answer(invoice_date="17.09.2026")), row("long", 1, right, finish_reason="length")]
    got = {r["sha256"]: r for r in answers.resolve_attempts(spark.createDataFrame(rows, SCHEMA), SETTINGS).collect()}
    state = {k: (r["read_status"], len(r["errors"]), r["second_read"]) for k, r in got.items()}
    assert state == {"once": ("ok", 0, False), "fixed": ("ok", 0, True), "twice": ("ok", 1, True), "waits": ("retry", 0, False), "unread": ("failed", 0, False),
                     "later": ("retry", 0, False), "spare": ("ok", 0, False), "nojson": ("failed", 0, False), "null": ("failed", 0, False), "part": ("failed", 0, False),
                     "date": ("failed", 0, False), "long": ("failed", 0, False)}
    invoice = got["once"]["invoice"]
    assert (invoice["supplier_name"], invoice["currency"], invoice["due_date"], invoice["lines"][0]["description"]) == ("Büro", "EUR", None, "Papier")
    assert got["once"]["description"] == "PDF ohne E-Rechnungsdaten → ausgelesen mit OpenAI (m, 2.800 Tokens)"
    assert got["fixed"]["description"].endswith(" · zweimal gelesen")
    assert got["unread"]["read_message"] == "Auslesen fehlgeschlagen: OpenAI hat die Datei abgelehnt (422): zu groß"


def test_embedded(spark):
    rows = [("p1", 1, "a.txt", ubl()), ("p1", 2, "b.xml", ubl("B")), ("p1", 3, "ZUGFeRD-invoice.xml", cii("Z")), ("p1", 4, "xrechnung.xml", ubl("X")),
            ("p2", 1, "factur-x.xml", "<Order/>"), ("p2", 2, "dir/second.XML", ubl("S")), ("p3", 1, "x.xml", "<Order/>"), ("p2", 2, "dir/second.XML", ubl("S"))]
    df = spark.createDataFrame([(s, i, n, bytearray(c.encode())) for s, i, n, c in rows], "sha256 string, seq int, name string, content binary")
    rows = attachments.read_embedded(df).collect()
    got = {r["sha256"]: r for r in rows}
    assert len(rows) == 2
    assert {k: r["invoice"]["invoice_number"] for k, r in got.items()} == {"p1": "Z", "p2": "S"}
    assert got["p2"]["description"] == "ZUGFeRD / Factur-X (PDF mit eingebetteter second.XML, Profil XRechnung) – strukturiert ausgelesen, ohne KI"
    assert got["p1"]["source_format"] == "ZUGFeRD PDF"


def test_pdf_routing(spark):
    pdfs = docs(spark, e__pdf=b"PDF1", m__pdf=b"PDF2", x__pdf=b"PDF3", copy__PDF=b"PDF1")
    sha = {r["path"]: r["sha256"] for r in pdfs.collect()}
    embedded = spark.createDataFrame([(sha["e__pdf"], 1, "factur-x.xml", bytearray(ubl("E").encode()))], "sha256 string, seq int, name string, content binary")
    model = spark.createDataFrame([row(sha["e__pdf"], 1, answer("M")), row(sha["m__pdf"], 1, answer("M"))], SCHEMA)
    out = readers.read_all(pdfs, SETTINGS, readers.builtin_readers(SETTINGS, embedded, model)).collect()
    got = {r["path"]: (r["read_status"], r["source_format"], r["invoice"] and r["invoice"]["invoice_number"]) for r in out}
    assert got == {"e__pdf": ("ok", "ZUGFeRD PDF", "E"), "copy__PDF": ("ok", "ZUGFeRD PDF", "E"), "m__pdf": ("ok", "PDF via OpenAI", "M"), "x__pdf": ("retry", None, None)}


def test_own_reader_comes_first(spark):
    def take(df):
        keep = [c for c in df.columns if c != "content"]
        return readers.unread(df.select(*keep), "failed", F.lit("eigener Reader"))

    own = readers.Reader("csv", lambda: F.col("ext") == ".csv", take)
    out = readers.read_all(docs(spark, a__csv="x", b__xml=ubl()), SETTINGS, [own, *readers.builtin_readers(SETTINGS)]).collect()
    assert {r["path"]: r["read_message"] for r in out} == {"a__csv": "eigener Reader", "b__xml": None}


def test_lines_are_mapped_once(spark):
    """The totals mention the lines; the plan must not map them again for each mention."""
    plan = einvoice.parse_xml(docs(spark, u__xml=ubl())).select("invoice")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("struct(line_number") == 1


def test_long_prolog(spark):
    """The root tag far behind the first characters, and parts of the prolog that are cut there."""
    text = ubl()
    for filler in ("<!--" + "x" * 5000 + "-->", " " * 5000, "<?p " + "y" * 995 + "?>", "<!--" + "<Order>" * 200 + "-->", "<!-- a -->" * 99):
        for n in range(0, 60, 7):
            long = text.replace("?>\n", "?>" + " " * n + filler, 1)
            assert spark.range(1).select(einvoice.detect_syntax(F.lit(long)).alias("s")).first()["s"] == "UBL"


def test_only_repeated_answers_are_shuffled(spark):
    """Equal keys, null ones too, give the smallest row; without equal keys the texts stay where they are."""
    rows = [("a", 1, "x"), ("a", 1, "w"), ("a", 2, "z"), (None, 1, "q"), (None, 1, "p"), ("b", 1, None)]
    df = spark.createDataFrame(rows, "sha256 string, attempt int, json string")
    assert sorted(map(str, answers.one_per_attempt(df).collect())) == sorted(map(str, df.groupBy("sha256", "attempt").agg(F.min("json").alias("json")).collect()))
    alone = answers.one_per_attempt(df.where("sha256 = 'b' or attempt = 2"))
    assert sorted(r["json"] or "" for r in alone.collect()) == ["", "z"]
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()

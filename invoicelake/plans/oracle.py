"""The checks: every registered query as plain SQL over the same tables, written independently of the jobs."""

from __future__ import annotations


def dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n.split('.')[-1]}" for n in names)


def money(x: str) -> str:
    return f"translate(format('{{:,.2f}}', CAST(round({x}, 2) AS DOUBLE)), ',.', '.,')"


def pct(amount: str, rate: str) -> str:
    return f"CAST(round(CAST({amount} AS DECIMAL(28,8)) * CAST({rate} AS DECIMAL(9,4)), 0) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(28,2))"


def key(x: str) -> str:
    return (f"replace(upper(replace(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), 'ß', chr(1))), chr(1), 'ß')")


def supplier_key(vat: str, name: str) -> str:
    return f"CASE WHEN length({key(vat)}) >= 4 THEN 'VAT:' || {key(vat)} ELSE 'NAME:' || {key(name)} END"


BLANK = "regexp_full_match(coalesce({0}, ''), '\\s*')"


def blank(x: str) -> str:
    return BLANK.format(x)


# cl: lines without faults, pl: lines as printed, ho: document totals, hd: headers as printed
VIEW = f"""
cl AS (
  SELECT *, CAST(line_gross - line_discount AS DECIMAL(20,2)) AS line_net FROM (
    SELECT *, CAST({pct('line_gross', 'discount_percent')} AS DECIMAL(20,2)) AS line_discount FROM (
      SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS line_number, 'P-' || l_partkey AS article_number,
             'Artikel ' || l_partkey AS description, CAST(l_quantity AS DECIMAL(16,4)) AS quantity,
             CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DECIMAL(16,4)) AS free_quantity,
             ['H87','C62','KGM','LTR','XBX','XCS','XCR','XPK','XRO','HUR','MTR'][l_partkey % 11 + 1] AS unit_code,
             CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
             CAST(round(l_discount * 100) AS DECIMAL(9,4)) AS discount_percent,
             CAST(CASE WHEN l_orderkey % 2 = 0 OR l_linenumber % 2 = 1 THEN 19 ELSE 7 END AS DECIMAL(9,4)) AS vat_rate,
             CAST(round(CAST(l_quantity AS DECIMAL(19,4)) * CAST(l_extendedprice AS DECIMAL(19,2)), 2) AS DECIMAL(20,2)) AS line_gross
      FROM lineitem))),
pl AS (
  SELECT doc_id, line_number, article_number,
         CASE WHEN doc_id % 43 = 0 AND line_number = 2 THEN ' ' ELSE description END AS description, quantity,
         CASE WHEN doc_id % 47 = 0 AND line_number = 3 THEN -1 ELSE free_quantity END AS free_quantity,
         CASE unit_code WHEN 'H87' THEN 'Stk' WHEN 'C62' THEN 'Stk' WHEN 'KGM' THEN 'kg' WHEN 'LTR' THEN 'l'
              WHEN 'XBX' THEN 'Karton' WHEN 'XCS' THEN 'Kiste' WHEN 'XCR' THEN 'Kiste' WHEN 'XPK' THEN 'Pack'
              WHEN 'XRO' THEN 'Rolle' WHEN 'HUR' THEN 'Std' ELSE unit_code END AS unit,
         unit_code, unit_price, discount_percent,
         CASE WHEN doc_id % 3 = 0 THEN line_discount END AS discount_amount,
         line_net + CASE WHEN doc_id % 17 = 0 AND line_number = 1 THEN 1 ELSE 0 END AS net_amount,
         CASE WHEN doc_id % 11 = 0 AND line_number = 1 THEN NULL ELSE vat_rate END AS vat_rate
  FROM cl),
rg AS (
  SELECT doc_id, vat_rate, sum(line_net) AS net, count(*) AS lines, min(line_number) AS first_line,
         bool_or(line_discount <> 0) AS has_discount, bool_or(free_quantity <> 0) AS has_free_goods
  FROM cl GROUP BY ALL),
dt AS (
  SELECT doc_id, sum(net) AS line_total, sum(lines) AS line_count, count(*) AS rate_count,
         sum({pct('net', 'vat_rate')}) AS rate_tax, max(vat_rate) AS top_rate, arg_min(vat_rate, first_line) AS first_rate,
         bool_or(has_discount) AS has_discount, bool_or(has_free_goods) AS has_free_goods
  FROM rg GROUP BY doc_id),
ob AS (
  SELECT o_orderkey AS doc_id, o_custkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 MONTH AS DATE) AS base_date,
         coalesce(line_total, 0) AS line_total, coalesce(rate_tax, 0) AS rate_tax, coalesce(rate_count, 0) AS rate_count,
         coalesce(line_count, 0) AS line_count, coalesce(has_discount, false) AS has_discount,
         coalesce(has_free_goods, false) AS has_free_goods, top_rate, first_rate
  FROM orders LEFT JOIN dt ON doc_id = o_orderkey),
oc AS (
  SELECT *, line_total - allowance AS net,
         CASE WHEN allowance <> 0 THEN {pct('line_total - allowance', 'top_rate')} ELSE rate_tax END AS tax
  FROM (SELECT *, CASE WHEN doc_id % 26 = 0 THEN {pct('line_total', '2')} ELSE 0 END AS allowance FROM ob)),
hd AS (
  SELECT doc_id, CASE WHEN doc_id % 41 = 0 THEN ' ' ELSE s_name END AS supplier_name,
         'DE' || (811000000 + s_suppkey) AS supplier_vat_id, 'Werkstraße ' || (s_suppkey + 1) AS supplier_street,
         CAST(80000 + s_nationkey AS VARCHAR) AS supplier_postal_code, 'Ort ' || s_nationkey AS supplier_city,
         CASE WHEN doc_id % 23 = 0 THEN ' ' ELSE 'RE-' || year(base_date) || '-' || printf('%05d', doc_id // 8) END AS invoice_number,
         CASE WHEN doc_id % 37 = 0 THEN CAST(base_date - INTERVAL 84 MONTH AS DATE) ELSE base_date END AS invoice_date,
         CAST(base_date + INTERVAL 30 DAY AS DATE) AS due_date,
         CASE WHEN doc_id % 29 = 0 THEN 'EURO' ELSE 'EUR' END AS currency, 'EK-' || o_custkey AS order_reference,
         allowance AS allowance_total, CASE WHEN doc_id % 53 = 0 THEN 5 ELSE 0 END AS charge_total,
         net + CASE WHEN doc_id % 53 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 19 = 0 THEN 9 ELSE 0 END AS net_total,
         tax + CASE WHEN doc_id % 31 = 0 THEN 0.50 ELSE 0 END AS tax_total,
         net + tax + CASE WHEN doc_id % 53 = 0 THEN 5 ELSE 0 END + CASE WHEN doc_id % 31 = 0 THEN 0.50 ELSE 0 END AS gross_total
  FROM oc JOIN supplier ON s_suppkey = (doc_id // 4) % (SELECT max(s_suppkey) + 1 FROM supplier))
"""

# pt: per-document sums of the printed lines; er: all errors as rows
def errors(lines: str, headers: str) -> str:
    return f""",
le AS (
  SELECT *, round(CAST(quantity AS DECIMAL(19,4)) * CAST(unit_price AS DECIMAL(19,2))
                  - coalesce(discount_amount, {pct('quantity * unit_price', 'discount_percent')}, 0), 2) AS expected
  FROM {lines}),
pg AS (SELECT doc_id, vat_rate, sum(net_amount) AS net, count(*) AS lines FROM {lines} GROUP BY ALL),
pt AS (
  SELECT h.*, coalesce(line_count, 0) AS line_count, coalesce(line_sum, 0) AS line_sum, coalesce(rate_count, 0) AS rate_count,
         top_rate, coalesce(has_open_rate, false) AS has_open_rate, rate_tax,
         coalesce(line_sum, 0) - allowance_total + charge_total AS expected_net
  FROM {headers} h LEFT JOIN (
    SELECT doc_id, sum(lines) AS line_count, sum(net) AS line_sum, count(vat_rate) AS rate_count, max(vat_rate) AS top_rate,
           bool_or(vat_rate IS NULL) AS has_open_rate, sum({pct('net', 'vat_rate')}) AS rate_tax
    FROM pg GROUP BY doc_id) t USING (doc_id)),
px AS (
  SELECT *, CASE WHEN line_count = 0 OR has_open_rate THEN NULL WHEN rate_count = 1 THEN {pct('net_total', 'top_rate')}
                 WHEN allowance_total = 0 AND charge_total = 0 THEN rate_tax END AS expected_tax
  FROM pt),
er AS (
  SELECT doc_id, 1 AS section, NULL AS line_number, 'V1' AS rule, 'Rechnungsnummer fehlt.' AS text FROM px WHERE {blank('invoice_number')}
  UNION ALL SELECT doc_id, 1, NULL, 'V2', 'Lieferant fehlt.' FROM px WHERE {blank('supplier_name')}
  UNION ALL SELECT doc_id, 1, NULL, 'V3', 'Ungültige Währung "' || currency || '".' FROM px WHERE length(currency) <> 3
  UNION ALL SELECT doc_id, 1, NULL, 'V4', 'Rechnungsdatum ' || strftime(invoice_date, '%d.%m.%Y') || ' liegt in der Zukunft.' FROM px WHERE invoice_date > DATE '2006-01-02'
  UNION ALL SELECT doc_id, 1, NULL, 'V5', 'Rechnungsdatum ' || strftime(invoice_date, '%d.%m.%Y') || ' ist nicht plausibel.' FROM px WHERE year(invoice_date) < 2000
  UNION ALL SELECT doc_id, 1, NULL, 'V6', 'Keine Rechnungspositionen gefunden.' FROM px WHERE line_count = 0
  UNION ALL SELECT doc_id, 2, line_number, 'V7', 'Position ' || line_number || ': Bezeichnung fehlt.' FROM le WHERE {blank('description')}
  UNION ALL SELECT doc_id, 2, line_number, 'V8', 'Position ' || line_number || ': negative Menge.' FROM le WHERE quantity < 0 OR free_quantity < 0
  UNION ALL SELECT doc_id, 2, line_number, 'V9', 'Position ' || line_number || ': Menge × Preis − Rabatt = ' || {money('expected')} || ', auf der Rechnung steht ' || {money('net_amount')} || '.'
            FROM le WHERE abs(expected - net_amount) > 0.02
  UNION ALL SELECT doc_id, 3, NULL, 'V10', CASE WHEN allowance_total = 0 AND charge_total = 0
              THEN 'Summe der Positionen ' || {money('line_sum')} || ' ≠ Nettobetrag ' || {money('net_total')} || '.'
              ELSE 'Positionen ' || {money('line_sum')} || ' − Abschläge ' || {money('allowance_total')} || ' + Zuschläge ' || {money('charge_total')}
                   || ' = ' || {money('expected_net')} || ' ≠ Nettobetrag ' || {money('net_total')} || '.' END
            FROM px WHERE line_count > 0 AND abs(expected_net - net_total) > 0.02
  UNION ALL SELECT doc_id, 3, NULL, 'V11', 'Netto ' || {money('net_total')} || ' + USt ' || {money('tax_total')} || ' ≠ Brutto ' || {money('gross_total')} || '.'
            FROM px WHERE abs(net_total + tax_total - gross_total) > 0.02
  UNION ALL SELECT doc_id, 3, NULL, 'V12', 'USt laut Steuersätzen ' || {money('expected_tax')} || ' ≠ USt auf der Rechnung ' || {money('tax_total')} || '.'
            FROM px WHERE abs(expected_tax - tax_total) > 0.02 * rate_count)
"""

ERRORS = VIEW + errors("pl", "hd")


# dl: deliveries with keys and their own status
def deliveries(headers: str, source_format: str) -> str:
    return f""",
ec AS (SELECT doc_id, count(*) AS error_count FROM er GROUP BY doc_id),
d0 AS (
  SELECT h.* EXCLUDE (supplier_vat_id, invoice_number), c.copy,
         CASE WHEN copy = 1 AND doc_id % 10 = 0 THEN NULL
              WHEN copy = 1 AND doc_id % 10 = 2 THEN lower(supplier_vat_id[1:2]) || ' ' || supplier_vat_id[3:5] || ' ' || supplier_vat_id[6:11]
              ELSE supplier_vat_id END AS supplier_vat_id,
         CASE WHEN copy = 1 AND doc_id % 10 = 2 THEN lower(replace(invoice_number, '-', ' ')) ELSE invoice_number END AS invoice_number,
         copy * 1000000000000 + doc_id AS arrival_seq, 'inv_' || doc_id || '.xml' AS file_name,
         sha256('inv|' || doc_id || '|' || CASE WHEN copy = 1 AND doc_id % 10 <> 1 THEN 1 ELSE 0 END) AS sha256,
         {source_format} AS source_format
  FROM {headers} h JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON copy = 0 OR doc_id % 10 < 3),
dl AS (
  SELECT d.*, coalesce(error_count, 0) AS error_count, {key('invoice_number')} AS number_key,
         {supplier_key('supplier_vat_id', 'supplier_name')} AS supplier_key
  FROM d0 d LEFT JOIN ec USING (doc_id))
"""


DELIVERIES = ERRORS + deliveries("hd", "CASE WHEN doc_id % 2 = 0 THEN 'XRechnung UBL' ELSE 'XRechnung CII' END")


def sequential(source: str, prefix: str = "") -> str:
    """CTEs `{prefix}fold` (one row per candidate: arrival_seq, hit) over `source`
    (arrival_seq, number_key, supplier_key, invoice_date, gross_total): one recursion step per position in a key."""
    return f"""
{prefix}ranked AS (SELECT *, row_number() OVER (PARTITION BY number_key ORDER BY arrival_seq) AS rn FROM {source}),
{prefix}steps AS (
  SELECT number_key, rn, arrival_seq, CAST(NULL AS BIGINT) AS hit,
         [{{'seq': arrival_seq, 's': supplier_key, 'd': invoice_date, 'g': gross_total}}] AS kept
  FROM {prefix}ranked WHERE rn = 1
  UNION ALL
  SELECT number_key, rn, arrival_seq, hit,
         CASE WHEN hit IS NULL THEN list_append(kept, {{'seq': arrival_seq, 's': supplier_key, 'd': invoice_date, 'g': gross_total}}) ELSE kept END
  FROM (
    SELECT r.number_key, r.rn, r.arrival_seq, r.supplier_key, r.invoice_date, r.gross_total, s.kept,
           list_min(list_transform(list_filter(s.kept, lambda k: k.s = r.supplier_key OR (k.d = r.invoice_date AND k.g = r.gross_total)), lambda k: k.seq)) AS hit
    FROM {prefix}steps s JOIN {prefix}ranked r ON r.number_key = s.number_key AND r.rn = s.rn + 1)),
{prefix}fold AS (SELECT arrival_seq, hit FROM {prefix}steps)
"""


# oc_: outcome per delivery
DECIDED = """,
fv AS (SELECT sha256, min(arrival_seq) AS first_seq FROM dl WHERE error_count = 0 GROUP BY sha256),
ca AS (SELECT dl.* FROM dl JOIN fv ON fv.sha256 = dl.sha256 AND fv.first_seq = dl.arrival_seq),
""" + sequential("ca") + """,
ou AS (
  SELECT d.*, first_seq, f.hit, x.invoice_number AS first_number, k.invoice_number AS kept_number, k.supplier_name AS kept_supplier, k.file_name AS kept_file,
         CASE WHEN first_seq IS NOT NULL AND f.hit IS NULL AND d.arrival_seq = first_seq THEN 'imported'
              WHEN first_seq IS NOT NULL AND f.hit IS NULL AND d.arrival_seq > first_seq THEN 'same_file'
              WHEN d.error_count = 0 THEN 'same_invoice' ELSE 'validation_failed' END AS kind
  FROM dl d LEFT JOIN fv USING (sha256) LEFT JOIN fold f ON f.arrival_seq = fv.first_seq
       LEFT JOIN dl x ON x.arrival_seq = fv.first_seq LEFT JOIN dl k ON k.arrival_seq = f.hit),
oo AS (
  SELECT arrival_seq, file_name, sha256, doc_id, supplier_name, invoice_number, gross_total, currency, supplier_street, supplier_postal_code, supplier_city,
         invoice_date, kind,
         CASE kind WHEN 'imported' THEN 'imported' WHEN 'validation_failed' THEN 'validation_failed' ELSE 'duplicate' END AS status,
         CASE kind WHEN 'imported' THEN arrival_seq WHEN 'same_file' THEN first_seq WHEN 'same_invoice' THEN hit END AS invoice_id,
         CASE kind WHEN 'same_file' THEN NULL ELSE source_format END AS source_format,
         CASE kind WHEN 'imported' THEN 'Prüfung bestanden – gespeichert (ID ' || arrival_seq || ').'
              WHEN 'same_file' THEN 'Identische Datei wurde bereits importiert (Rechnung ' || first_number || ', ID ' || first_seq || ').'
              WHEN 'same_invoice' THEN 'Rechnung ' || invoice_number || ' von ' || kept_supplier || ' ist bereits importiert (ID ' || hit || ', aus ' || kept_file || ').'
              ELSE 'Prüfung fehlgeschlagen – nicht gespeichert.' END AS message
  FROM ou)
"""
OUTCOMES = DELIVERIES + DECIDED


def with_ctes(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body}"


STATUS = "CASE event_type WHEN 'purchase' THEN 'imported' WHEN 'click' THEN 'duplicate' WHEN 'view' THEN 'validation_failed' WHEN 'error' THEN 'failed' ELSE 'retry' END"

# lg: stored log, si/sl: stored invoices and lines
LOG = f"""
lg AS (
  SELECT event_id AS id, ts AS processed_at, 'f_' || user_id || '.xml' AS file_name, {STATUS} AS status, 'XRechnung UBL' AS source_format,
         CASE WHEN event_type = 'purchase' THEN event_id END AS invoice_id, 'Meldung ' || event_type AS message,
         CASE WHEN event_type = 'view' THEN 'a' || chr(10) || 'b' END AS errors, CAST(round(value) AS INT) AS duration_ms
  FROM events WHERE event_type <> 'signup')
"""
STORED = VIEW + f""",
si AS (SELECT h.*, doc_id AS id, {key('invoice_number')} AS invoice_number_key, {supplier_key('supplier_vat_id', 'supplier_name')} AS supplier_key,
              sha256('inv|' || doc_id || '|0') AS file_sha256 FROM hd h),
sl AS (SELECT *, doc_id AS invoice_id FROM pl)
"""

_TAKEN = """(SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'duplicates' ELSE 'failed' END AS disposition, 'inv_' || o_orderkey || '.xml' AS file_name, true AS present
   FROM orders WHERE o_orderkey % 7 = 0)"""
MANIFEST = OUTCOMES + f""",
mf AS (
  SELECT o.*, CASE status WHEN 'imported' THEN 'delete' WHEN 'duplicate' THEN 'duplicates' ELSE 'failed' END AS disposition FROM oo o),
mr AS (
  SELECT m.*, coalesce(present, false) AS present,
         row_number() OVER (PARTITION BY m.disposition, m.file_name ORDER BY arrival_seq) AS rn,
         count(*) OVER (PARTITION BY m.disposition, m.file_name) AS n
  FROM mf m LEFT JOIN {_TAKEN} t ON t.disposition = m.disposition AND t.file_name = m.file_name),
mm AS (
  SELECT *, CASE WHEN disposition = 'delete' THEN NULL
                 WHEN rn = 1 AND NOT present THEN file_name
                 WHEN (present AND rn = 1) OR (NOT present AND n = 2) THEN 'inv_' || doc_id || '_20060101-123015.xml'
                 ELSE 'inv_' || doc_id || '_20060101-123015-' || arrival_seq || '.xml' END AS target_name
  FROM mr)
"""

_NOT_NULL = {
    "invoices": ("si", ["id", "supplier_name", "supplier_key", "invoice_number", "invoice_number_key", "invoice_date", "currency",
                        "allowance_total", "charge_total", "net_total", "tax_total", "gross_total", "file_sha256"]),
    "invoice_lines": ("sl", ["invoice_id", "line_number", "description", "quantity", "free_quantity", "unit_price", "net_amount"]),
    "processing_log": ("lg", ["id", "processed_at", "file_name", "status", "message"]),
}
# Columns that are never null by construction of the stored rows.
_CONSTANT = {"invoices": ["source_format", "source_file", "imported_at"], "invoice_lines": ["id"], "processing_log": ["file_sha256"]}


def _audit() -> str:
    parts = [f"SELECT '{t}.not_null.{c}' AS \"check\", count(*) AS violations FROM {cte} WHERE {c} IS NULL"
             for t, (cte, cols) in _NOT_NULL.items() for c in cols]
    parts += [f"SELECT '{t}.not_null.{c}', 0" for t, cols in _CONSTANT.items() for c in cols]
    parts += [
        "SELECT 'processing_log.status', count(*) FROM lg WHERE status NOT IN ('imported','duplicate','validation_failed','failed')",
        "SELECT 'invoice_lines.references', count(*) FROM sl WHERE invoice_id NOT IN (SELECT id FROM si)",
        "SELECT 'processing_log.references', count(*) FROM lg WHERE invoice_id IS NOT NULL AND invoice_id NOT IN (SELECT id FROM si)",
        "SELECT 'invoices.unique.file_sha256', count(*) FROM (SELECT 1 FROM si GROUP BY file_sha256 HAVING count(*) > 1)",
        "SELECT 'invoices.unique.supplier_number', count(*) FROM (SELECT 1 FROM si GROUP BY supplier_key, invoice_number_key HAVING count(*) > 1)",
    ]
    return "\nUNION ALL ".join(parts)


def _rule_list(rules: str) -> str:
    return (f"(SELECT doc_id, string_agg(rule, ',' ORDER BY CAST(rule[2:] AS INT)) AS broken FROM er WHERE rule IN ({rules}) GROUP BY doc_id)")


_LINE_ORDER = ("line_number, article_number, description, quantity, free_quantity, unit, unit_price, discount_percent, discount_amount NULLS FIRST, "
               "net_amount, vat_rate NULLS FIRST, unit_code")


def parsed(ubl: str) -> str:
    """CTEs rl, rh: lines and headers as a reader gets them from the rendered XML; `ubl` tells which documents are UBL."""
    return f""",
rl AS (
  SELECT doc_id, CAST(CASE WHEN doc_id % 8 = 1 THEN rn ELSE line_number END AS INT) AS line_number,
         CASE WHEN doc_id % 14 = 3 THEN 'G-' ELSE '' END || article_number AS article_number, trim(description) AS description, quantity,
         CASE WHEN {ubl} THEN 0 ELSE free_quantity END AS free_quantity, unit, unit_price,
         CASE WHEN d IS NOT NULL AND doc_id % 10 <> 4 THEN discount_percent END AS discount_percent, d AS discount_amount,
         CASE WHEN doc_id % 6 = 5 THEN CAST(round_even(quantity * unit_price - coalesce(d, 0), 2) AS DECIMAL(20,2)) ELSE net_amount END AS net_amount, vat_rate
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_LINE_ORDER}) AS rn,
               nullif(coalesce(discount_amount, {pct('quantity * unit_price', 'discount_percent')}), 0) AS d FROM pl)),
rh AS (
  SELECT * EXCLUDE (r_net) REPLACE (trim(supplier_name) AS supplier_name, trim(invoice_number) AS invoice_number, r_net AS net_total,
                    CASE WHEN doc_id % 7 = 5 THEN r_net + tax_total ELSE gross_total END AS gross_total)
  FROM (
    SELECT h.*, CASE doc_id % 7 WHEN 4 THEN coalesce(printed, 0) - allowance_total + charge_total
                                WHEN 6 THEN coalesce(read, 0) - allowance_total + charge_total ELSE net_total END AS r_net
    FROM hd h LEFT JOIN (SELECT doc_id, sum(net_amount) AS printed FROM pl GROUP BY 1) USING (doc_id)
              LEFT JOIN (SELECT doc_id, sum(net_amount) AS read FROM rl GROUP BY 1) USING (doc_id)))
"""


_XML_FORMAT = ("CASE WHEN doc_id % 4 < 2 THEN 'XRechnung' ELSE 'E-Rechnung' END || CASE WHEN doc_id % 2 = 0 THEN ' UBL' ELSE ' CII' END")
XML_ERRORS = VIEW + parsed("doc_id % 2 = 0") + errors("rl", "rh")
XML_OUTCOMES = XML_ERRORS + deliveries("rh", _XML_FORMAT) + DECIDED

_ROUND_HEADER = "supplier_name, supplier_vat_id, supplier_street, supplier_postal_code, supplier_city, invoice_number, invoice_date, due_date, currency, order_reference"


def _round_trip(syntax: str, ubl: str) -> str:
    return with_ctes(VIEW + parsed(ubl), f"""
SELECT doc_id, '{syntax}' AS syntax, {_ROUND_HEADER}, {dbl('allowance_total', 'charge_total', 'net_total', 'tax_total', 'gross_total')},
       line_number, article_number, description, {dbl('quantity', 'free_quantity')}, unit,
       {dbl('unit_price', 'discount_percent', 'discount_amount', 'net_amount', 'vat_rate')}
FROM rh LEFT JOIN rl USING (doc_id)""")


# an: first answers classified (kind is null for readable ones)
_READ_FAILED = "'Auslesen fehlgeschlagen: ' || "
ANSWERS = VIEW + f""",
an AS (
  SELECT *, CASE
    WHEN first AND doc_id % 37 = 0 AND doc_id % 2 = 0 THEN {_READ_FAILED}'OpenAI hat die Datei abgelehnt (400): Anfrage abgelehnt'
    WHEN first AND doc_id % 37 = 0 THEN 'OpenAI-Fehler (500): Anfrage abgelehnt'
    WHEN first AND doc_id % 37 = 1 THEN 'OpenAI nicht erreichbar: Zeitüberschreitung'
    WHEN first AND doc_id % 37 = 2 THEN 'Für das Modell ist kein Zugang eingerichtet.'
    WHEN doc_id % 41 = 0 THEN {_READ_FAILED}'OpenAI hat die Verarbeitung abgelehnt: Nicht lesbar'
    WHEN doc_id % 43 = 0 THEN {_READ_FAILED}'Antwort von OpenAI wurde abgeschnitten (OpenAI:MaxOutputTokens erhöhen).'
    WHEN doc_id % 47 = 0 THEN {_READ_FAILED}'Leere Antwort von OpenAI.'
    WHEN doc_id % 47 = 1 THEN 'Unerwarteter Fehler: Antwort ist kein gültiges JSON.'
    WHEN doc_id % 53 = 1 THEN {_READ_FAILED}'Das Dokument ist laut OpenAI keine Rechnung.'
    WHEN doc_id % 59 = 0 THEN {_READ_FAILED}'Ungültiges Rechnungsdatum "31.12.2005".' END AS message,
    first AND doc_id % 37 IN (0, 1, 2) AND NOT (doc_id % 37 = 0 AND doc_id % 2 = 0) AS again,
    'PDF ohne E-Rechnungsdaten → ausgelesen mit OpenAI (modell-1, ' || replace(format('{{:,}}', 2500 + doc_id % 1000), ',', '.') || ' Tokens)' AS description
  FROM hd, (SELECT true AS first UNION ALL SELECT false))
"""


def _error_counts(no_misread: bool) -> str:
    """Errors per document, with or without the misread first line."""
    view = VIEW.replace("doc_id % 17 = 0 AND line_number = 1 THEN 1 ELSE 0", "false THEN 1 ELSE 0") if no_misread else VIEW
    trimmed = """, th AS (SELECT * REPLACE (trim(supplier_name) AS supplier_name, trim(invoice_number) AS invoice_number) FROM hd)"""
    return f"({with_ctes(view + trimmed + errors('pl', 'th'), 'SELECT doc_id, CAST(count(*) AS INT) AS n FROM er GROUP BY doc_id')})"


ORACLE: dict[str, str] = {
    "validation_report": with_ctes(ERRORS, "SELECT doc_id, section, line_number, rule, text FROM er"),
    "invoice_totals": with_ctes(VIEW, f"""
SELECT doc_id, {dbl('line_total')}, CAST(line_count AS BIGINT) AS line_count, rate_count, has_discount, has_free_goods, rate_count > 1 AS several_rates,
       {dbl('allowance')}, allowance <> 0 AND rate_count > 1 AS allowance_rejected, {dbl('net', 'tax')}, CAST(net + tax AS DOUBLE) AS gross
FROM (SELECT *, CASE WHEN allowance <> 0 AND rate_count > 1 THEN NULL WHEN forced IS NOT NULL THEN forced ELSE line_total - allowance END AS net,
             CASE WHEN allowance <> 0 AND rate_count > 1 THEN NULL WHEN forced IS NOT NULL THEN coalesce({pct('forced', 'first_rate')}, 0)
                  WHEN allowance <> 0 THEN {pct('line_total - allowance', 'top_rate')} ELSE rate_tax END AS tax
      FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN {pct('line_total', '2')} ELSE 0 END AS allowance,
                   CASE WHEN doc_id % 19 = 0 AND doc_id % 13 <> 0 THEN CAST(1234.56 AS DECIMAL(28,2)) END AS forced FROM ob))"""),
    "vat_breakdown": with_ctes(VIEW, f"SELECT doc_id, {dbl('vat_rate')}, CAST(net AS DOUBLE) AS basis, CAST({pct('net', 'vat_rate')} AS DOUBLE) AS tax, lines FROM rg"),
    "line_arithmetic_errors": with_ctes(ERRORS, "SELECT doc_id, line_number, rule, text FROM er WHERE section = 2"),
    "header_checks": with_ctes(ERRORS, f"""
SELECT doc_id, CAST(line_count AS BIGINT) AS line_count, {dbl('line_sum', 'net_total', 'tax_total', 'gross_total')}, coalesce(broken, '') AS broken
FROM px LEFT JOIN {_rule_list("'V1','V2','V3','V4','V5','V6','V10','V11'")} USING (doc_id)"""),
    "tax_checks": with_ctes(ERRORS, f"""
SELECT doc_id, rate_count, has_open_rate, {dbl('expected_tax', 'tax_total')}, coalesce(abs(expected_tax - tax_total) > 0.02 * rate_count, false) AS broken FROM px"""),
    "rejected_invoices": with_ctes(ERRORS, f"""
SELECT doc_id, invoice_number, supplier_name, {dbl('gross_total')}, CAST(count(*) AS INT) AS error_count
FROM hd JOIN er USING (doc_id) GROUP BY ALL"""),
    "supplier_keys": f"""
SELECT s_suppkey, {supplier_key('vat', 'name')} AS supplier_key, {key('name')} AS name_key
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'de 811.' || s_suppkey WHEN 1 THEN 'D-1' END AS vat, 'Groß & Söhne² ' || s_name AS name FROM supplier)""",
    "invoice_number_keys": with_ctes(DELIVERIES, "SELECT arrival_seq, invoice_number, number_key FROM dl"),
    "file_hash_duplicates": """
SELECT doc_id AS arrival_seq, 'doc_' || doc_id || '.txt' AS file_name, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS first_seq,
       doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_copy FROM documents""",
    "content_duplicates_lookup": with_ctes(DELIVERIES, """
, inc AS (SELECT * FROM dl WHERE copy = 1), sto AS (SELECT * FROM dl WHERE copy = 0),
hit AS (SELECT i.arrival_seq, min(s.arrival_seq) AS duplicate_of
        FROM inc i JOIN sto s ON s.number_key = i.number_key AND (s.supplier_key = i.supplier_key OR (s.invoice_date = i.invoice_date AND s.gross_total = i.gross_total))
        GROUP BY i.arrival_seq)
SELECT i.arrival_seq, duplicate_of, s.invoice_number AS their_number, s.file_name AS their_file
FROM inc i LEFT JOIN hit USING (arrival_seq) LEFT JOIN sto s ON s.arrival_seq = duplicate_of"""),
    "sequential_dedup": with_ctes(DELIVERIES + "," + sequential("dl"), """
SELECT arrival_seq, number_key, supplier_key FROM dl JOIN fold USING (arrival_seq) WHERE hit IS NULL""", recursive=True),
    "import_outcomes": with_ctes(OUTCOMES, "SELECT arrival_seq, file_name, sha256, status, source_format, invoice_id, message FROM oo", recursive=True),
    "run_summary": with_ctes(OUTCOMES, """
SELECT *, files || ' Datei(en) verarbeitet: ' || imported || ' importiert' || CASE WHEN duplicates > 0 THEN ', ' || duplicates || ' Duplikat(e)' ELSE '' END
       || CASE WHEN failures > 0 THEN ', ' || failures || ' mit Fehler' ELSE '' END || '.' AS summary
FROM (SELECT strftime(invoice_date, '%Y-%m') AS run, count(*) AS files, count(*) FILTER (status = 'imported') AS imported, count(*) FILTER (status = 'duplicate') AS duplicates,
             count(*) FILTER (status = 'validation_failed') AS failures, CAST(0 AS BIGINT) AS retries FROM oo GROUP BY 1)""", recursive=True),
    "item_texts": with_ctes(OUTCOMES, f"""
SELECT arrival_seq, status, CASE status WHEN 'imported' THEN 'Imported' WHEN 'duplicate' THEN 'Duplicate' ELSE 'Failed' END AS state,
       CASE status WHEN 'imported' THEN 'Importiert' WHEN 'duplicate' THEN 'Duplikat' ELSE 'Prüfung fehlgeschlagen' END
         || CASE WHEN kind <> 'same_file' THEN ' · ' || source_format ELSE '' END AS status_text,
       CASE WHEN kind <> 'same_file' THEN supplier_name || ' · ' || invoice_number || ' · ' || {money('gross_total')} || ' ' || currency END AS summary,
       CASE WHEN kind <> 'same_file' THEN supplier_street || ', ' || supplier_postal_code || ' ' || supplier_city END AS supplier_address,
       duration_text, file_name || CASE WHEN kind <> 'same_file' THEN '  ·  ' || source_format || ' – gelesen' ELSE '' END || '  ·  ' || duration_text AS meta_text
FROM (SELECT *, CASE WHEN doc_id % 2500 < 1000 THEN (doc_id % 2500) || ' ms'
                     ELSE replace(CAST(CAST(round(CAST(doc_id % 2500 AS DECIMAL(18,3)) * CAST(0.001 AS DECIMAL(4,3)), 1) AS DECIMAL(18,1)) AS VARCHAR), '.', ',') || ' s' END AS duration_text FROM oo)""", recursive=True),
    "archive_paths": with_ctes(OUTCOMES, """
SELECT arrival_seq, strftime(invoice_date, '%Y') AS year, strftime(invoice_date, '%m') AS month,
       strftime(invoice_date, '%Y/%m/') || sha256[1:12] || '_' || file_name AS archive_path FROM oo WHERE status = 'imported'""", recursive=True),
    "inbox_disposition": with_ctes(MANIFEST, """
SELECT arrival_seq, disposition, target_name, CASE WHEN disposition = 'failed' THEN target_name || '.fehler.txt' END AS report_name FROM mm""", recursive=True),
    "error_reports": with_ctes(MANIFEST, """
, fl AS (SELECT * FROM mm WHERE disposition = 'failed')
SELECT arrival_seq, target_name || '.fehler.txt' AS report_name, 0 AS section, 1 AS line_number, '' AS rule, 'Datei:     ' || target_name AS text FROM fl
UNION ALL SELECT arrival_seq, target_name || '.fehler.txt', 0, 2, '', 'Zeitpunkt: 01.01.2006 12:30:15' FROM fl
UNION ALL SELECT arrival_seq, target_name || '.fehler.txt', 0, 3, '', 'Ergebnis:  ' || message FROM fl
UNION ALL SELECT arrival_seq, target_name || '.fehler.txt', section, line_number, rule, '  - ' || text FROM fl JOIN er USING (doc_id)""", recursive=True),
    "report_invoices": with_ctes(STORED, """
SELECT id, supplier_name AS lieferant, invoice_number AS rechnungsnr, invoice_date AS datum, CAST(net_total AS DOUBLE) AS netto, CAST(tax_total AS DOUBLE) AS ust,
       CAST(gross_total AS DOUBLE) AS brutto, (SELECT count(*) FROM sl WHERE invoice_id = id) AS positionen,
       CASE WHEN id % 2 = 0 THEN 'XRechnung UBL' ELSE 'XRechnung CII' END AS quelle FROM si"""),
    "report_lines": with_ctes(STORED, """
SELECT invoice_number AS rechnungsnr, line_number AS pos, article_number AS artikelnr, description AS bezeichnung, CAST(quantity AS DOUBLE) AS menge,
       CAST(free_quantity AS DOUBLE) AS gratis, unit AS einheit, CAST(unit_price AS DOUBLE) AS einzelpreis, CAST(discount_percent AS DOUBLE) AS rabatt_proz,
       CAST(discount_amount AS DOUBLE) AS rabatt, CAST(net_amount AS DOUBLE) AS betrag, CAST(vat_rate AS DOUBLE) AS ust_satz FROM sl JOIN si ON id = invoice_id"""),
    "report_log": with_ctes(LOG, """
SELECT date_trunc('second', processed_at + INTERVAL 500 MILLISECOND) AS zeit, file_name AS datei, status, source_format AS quelle, invoice_id AS rechnung_id,
       message AS meldung, errors AS fehler FROM lg"""),
    "latest_invoices": with_ctes(STORED, f"""
SELECT id, supplier_name, supplier_vat_id, invoice_number, invoice_date, due_date, currency, {dbl('net_total', 'tax_total', 'gross_total')},
       CASE WHEN id % 2 = 0 THEN 'XRechnung UBL' ELSE 'XRechnung CII' END AS source_format, 'inv_' || id || '.xml' AS source_file,
       strftime(invoice_date, '%Y/%m/') || file_sha256[1:12] || '_inv_' || id || '.xml' AS archive_path,
       (SELECT count(*) FROM sl WHERE invoice_id = id) AS line_count FROM si ORDER BY id DESC LIMIT 500"""),
    "latest_log": with_ctes(LOG, "SELECT * EXCLUDE (processed_at) FROM lg ORDER BY id DESC LIMIT 500"),
    "invoice_lines_of": with_ctes(STORED, f"""
SELECT line_number, article_number, description, {dbl('quantity', 'free_quantity')}, unit, {dbl('unit_price', 'discount_percent', 'discount_amount', 'net_amount', 'vat_rate')}
FROM sl WHERE invoice_id = 100"""),
    "integrity_audit": with_ctes(STORED + "," + LOG, _audit()),
    "log_view": with_ctes(LOG, """
SELECT id, strftime(timezone('Europe/Berlin', timezone('UTC', processed_at)), '%Y-%m-%d %H:%M:%S') AS local_time, file_name, status,
       CASE status WHEN 'imported' THEN 'Importiert' WHEN 'duplicate' THEN 'Duplikat' WHEN 'validation_failed' THEN 'Prüfung fehlgeschlagen' ELSE 'Fehler' END AS status_text,
       CASE status WHEN 'imported' THEN 'Imported' WHEN 'duplicate' THEN 'Duplicate' ELSE 'Failed' END AS state FROM lg"""),
    "ubl_round_trip": _round_trip("UBL", "true"),
    "cii_round_trip": _round_trip("CII", "false"),
    "syntax_routing": f"""
SELECT 'inv_' || o_orderkey || '.xml' AS file_name, '.xml' AS ext, {_XML_FORMAT.replace('doc_id', 'o_orderkey')} AS source_format, 'ok' AS read_status, NULL AS read_message FROM orders
UNION ALL SELECT 'seite_' || page_id || CASE WHEN page_id % 2 = 0 THEN '.XML' ELSE '.html' END, CASE WHEN page_id % 2 = 0 THEN '.xml' ELSE '.html' END, NULL, 'failed',
  CASE WHEN page_id % 2 = 0 THEN 'Auslesen fehlgeschlagen: XML-Datei ist keine bekannte E-Rechnung (weder UBL noch CII).'
       ELSE 'Dateiformat ".html" wird nicht unterstützt (PDF oder XML).' END FROM pages""",
    "embedded_xml_choice": with_ctes(VIEW + parsed("doc_id % 2 = 0"), """
SELECT doc_id, seq, CASE seq WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'Factur-X.xml' ELSE 're_' || doc_id || '.XML' END
                             ELSE CASE WHEN doc_id % 4 < 2 THEN 'xrechnung.xml' ELSE 'kopie.xml' END END AS name,
       CASE WHEN doc_id % 2 = 0 THEN 'UBL' ELSE 'CII' END AS syntax,
       CASE WHEN doc_id % 4 < 2 THEN 'urn:cen.eu:en16931:2017#compliant#urn:xeinkauf.de:kosit:xrechnung_3.0' ELSE 'urn:cen.eu:en16931:2017' END AS profile,
       invoice_number, CAST(gross_total AS DOUBLE) AS gross_total
FROM (SELECT *, CASE WHEN doc_id % 5 <> 0 AND (doc_id % 2 = 0 OR doc_id % 4 >= 2 OR doc_id % 3 = 0) THEN 3
                     WHEN doc_id % 3 <> 0 THEN 4 WHEN doc_id % 5 <> 0 THEN 3 END AS seq FROM rh)
WHERE seq IS NOT NULL"""),
    "model_answers": with_ctes(ANSWERS, """
SELECT doc_id, CASE WHEN again THEN 'retry' WHEN message IS NOT NULL THEN 'failed' ELSE 'ok' END AS read_status, message AS read_message,
       CASE WHEN message IS NULL THEN 'PDF via OpenAI' END AS source_format, CASE WHEN message IS NULL THEN description END AS description,
       CASE WHEN message IS NULL THEN trim(invoice_number) END AS invoice_number, CASE WHEN message IS NULL THEN currency END AS currency,
       CASE WHEN message IS NULL AND doc_id % 61 <> 0 THEN due_date END AS due_date, CASE WHEN message IS NULL THEN CAST(gross_total AS DOUBLE) END AS gross_total,
       CASE WHEN message IS NULL THEN CAST(coalesce(n, 0) AS INT) END AS line_count
FROM an LEFT JOIN (SELECT doc_id, count(*) AS n FROM pl GROUP BY 1) USING (doc_id) WHERE first"""),
    "second_read": with_ctes(ANSWERS + f""",
e1 AS (SELECT * FROM {_error_counts(False)}), e2 AS (SELECT * FROM {_error_counts(True)}),
rd AS (SELECT a.doc_id, a.message AS m1, a.again, a.description, b.message AS m2, coalesce(e1.n, 0) AS n1, coalesce(e2.n, 0) AS n2,
              a.message IS NULL AND coalesce(e1.n, 0) > 0 AS reread
       FROM an a JOIN an b ON a.doc_id = b.doc_id AND a.first AND NOT b.first LEFT JOIN e1 ON e1.doc_id = a.doc_id LEFT JOIN e2 ON e2.doc_id = a.doc_id)""", """
SELECT doc_id, CASE WHEN reread THEN CASE WHEN doc_id % 7 = 0 THEN 'retry' WHEN m2 IS NOT NULL THEN 'failed' ELSE 'ok' END
                    WHEN again THEN 'retry' WHEN m1 IS NOT NULL THEN 'failed' ELSE 'ok' END AS read_status,
       CASE WHEN reread THEN CASE WHEN doc_id % 7 = 0 THEN 'Zweites Lesen steht noch aus.' ELSE m2 END ELSE m1 END AS read_message,
       reread AND doc_id % 7 <> 0 AND m2 IS NULL AS second_read,
       CASE WHEN reread AND doc_id % 7 <> 0 AND m2 IS NULL THEN n2 ELSE 0 END AS error_count,
       CASE WHEN reread THEN CASE WHEN doc_id % 7 <> 0 AND m2 IS NULL THEN description || ' · zweimal gelesen' END WHEN m1 IS NULL THEN description END AS description
FROM rd"""),
    "check_run": with_ctes(XML_ERRORS, """
SELECT doc_id, CASE WHEN n IS NULL THEN 'valid' ELSE 'validation_failed' END AS result, coalesce(n, 0) AS error_count, coalesce(errors, '') AS errors
FROM rh LEFT JOIN (SELECT doc_id, CAST(count(*) AS INT) AS n, string_agg(text, chr(10) ORDER BY text) AS errors FROM er GROUP BY 1) USING (doc_id)"""),
    "xml_import": with_ctes(XML_OUTCOMES.replace("'inv_' || doc_id || '.xml' AS file_name", "'inv_' || copy || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.xml' AS file_name"),
                            "SELECT arrival_seq, status, invoice_id, source_format, message FROM oo", recursive=True),
    "stream_import": with_ctes(XML_OUTCOMES, """
SELECT 'inv_' || (arrival_seq // 1000000000000) || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.xml' AS file_name, status, source_format,
       CASE WHEN status = 'validation_failed' THEN errors END AS errors
FROM oo LEFT JOIN (SELECT doc_id, string_agg(text, chr(10) ORDER BY text) AS errors FROM er GROUP BY 1) USING (doc_id)""", recursive=True),
    "store_two_writers": with_ctes(XML_OUTCOMES, """
SELECT 'inv_' || (arrival_seq // 1000000000000) || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.xml' AS file_name, status,
       CAST(invoice_id IS NOT NULL AS BIGINT) AS stored, invoice_id IS NOT NULL AS has_lines
FROM oo""", recursive=True),
    "incremental_import": with_ctes(XML_OUTCOMES, """
SELECT 'inv_1_' || lpad(CAST(b.doc_id AS VARCHAR), 12, '0') || '.xml' AS file_name, b.status, NOT (b.doc_id % 10 = 1 AND a.status = 'imported') AS was_read,
       b.status = 'duplicate' AND b.invoice_id < 1000000000000 AS repeats_stored
FROM oo b JOIN oo a ON a.doc_id = b.doc_id AND a.arrival_seq < 1000000000000 WHERE b.arrival_seq >= 1000000000000""", recursive=True),
    "stored_originals": with_ctes(XML_OUTCOMES, """
SELECT 'inv_' || (arrival_seq // 1000000000000) || '_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.xml' AS file_name,
       CASE status WHEN 'imported' THEN 'delete' WHEN 'duplicate' THEN 'duplicates' ELSE 'failed' END AS disposition, true AS intact, NULL AS kept_sha256
FROM oo
UNION ALL SELECT 'doc_' || doc_id || '.txt', 'failed', true, sha256(coalesce(text, '')) FROM documents""", recursive=True),
    "store_pending": """
SELECT 'doc_' || doc_id || '.pdf' AS file_name, CASE WHEN sha256(coalesce(text, '')) < '8' THEN 'failed' ELSE 'waiting' END AS state, sha256(coalesce(text, '')) AS sha256
FROM documents""",
}

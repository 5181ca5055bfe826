"""Validation rules V1-V12.

One set of rule expressions serves two shapes of data:

* nested: one row per document with an array of lines (XML and JSON sources) - no shuffle at all;
* flat: headers and lines as two tables - lines are pre-aggregated per (document, rate) and then per document, so a
  document or a rate with very many lines never lands in one task as raw rows.

A finding is a struct (rule, line_number, text). A rule is a `Rule` and the two lists below can be extended.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import day, is_blank, money, percent_of

Access = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """A business rule: when `broken` holds, `text` is reported. Both get an accessor from field name to Column."""

    code: str
    broken: Callable[[Access, "Settings"], Column]
    text: Callable[[Access, "Settings"], Column]


@dataclass(frozen=True)
class Settings:
    as_of: date
    tolerance: str = "0.02"
    max_days_in_future: int = 1
    extra_line_rules: list[Rule] = field(default_factory=list)
    extra_header_rules: list[Rule] = field(default_factory=list)

    @property
    def limit(self) -> Column:
        return F.lit(self.tolerance).cast("decimal(10,4)")

    @property
    def latest(self) -> Column:
        return F.date_add(F.lit(self.as_of.isoformat()).cast("date"), self.max_days_in_future)


def expected_line_amount(quantity: Column, unit_price: Column, discount_amount: Column, discount_percent: Column) -> Column:
    """round(q * p - discount, 2); the discount is the printed amount, else the rounded percentage, else 0."""
    gross = (quantity * unit_price).cast("decimal(36,14)")
    discount = F.coalesce(discount_amount.cast("decimal(22,6)"), percent_of(gross, discount_percent).cast("decimal(22,6)"),
                          F.lit(0).cast("decimal(22,6)"))
    return F.round(gross - discount, 2).cast("decimal(26,2)")


def _expected(get: Access) -> Column:
    return expected_line_amount(get("quantity"), get("unit_price"), get("discount_amount"), get("discount_percent"))


def _off(left: Column, right: Column, limit: Column) -> Column:
    return F.coalesce(F.abs(left - right) > limit, F.lit(False))


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("decimal(20,6)"))


def _sum_after_adjustments(get: Access) -> Column:
    return get("line_sum") - _zero(get("allowance_total")) + _zero(get("charge_total"))


def _no_adjustments(get: Access) -> Column:
    return (_zero(get("allowance_total")) == 0) & (_zero(get("charge_total")) == 0)


def _net_text(get: Access, s: Settings) -> Column:
    plain = F.concat(F.lit("Summe der Positionen "), money(get("line_sum")), F.lit(" ≠ Nettobetrag "), money(get("net_total")), F.lit("."))
    adjusted = F.concat(F.lit("Positionen "), money(get("line_sum")), F.lit(" − Abschläge "), money(_zero(get("allowance_total"))),
                        F.lit(" + Zuschläge "), money(_zero(get("charge_total"))), F.lit(" = "), money(_sum_after_adjustments(get)),
                        F.lit(" ≠ Nettobetrag "), money(get("net_total")), F.lit("."))
    return F.when(_no_adjustments(get), plain).otherwise(adjusted)


def _label(get: Access) -> Column:
    return F.concat(F.lit("Position "), get("line_number").cast("string"), F.lit(": "))


def expected_tax(get: Access) -> Column:
    """Tax from the line rates; null when it cannot be known."""
    single = percent_of(get("net_total"), get("top_rate"))
    return (F.when((get("line_count") == 0) | get("has_open_rate"), F.lit(None).cast("decimal(28,2)"))
            .when(get("rate_count") == 1, single)
            .when(_no_adjustments(get), get("rate_tax").cast("decimal(28,2)")))


# The codes and the German texts of the rules.
LINE_RULES = [
    Rule("V7", lambda g, s: is_blank(g("description")),
         lambda g, s: F.concat(_label(g), F.lit("Bezeichnung fehlt."))),
    Rule("V8", lambda g, s: F.coalesce((g("quantity") < 0) | (F.coalesce(g("free_quantity"), F.lit(0)) < 0), F.lit(False)),
         lambda g, s: F.concat(_label(g), F.lit("negative Menge."))),
    Rule("V9", lambda g, s: _off(_expected(g), g("net_amount"), s.limit),
         lambda g, s: F.concat(_label(g), F.lit("Menge × Preis − Rabatt = "), money(_expected(g)),
                               F.lit(", auf der Rechnung steht "), money(g("net_amount")), F.lit("."))),
]

HEADER_RULES = [
    Rule("V1", lambda g, s: is_blank(g("invoice_number")), lambda g, s: F.lit("Rechnungsnummer fehlt.")),
    Rule("V2", lambda g, s: is_blank(g("supplier_name")), lambda g, s: F.lit("Lieferant fehlt.")),
    Rule("V3", lambda g, s: F.coalesce(F.length(g("currency")), F.lit(0)) != 3,
         lambda g, s: F.concat(F.lit('Ungültige Währung "'), F.coalesce(g("currency"), F.lit("")), F.lit('".'))),
    Rule("V4", lambda g, s: g("invoice_date") > s.latest,
         lambda g, s: F.concat(F.lit("Rechnungsdatum "), day(g("invoice_date")), F.lit(" liegt in der Zukunft."))),
    Rule("V5", lambda g, s: F.year(g("invoice_date")) < 2000,
         lambda g, s: F.concat(F.lit("Rechnungsdatum "), day(g("invoice_date")), F.lit(" ist nicht plausibel."))),
    Rule("V6", lambda g, s: g("line_count") == 0, lambda g, s: F.lit("Keine Rechnungspositionen gefunden.")),
]

TOTAL_RULES = [
    Rule("V10", lambda g, s: (g("line_count") > 0) & _off(_sum_after_adjustments(g), g("net_total"), s.limit), _net_text),
    Rule("V11", lambda g, s: _off(g("net_total") + g("tax_total"), g("gross_total"), s.limit),
         lambda g, s: F.concat(F.lit("Netto "), money(g("net_total")), F.lit(" + USt "), money(g("tax_total")),
                               F.lit(" ≠ Brutto "), money(g("gross_total")), F.lit("."))),
    Rule("V12", lambda g, s: _off(expected_tax(g), g("tax_total"), s.limit * g("rate_count")),
         lambda g, s: F.concat(F.lit("USt laut Steuersätzen "), money(expected_tax(g)), F.lit(" ≠ USt auf der Rechnung "),
                               money(g("tax_total")), F.lit("."))),
]


def _findings(rules: list[Rule], get: Access, settings: Settings, line_number: Column) -> Column:
    """array<struct<rule,line_number,text>> of the broken rules, in rule order."""
    return F.array_compact(F.array(*_candidates(rules, get, settings, line_number)))


def _candidates(rules: list[Rule], get: Access, settings: Settings, line_number: Column) -> list[Column]:
    """One nullable finding per rule."""
    return [F.when(r.broken(get, settings), F.struct(F.lit(r.code).alias("rule"), line_number.cast("int").alias("line_number"),
                                                     r.text(get, settings).alias("text"))) for r in rules]


def count_broken(rules: list[Rule], get: Access, settings: Settings) -> Column:
    return reduce(lambda a, b: a + b, [F.when(r.broken(get, settings), 1).otherwise(0) for r in rules])


def line_findings(get: Access, settings: Settings) -> Column:
    return _findings(LINE_RULES + settings.extra_line_rules, get, settings, get("line_number"))


def opening_findings(get: Access, settings: Settings) -> Column:
    return _findings(HEADER_RULES, get, settings, F.lit(None))


def closing_findings(get: Access, settings: Settings) -> Column:
    return _findings(TOTAL_RULES + settings.extra_header_rules, get, settings, F.lit(None))


# Nested shape -----------------------------------------------------------------------------------------------------

_SUM = "decimal(30,6)"


def _nested_totals(lines: Column) -> dict[str, Column]:
    rate = lambda l: l["vat_rate"].cast("decimal(9,4)")
    rates = F.array_distinct(F.transform(F.filter(lines, lambda l: l["vat_rate"].isNotNull()), rate))

    def add(items: Column) -> Column:
        return F.aggregate(items, F.lit(0).cast(_SUM), lambda acc, l: (acc + l["net_amount"]).cast(_SUM))

    def tax_of(r: Column) -> Column:
        return percent_of(add(F.filter(lines, lambda l: rate(l) == r)), r)

    return {
        "line_count": F.size(lines),
        "line_sum": add(lines),
        "rate_count": F.size(rates),
        "top_rate": F.array_max(rates),
        "has_open_rate": F.exists(lines, lambda l: l["vat_rate"].isNull()),
        "rate_tax": F.aggregate(rates, F.lit(0).cast("decimal(28,2)"), lambda acc, r: (acc + tax_of(r)).cast("decimal(28,2)")),
    }


def with_findings(df: DataFrame, settings: Settings, invoice: str = "invoice", out: str = "findings") -> DataFrame:
    """Add all findings of a nested invoice in reporting order; null when there is no invoice.

    The sums are a projection of their own: inside the rules they would be computed again for every mention.
    """
    lines = F.coalesce(F.col(invoice)["lines"], F.array().cast(_lines_type()))
    totals = _nested_totals(lines)
    df = df.withColumn("_totals", F.struct(*[c.alias(n) for n, c in totals.items()]))

    def get(name: str) -> Column:
        return F.col("_totals")[name] if name in totals else F.col(invoice)[name]

    per_line = F.flatten(F.transform(lines, lambda l: line_findings(lambda name: l[name], settings)))
    found = F.concat(opening_findings(get, settings), per_line, closing_findings(get, settings))
    return df.withColumn(out, F.when(F.col(invoice).isNotNull(), found)).drop("_totals")


def with_errors(df: DataFrame, settings: Settings) -> DataFrame:
    """Add `errors`: the texts of all findings, empty when there is nothing to check."""
    texts = F.coalesce(F.transform("findings", lambda f: f["text"]), F.array().cast("array<string>"))
    return with_findings(df, settings).withColumn("errors", texts).drop("findings")


def _lines_type():
    from ..schemas import INVOICE
    return INVOICE["lines"].dataType


# Flat shape -------------------------------------------------------------------------------------------------------

def vat_groups(lines: DataFrame, doc: str = "doc_id", net: str = "net_amount", rate: str = "vat_rate") -> DataFrame:
    """Net amount and line count per document and rate; 19 and 19.00 are one rate."""
    return (lines.groupBy(doc, F.col(rate).cast("decimal(9,4)").alias("vat_rate"))
            .agg(F.sum(net).cast(_SUM).alias("net"), F.count(F.lit(1)).alias("lines")))


def flat_totals(groups: DataFrame, doc: str = "doc_id", *more: Column) -> DataFrame:
    """Per-document sums from the per-rate groups."""
    return groups.groupBy(doc).agg(
        *more,
        F.sum("lines").alias("line_count"),
        F.sum("net").cast(_SUM).alias("line_sum"),
        F.count("vat_rate").alias("rate_count"),
        F.max("vat_rate").alias("top_rate"),
        F.max(F.col("vat_rate").isNull()).alias("has_open_rate"),
        F.sum(percent_of(F.col("net"), F.col("vat_rate"))).alias("rate_tax"),
    )


def with_totals(headers: DataFrame, lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Headers with the sums of their lines; one row per document on both sides of the join."""
    return _join_totals(headers, flat_totals(vat_groups(lines, doc), doc), doc)


def _join_totals(headers: DataFrame, totals: DataFrame, doc: str) -> DataFrame:
    return (headers.join(totals, doc, "left")
            .withColumn("line_count", F.coalesce("line_count", F.lit(0)))
            .withColumn("line_sum", F.coalesce("line_sum", F.lit(0).cast(_SUM)))
            .withColumn("rate_count", F.coalesce("rate_count", F.lit(0)))
            .withColumn("has_open_rate", F.coalesce("has_open_rate", F.lit(False))))


def _found(df: DataFrame, doc: str, section: int, candidates: list[Column]) -> DataFrame:
    """One row per finding. The rules are evaluated once, in a projection: a filter on them would be pushed below the
    projections that made its inputs, repeating their arithmetic."""
    rows = df.select(doc, F.explode(F.array(*candidates)).alias("f")).where(F.col("f").isNotNull())
    return rows.select(doc, F.lit(section).alias("section"), "f.line_number", "f.rule", "f.text")


def flat_line_errors(lines: DataFrame, settings: Settings, doc: str = "doc_id") -> DataFrame:
    """One row per broken line rule; no shuffle."""
    return _found(lines, doc, 2, _candidates(LINE_RULES + settings.extra_line_rules, F.col, settings, F.col("line_number")))


def flat_header_errors(totals: DataFrame, settings: Settings, doc: str = "doc_id") -> DataFrame:
    """One row per broken header or total rule; both sections come from one pass over the headers."""
    opening = _candidates(HEADER_RULES, F.col, settings, F.lit(None))
    closing = _candidates(TOTAL_RULES + settings.extra_header_rules, F.col, settings, F.lit(None))
    codes = [r.code for r in HEADER_RULES]
    return _found(totals, doc, 3, opening + closing).withColumn("section", F.when(F.col("rule").isin(codes), 1).otherwise(3))


def flat_errors(headers: DataFrame, lines: DataFrame, settings: Settings, doc: str = "doc_id") -> DataFrame:
    """Every error as a row (document, section, line_number, rule, text); sorting by these gives reporting order."""
    return flat_header_errors(with_totals(headers, lines, doc), settings, doc).unionByName(flat_line_errors(lines, settings, doc))


def flat_error_counts(headers: DataFrame, lines: DataFrame, settings: Settings, doc: str = "doc_id") -> DataFrame:
    """Headers with `error_count`. Sums and line errors come from one pass over the lines."""
    broken = count_broken(LINE_RULES + settings.extra_line_rules, F.col, settings)
    groups = lines.groupBy(doc, F.col("vat_rate").cast("decimal(9,4)").alias("vat_rate")).agg(
        F.sum("net_amount").cast(_SUM).alias("net"), F.count(F.lit(1)).alias("lines"), F.sum(broken).alias("line_errors"))
    totals = _join_totals(headers, flat_totals(groups, doc, F.sum("line_errors").alias("line_errors")), doc)
    own = count_broken(HEADER_RULES + TOTAL_RULES + settings.extra_header_rules, F.col, settings)
    return (totals.withColumn("error_count", (own + F.coalesce("line_errors", F.lit(0))).cast("int")).drop("line_errors"))

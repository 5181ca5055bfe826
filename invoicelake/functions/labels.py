"""Fixed texts: unit names, formats, status texts and outcome messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, money

# Unit codes and their texts.
UNIT_TEXTS = {
    "H87": "Stk",
    "C62": "Stk",
    "KGM": "kg",
    "LTR": "l",
    "XBX": "Karton",
    "XCS": "Kiste",
    "XCR": "Kiste",
    "XPK": "Pack",
    "XRO": "Rolle",
    "HUR": "Std",
}

# Status codes, German texts and the state shown for them.
STATUS_TEXTS = {
    "imported": "Importiert",
    "duplicate": "Duplikat",
    "validation_failed": "Prüfung fehlgeschlagen",
    "failed": "Fehler",
}
LOG_STATES = {"imported": "Imported", "duplicate": "Duplicate", "validation_failed": "Failed", "failed": "Failed"}
ITEM_TEXTS = {
    "waiting": "Wartet",
    "processing": "Wird verarbeitet …",
    "imported": "Importiert",
    "duplicate": "Duplikat",
    "retry": "Nicht verarbeitet",
    "validation_failed": "Prüfung fehlgeschlagen",
}
ITEM_STATES = {"imported": "Imported", "duplicate": "Duplicate", "retry": "Retry",
               "waiting": "Waiting", "processing": "Processing"}
MODEL_FORMAT = "PDF via OpenAI"
EMBEDDED_FORMAT = "ZUGFeRD PDF"


def lookup_text(code: Column, table: dict[str, str], otherwise: Column) -> Column:
    """A value from a small fixed table, as one lookup in a constant map."""
    entries = F.create_map(*[F.lit(part) for item in table.items() for part in item])
    return F.coalesce(F.try_element_at(entries, code), otherwise)


def unit_text(code: Column) -> Column:
    return lookup_text(code, UNIT_TEXTS, code)


def status_text(code: Column) -> Column:
    return lookup_text(code, STATUS_TEXTS, F.coalesce(code, F.lit("")))


def log_state(code: Column) -> Column:
    return lookup_text(code, LOG_STATES, F.lit("Waiting"))


def item_state(status: Column) -> Column:
    return lookup_text(status, ITEM_STATES, F.lit("Failed"))


def item_status_text(status: Column, source_format: Column) -> Column:
    """Status text, with the source format where one is known."""
    text = lookup_text(status, ITEM_TEXTS, F.lit("Fehler"))
    return F.concat(text, F.when(source_format.isNotNull(), F.concat(F.lit(" · "), source_format)).otherwise(F.lit("")))


def xml_kind(profile: Column) -> Column:
    return F.when(F.contains(F.lower(F.coalesce(profile, F.lit(""))), F.lit("xrechnung")), F.lit("XRechnung")).otherwise(F.lit("E-Rechnung"))


def summary_text(supplier: Column, number: Column, gross: Column, currency: Column) -> Column:
    return F.concat(F.coalesce(supplier, F.lit("")), F.lit(" · "), F.coalesce(number, F.lit("")), F.lit(" · "),
                    money(gross), F.lit(" "), F.coalesce(currency, F.lit("")))


def join_nonblank(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: ~is_blank(p)), separator)


def address_text(street: Column, postal_code: Column, city: Column) -> Column:
    place = F.trim(F.concat(F.coalesce(postal_code, F.lit("")), F.lit(" "), F.coalesce(city, F.lit(""))))
    return join_nonblank(", ", street, place)


def duration_text(ms: Column) -> Column:
    """Milliseconds below one second, else seconds with one decimal comma digit."""
    seconds = F.format_number(F.round(ms.cast("decimal(18,3)") * F.lit("0.001").cast("decimal(4,3)"), 1), 1)
    return (F.when(ms < 1000, F.concat(F.round(ms, 0).cast("bigint").cast("string"), F.lit(" ms")))
            .when(ms.isNotNull(), F.concat(F.translate(seconds, ".,", ","), F.lit(" s"))))


def meta_text(file_name: Column, description: Column, duration: Column) -> Column:
    return join_nonblank("  ·  ", file_name, description, duration)


def archive_path(invoice_date: Column, sha256: Column, file_name: Column) -> Column:
    return F.concat_ws("/", F.date_format(invoice_date, "yyyy"), F.date_format(invoice_date, "MM"),
                       F.concat(F.substring(sha256, 1, 12), F.lit("_"), file_name))


# The texts of the outcome messages -------------------------------------------------------------------------------------------------

def msg_same_file(number: Column, invoice_id: Column) -> Column:
    return F.format_string("Identische Datei wurde bereits importiert (Rechnung %s, ID %d).", number, invoice_id)


def msg_same_invoice(number: Column, supplier: Column, invoice_id: Column, file_name: Column) -> Column:
    return F.format_string("Rechnung %s von %s ist bereits importiert (ID %d, aus %s).", number, supplier, invoice_id, file_name)


def msg_constraint(number: Column, constraint: Column) -> Column:
    return F.format_string("Rechnung %s ist bereits importiert (%s)", number, constraint)


def msg_unsupported(ext: Column) -> Column:
    return F.format_string('Dateiformat "%s" wird nicht unterstützt (PDF oder XML).', ext)


def msg_unreadable(reason: Column) -> Column:
    return F.concat(F.lit("Auslesen fehlgeschlagen: "), reason)


def msg_unexpected(reason: Column) -> Column:
    return F.concat(F.lit("Unerwarteter Fehler: "), reason)


def msg_rejected(second_read: Column) -> Column:
    return (F.when(second_read, F.lit("Prüfung fehlgeschlagen, auch nach zweitem Lesen – nicht gespeichert."))
            .otherwise(F.lit("Prüfung fehlgeschlagen – nicht gespeichert.")))


def msg_stored(second_read: Column, invoice_id: Column) -> Column:
    passed = F.when(second_read, F.lit("Prüfung beim zweiten Lesen bestanden")).otherwise(F.lit("Prüfung bestanden"))
    return F.concat(passed, F.lit(" – gespeichert (ID "), invoice_id.cast("string"), F.lit(")."))


def msg_not_loaded(reason: Column) -> Column:
    return F.concat(F.lit("Datei nicht lesbar: "), reason)



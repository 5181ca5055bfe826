"""Imports end to end: store, log, archive, disposition, re-runs, stream."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as D
from pathlib import Path

from pyspark.sql import functions as F

from invoicelake.operators import sinks
from invoicelake.operators.audit import integrity_audit
from invoicelake.operators.store import Store, constraint_conflicts
from invoicelake.operators.totals import calculated_lines, invoice_totals, rate_groups
from invoicelake.operators.validate import Settings
from invoicelake.plans import catalog, importing, reports, synth
from invoicelake.plans.importing import check_run, import_batch, import_into
from invoicelake.sources.files import in_inbox, list_files, not_loaded, read_documents, with_arrival
from invoicelake.streaming.inbox import start_import, watch_files, watch_packed
from conftest import SF_DIR
from samples import AS_OF, cii, ubl
from test_readers import SCHEMA, answer, row

SETTINGS = Settings(as_of=AS_OF)
AT = datetime(2026, 10, 1, 8, 0, 0)


def put(folder: Path, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_bytes(text if isinstance(text, bytes) else text.encode())


def log_of(store):
    return {r["file_name"]: (r["status"], r["invoice_id"]) for r in store.table("processing_log").collect()}


FILES = dict(A1__xml=ubl("RE-1"), a2__xml=ubl("RE-1"), B__xml=cii("re 1"), C__xml=ubl("RE-2", gross="1"), notiz__txt="Hallo", d__xml=cii("RE-3"), e__xml="<Order/>")
WANT = {"A1.xml": ("imported", 1), "a2.xml": ("duplicate", 1), "B.xml": ("duplicate", 1), "C.xml": ("validation_failed", None), "d.xml": ("imported", 5),
        "e.xml": ("failed", None), "notiz.txt": ("failed", None)}


def test_inbox_import(spark, tmp_path):
    put(tmp_path / "in", **FILES, **{"~lock__xml": "x", "t__tmp": "x", "mit leer__xml": ubl("RE-9")})
    documents = in_inbox(read_documents(spark, str(tmp_path / "in")))
    store = Store(spark, str(tmp_path / "store")).create()
    batch = import_into(store, 0, documents, SETTINGS, at=AT)
    log = log_of(store)
    assert log == WANT | {"mit leer.xml": ("imported", 7), "notiz.txt": ("failed", None)}
    assert batch.outcomes.count() == 8
    messages = {r["file_name"]: (r["message"], r["errors"]) for r in store.table("processing_log").collect()}
    assert messages["a2.xml"][0] == "Identische Datei wurde bereits importiert (Rechnung RE-1, ID 1)."
    assert messages["B.xml"][0] == "Rechnung re 1 von Papierhof & Söhne ist bereits importiert (ID 1, aus A1.xml)."
    assert messages["A1.xml"] == ("Prüfung bestanden – gespeichert (ID 1).", None)
    assert messages["C.xml"][1] == "Netto 613,50 + USt 116,57 ≠ Brutto 1,00."
    invoices = {r["id"]: r for r in store.table("invoices").collect()}
    assert invoices[1]["gross_total"] == D("730.07") and invoices[1]["supplier_key"] == "VAT:DE309457216"
    archived = {r["invoice_id"]: r for r in store.table("archive").collect()}
    assert archived.keys() == invoices.keys()
    assert bytes(archived[1]["content"]) == FILES["A1__xml"].encode() and archived[1]["year"] == "2026"
    assert invoices[1]["archive_path"] == archived[1]["archive_path"] == f"2026/09/{invoices[1]['file_sha256'][:12]}_A1.xml"
    moves = {r["file_name"]: r for r in store.table("dispositions").collect()}
    assert {k: m["disposition"] for k, m in moves.items()} == {"A1.xml": "delete", "a2.xml": "duplicates", "B.xml": "duplicates", "C.xml": "failed", "d.xml": "delete",
                                                             "e.xml": "failed", "notiz.txt": "failed", "mit leer.xml": "delete"}
    assert moves["C.xml"]["report"] == ("Datei:     C.xml\nZeitpunkt: 01.10.2026 08:00:00\nErgebnis:  Prüfung fehlgeschlagen – nicht gespeichert.\n"
                                        "  - Netto 613,50 + USt 116,57 ≠ Brutto 1,00.\n")
    assert all(r["violations"] == 0 for r in integrity_audit(store.table("invoices"), store.table("invoice_lines"), store.table("processing_log")).collect())
    # The same batch again changes nothing; the same files as a new batch import nothing and get new names.
    assert import_into(store, 0, documents, SETTINGS, at=AT) is None
    import_into(store, 1, documents, SETTINGS, at=AT)
    assert store.table("invoices").count() == 3 and store.table("processing_log").count() == 16
    again = {r["target_name"] for r in store.table("dispositions").collect() if r["arrival_seq"] > 8}
    assert {"C_20261001-080000.xml", "a2_20261001-080000.xml", "A1.xml"} <= again
    newest = reports.latest_invoices(store.table("invoices"), store.table("invoice_lines"), 2).collect()
    assert [(r["id"], r["line_count"]) for r in newest] == [(7, 1), (5, 1)]


def test_uncommitted_rows_are_invisible(spark, tmp_path):
    put(tmp_path / "in", A__xml=ubl("RE-1"))
    store = Store(spark, str(tmp_path / "store")).create()
    batch = import_batch(read_documents(spark, str(tmp_path / "in")), SETTINGS, at=AT)
    store.write("invoices", "c0-aborted", batch.invoices())
    assert store.table("invoices").count() == 0
    import_into(store, 0, read_documents(spark, str(tmp_path / "in")), SETTINGS, at=AT)
    assert store.table("invoices").count() == store.table("invoice_lines").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store")).create()
    for part in (["A1__xml", "a2__xml", "B__xml"], ["C__xml", "d__xml", "e__xml", "notiz__txt"]):
        put(tmp_path / "in", **{k: FILES[k] for k in part})
        start_import(watch_files(spark, str(tmp_path / "in")), store, SETTINGS, str(tmp_path / "cp"), at=AT).awaitTermination()
    got = log_of(store)
    assert {k: s for k, (s, _) in got.items()} == {k: s for k, (s, _) in WANT.items()}
    assert got["B.xml"] == ("duplicate", 1)
    assert store.batches().count() == 2


def test_retry_waits_and_comes_back(spark, tmp_path):
    """A PDF whose answer is missing stays out of the log and is imported when the answer has arrived."""
    store = Store(spark, str(tmp_path / "store")).create()
    put(tmp_path / "raw", p__pdf=b"PDF", x__xml=ubl("RE-1"))
    docs = read_documents(spark, str(tmp_path / "raw"))
    sha = docs.where("ext = '.pdf'").first()["sha256"]
    docs.write.parquet(str(tmp_path / "in"))
    none = spark.createDataFrame([], SCHEMA)
    there = spark.createDataFrame([row(sha, 1, answer("RE-5"))], SCHEMA)
    for answers in (none, there):
        start_import(watch_packed(spark, str(tmp_path / "in")), store, SETTINGS, str(tmp_path / "cp"), lambda s, a=answers: {"answers": a}, at=AT).awaitTermination()
        docs.where("ext = '.xml'").withColumn("path", F.lit("again")).write.mode("append").parquet(str(tmp_path / "in"))
        first = log_of(store)
        assert ("p.pdf" in first) == (answers is there)
    assert log_of(store)["p.pdf"][0] == "imported"
    assert store.pending().count() == 0


def test_files_that_cannot_be_opened(spark, tmp_path):
    put(tmp_path / "in", A__xml=ubl("RE-1"), B__xml=ubl("RE-2"))
    loaded = read_documents(spark, str(tmp_path / "in"), "A*")
    gone = not_loaded(list_files(spark, str(tmp_path / "in")), loaded, "gesperrt")
    got = {r["file_name"]: (r["status"], r["message"]) for r in import_batch(loaded, SETTINGS, not_loaded=gone, at=AT).outcomes.collect()}
    assert got["B.xml"] == ("retry", "Datei nicht lesbar: gesperrt") and got["A.xml"][0] == "imported"


def test_conflict_with_another_writer(spark, tmp_path):
    put(tmp_path / "in", A__xml=ubl("RE-1"), B__xml=ubl("RE-2"))
    batch = import_batch(read_documents(spark, str(tmp_path / "in")), SETTINGS, at=AT)
    other = batch.invoices().where("invoice_number = 'RE-1'").withColumn("file_sha256", F.lit("f" * 64))
    got = constraint_conflicts(batch.imported_headers(), other).collect()
    assert [(r["arrival_seq"], r["constraint"]) for r in got] == [(1, "uq_invoices_supplier_number")]


def test_other_writers_are_counted(spark, tmp_path):
    """Equal batch numbers of different writers, numbers out of order: no document is lost and no id comes twice."""
    store = Store(spark, str(tmp_path / "store")).create()
    for name in ("one", "two"):
        put(tmp_path / name, **{f"{name}__xml": ubl(f"RE-{name}")})
        start_import(watch_files(spark, str(tmp_path / name)), store, SETTINGS, str(tmp_path / f"cp-{name}"), at=AT).awaitTermination()
    for number in (1, 0):
        put(tmp_path / f"b{number}", **{f"b{number}__xml": ubl(f"RE-{number}")})
        import_into(store, number, read_documents(spark, str(tmp_path / f"b{number}")), SETTINGS, at=AT)
    assert log_of(store) == {"one.xml": ("imported", 1), "two.xml": ("imported", 2), "b1.xml": ("imported", 3), "b0.xml": ("imported", 4)}


def test_lost_commit_decides_again(spark, tmp_path, monkeypatch):
    """Another writer stores the same number between decision and commit: the loser's document and its follower point to the stored one."""
    store = Store(spark, str(tmp_path / "store")).create()
    put(tmp_path / "in", A__xml=ubl("RE-1"), B__xml=cii("re 1"), C__xml=ubl("RE-2"))
    put(tmp_path / "other", X__xml=cii("RE 1"))
    commit, tries = store.commit, []

    def late(*args):
        if not tries:
            tries.append(args[1])
            import_into(Store(spark, store.root), 0, read_documents(spark, str(tmp_path / "other")), SETTINGS, writer="other", at=AT)
        return commit(*args)

    monkeypatch.setattr(store, "commit", late)
    import_into(store, 0, read_documents(spark, str(tmp_path / "in")), SETTINGS, at=AT)
    assert log_of(store) == {"X.xml": ("imported", 1), "A.xml": ("duplicate", 1), "B.xml": ("duplicate", 1), "C.xml": ("imported", 4)}
    assert not (tmp_path / "store" / "invoices" / f"attempt={tries[0]}").exists()
    assert [r["writer"] for r in store.batches().orderBy("commit").collect()] == ["other", "batch"]


def test_a_lost_commit_reads_nothing_again(spark, tmp_path, monkeypatch):
    """The other writer stores a file of the batch and lets a document wait: of all documents the retry reads only that one."""
    store = Store(spark, str(tmp_path / "store")).create()
    put(tmp_path / "in", A__xml=ubl("RE-1"), B__xml=cii("re 1"), C__xml=ubl("RE-2"), D__xml=ubl("RE-3", gross="1"))
    put(tmp_path / "other", X__xml=cii("RE 2"), Y__xml=ubl("RE-1"), W__pdf="waits")
    commit, tries, parsed, real = store.commit, [], [], importing.read_all

    def counted(documents, *rest):
        parsed.append(sorted(r["file_name"] for r in documents.select("file_name").collect()))
        return real(documents, *rest)

    def late(*args):
        tries.append(args[1])
        if len(tries) == 1:
            import_into(Store(spark, store.root), 0, read_documents(spark, str(tmp_path / "other")), SETTINGS, writer="other", at=AT)
        return commit(*args)

    monkeypatch.setattr(importing, "read_all", counted)
    monkeypatch.setattr(store, "commit", late)
    import_into(store, 0, read_documents(spark, str(tmp_path / "in")), SETTINGS, at=AT)
    assert parsed == [["A.xml", "B.xml", "C.xml", "D.xml"], ["W.pdf", "X.xml", "Y.xml"], ["W.pdf"]] and len(tries) == 2
    assert log_of(store) == {"X.xml": ("imported", 2), "Y.xml": ("imported", 3), "A.xml": ("duplicate", 3), "B.xml": ("duplicate", 3),
                             "C.xml": ("duplicate", 2), "D.xml": ("validation_failed", None)}
    assert [r["file_name"] for r in store.pending().collect()] == ["W.pdf"]


def test_check_run(spark, tmp_path):
    put(tmp_path / "in", A__xml=ubl("RE-1"), C__xml=ubl("RE-2", gross="1"), n__txt="x")
    got = {r["file_name"]: r["report"] for r in check_run(read_documents(spark, str(tmp_path / "in")), SETTINGS).collect()}
    assert got["A.xml"].splitlines()[0] == "=== A.xml" and got["A.xml"].endswith("    Prüfung: OK")
    assert "    Nr. RE-1 vom 17.09.2026, fällig 17.10.2026, Bestellung " in got["A.xml"]
    assert got["C.xml"].endswith("    Prüfung: FEHLER\n      - Netto 613,50 + USt 116,57 ≠ Brutto 1,00.")
    assert got["n.txt"] == "=== n.txt\n    kein passender Reader"


def test_arrival_order(spark):
    names = ["b.xml", "A.xml", "a.xml", "Z.xml", "c.xml"] + [f"n{i:03d}.xml" for i in range(50)]
    df = spark.createDataFrame([(n, n) for n in names], "path string, file_name string").repartition(3)
    got = [r["file_name"] for r in with_arrival(df, 10).orderBy("arrival_seq").collect()]
    assert got == sorted(names, key=lambda n: (n.upper(), n))
    assert [r["arrival_seq"] for r in with_arrival(df, 10).orderBy("arrival_seq").collect()] == list(range(10, 65))


def test_names_in_target_folders(spark):
    o = spark.createDataFrame([(1, "a.xml", "failed"), (2, "a.xml", "failed"), (3, "b.xml", "duplicate"), (4, "b.xml", "duplicate"), (5, "b.xml", "duplicate"),
                               (6, "c.xml", "retry"), (7, "ohne", "failed")], "arrival_seq long, file_name string, status string")
    taken = spark.createDataFrame([("failed", "ohne"), ("duplicates", "a.xml")], "disposition string, file_name string")
    got = {r["arrival_seq"]: r["target_name"] for r in sinks.inbox_manifest(o, taken, AT).collect()}
    assert got == {1: "a.xml", 2: "a_20261001-080000.xml", 3: "b.xml", 4: "b_20261001-080000-4.xml", 5: "b_20261001-080000-5.xml", 6: None, 7: "ohne_20261001-080000"}


def test_calculated_totals(spark):
    """Specified invoices: line discounts and an allowance, mixed rates with free goods, and a forced net total."""
    lines = [
        ("disc", 1, "3", "118", "15", 0, 19), ("disc", 2, "7", "9.40", "0", 0, 19), ("disc", 3, "5", "6.30", "4", 0, 19), ("disc", 4, "2", "63", "0", 0, 19),
        ("forced", 1, "1", "312.60", "0", 0, 19), ("mix", 1, "1", "100", "0", 5, 19), ("mix", 2, "1", "50", "0", 0, 7)]
    df = spark.createDataFrame([(d, n, D(q), D(p), D(r), D(f), D(v)) for d, n, q, p, r, f, v in lines],
                               "doc_id string, line_number int, quantity decimal(16,6), unit_price decimal(20,8), discount_percent decimal(9,4), "
                               "free_quantity decimal(16,6), vat_rate decimal(9,4)")
    terms = spark.createDataFrame([("disc", D(2), None), ("forced", D(0), D("321.60")), ("mix", D(1), None), ("none", D(0), None)],
                                  "doc_id string, allowance_percent decimal(9,4), printed_net decimal(28,2)")
    got = {r["doc_id"]: r for r in invoice_totals(rate_groups(calculated_lines(df)), terms).collect()}
    assert [got["disc"][c] for c in ("line_total", "allowance", "net", "tax", "gross")] == [D("522.94"), D("10.46"), D("512.48"), D("97.37"), D("609.85")]
    assert [got["forced"][c] for c in ("net", "tax", "gross")] == [D("321.60"), D("61.10"), D("382.70")]
    assert got["mix"]["allowance_rejected"] and got["mix"]["has_free_goods"] and got["mix"]["net"] is None and got["mix"]["several_rates"]
    assert got["disc"]["has_discount"] and not got["disc"]["several_rates"] and got["none"]["gross"] == D(0)
    assert date(2026, 1, 1)


def test_stream_cleans_its_folder(spark, tmp_path):
    """Files of a finished run are deleted by the next one."""
    store = Store(spark, str(tmp_path / "store")).create()
    for name in ("A", "B"):
        put(tmp_path / "in", **{f"{name}__xml": ubl(f"RE-{name}")})
        start_import(watch_files(spark, str(tmp_path / "in"), clean="delete"), store, SETTINGS, str(tmp_path / "cp"), at=AT).awaitTermination()
    assert {s for s, _ in log_of(store).values()} == {"imported"} and len(log_of(store)) == 2
    assert "A.xml" not in {p.name for p in (tmp_path / "in").iterdir()}


def test_archive_rows_without_locator(spark):
    """Outcomes that come from no store have no locator."""
    imported = spark.createDataFrame([(7, date(2026, 9, 3), "0123456789abcdef", "x.xml")], "arrival_seq long, invoice_date date, sha256 string, file_name string")
    assert [r.asDict() for r in sinks.archive_rows(imported).collect()] == [
        {"arrival_seq": 7, "year": "2026", "month": "09", "archive_path": "2026/09/0123456789ab_x.xml"}]


def test_staged_columns(spark):
    """Decisions stage the header columns they need; headers are not shuffled by supplier."""
    d = catalog.deliveries_with_status(spark, SF_DIR)
    assert "supplier_street" not in d.columns and "supplier_street" in catalog.deliveries_with_status(spark, SF_DIR, "supplier_street").columns
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = synth.invoice_view(spark, SF_DIR)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning(s_suppkey" not in plan

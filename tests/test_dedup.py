"""Duplicate detection against one-by-one processing in plain Python."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal as D

import pytest

from invoicelake.functions import labels  # noqa: F401
from invoicelake.operators import dedup, outcome
from invoicelake.operators.lookup import anti_lookup, hot_keys, left_lookup

CANDIDATE = "arrival_seq long, number_key string, supplier_key string, invoice_date date, gross_total decimal(20,6)"


def cents(x):
    return x.quantize(D("0.01"))


def one_by_one(rows):
    stored, imported = [], set()
    for seq, n, s, d, g in sorted(rows):
        if not any(n == n2 and (s == s2 or (d == d2 and g == g2)) for n2, s2, d2, g2 in stored):
            stored.append((n, s, d, cents(g)))
            imported.add(seq)
    return imported


def random_rows(seed, n=300, hot=True):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        number = "HOT" if hot and rnd.random() < 0.4 else f"N{rnd.randrange(12)}"
        gross = D(rnd.randrange(100, 130)) / 4 if rnd.random() < 0.8 else D(rnd.randrange(25000, 25040)) / 1000
        rows.append((seq, number, f"S{rnd.randrange(9)}", date(2026, 1, 1 + rnd.randrange(3)), gross))
    return rows


@pytest.mark.parametrize("fold_rows,hot_rows", [(10_000, 10_000), (0, 10_000), (0, 3), (20, 3)])
def test_greedy_imports(spark, fold_rows, hot_rows):
    for seed in (1, 2):
        rows = random_rows(seed)
        got = dedup.greedy_imports(spark.createDataFrame(rows, CANDIDATE), fold_rows, hot_rows)
        assert {r["arrival_seq"] for r in got.collect()} == one_by_one(rows)


def test_long_chain(spark):
    """Every document shares a node with the next one only: the first, third, fifth ... are imported."""
    rows = [(i, "N", f"S{(i + 1) // 2}", date(2026, 1, 1), D(i // 2)) for i in range(24)]
    for fold_rows in (100, 0):
        got = dedup.greedy_imports(spark.createDataFrame(rows, CANDIDATE), fold_rows)
        assert {r["arrival_seq"] for r in got.collect()} == one_by_one(rows) == set(range(0, 24, 2))


@pytest.mark.parametrize("hot_rows", [10_000, 2])
def test_lookups_with_hot_keys(spark, hot_rows):
    left = spark.createDataFrame([(i, "a" if i % 3 else f"k{i}") for i in range(30)] + [(99, None)], "i int, k string")
    right = spark.createDataFrame([("a", 1), ("k3", 2), ("zz", 3)], "k string, v int")
    hot = hot_keys(left, ["k"], hot_rows)
    assert (hot is None) == (hot_rows > 100)
    want = {(i, 1 if i % 3 else 2 if i == 3 else None) for i in range(30)} | {(99, None)}
    assert {(r["i"], r["v"]) for r in left_lookup(left, right, ["k"], hot).collect()} == want
    assert {r["i"] for r in anti_lookup(left, right, ["k"], hot).collect()} == {i for i, v in want if v is None}


def simulate(docs, stored):
    """Outcome per document as (status, invoice_id), processing one document after the other."""
    out = {}
    stored = list(stored)
    for d in sorted(docs, key=lambda d: d["seq"]):
        same = next((s for s in stored if s["sha"] == d["sha"]), None)
        if same:
            out[d["seq"]] = ("duplicate", same["id"])
        elif d["own"] != "valid":
            out[d["seq"]] = (d["own"], None)
        else:
            match = sorted((s for s in stored if s["n"] == d["n"] and (s["s"] == d["s"] or (s["d"] == d["d"] and s["g"] == d["g"]))), key=lambda s: s["id"])
            if match:
                out[d["seq"]] = ("duplicate", match[0]["id"])
            else:
                stored.append(dict(d, id=d["seq"], g=cents(d["g"])))
                out[d["seq"]] = ("imported", d["seq"])
    return out


@pytest.mark.parametrize("seed,fold_rows,hot_rows", [(1, 1000, 10_000), (2, 0, 2), (3, 0, 10_000)])
def test_decide(spark, seed, fold_rows, hot_rows):
    rnd = random.Random(seed)
    contents = []
    for c in range(120):
        contents.append(dict(sha=f"h{c}", own=rnd.choice(["valid"] * 5 + ["failed", "validation_failed", "retry"]), n=f"N{rnd.randrange(6)}",
                             s=f"NAME:S{rnd.randrange(6)}", d=date(2026, 1, 1 + rnd.randrange(2)), g=D(rnd.randrange(100, 110))))
    docs = []
    for seq in range(400):
        c = contents[0] if rnd.random() < 0.3 else rnd.choice(contents)
        # Equal bytes under another extension have no reader and fail.
        docs.append(dict(c, seq=1000 + seq, own="failed" if rnd.random() < 0.1 else c["own"]))
    stored = [dict(sha="h5", id=1, n="N1", s="NAME:S1", d=date(2026, 1, 1), g=D(100)), dict(sha="x", id=2, n="N2", s="NAME:S2", d=date(2026, 1, 2), g=D(101)),
              dict(sha="y", id=3, n="N2", s="NAME:S3", d=date(2026, 1, 2), g=D(101))]
    schema = ("arrival_seq long, file_name string, sha256 string, own_status string, own_message string, second_read boolean, source_format string, "
              "invoice_number string, supplier_name string, supplier_vat_id string, invoice_date date, gross_total decimal(20,6)")
    frame = spark.createDataFrame([(d["seq"], f"f{d['seq']}", d["sha"], d["own"], "m", False, "x", d["n"], d["s"][5:], None, d["d"], d["g"]) for d in docs], schema)
    table = spark.createDataFrame([(s["id"], s["sha"], s["s"], s["n"], s["d"], s["g"], s["n"], s["s"], "old.xml") for s in stored],
                                  "id long, file_sha256 string, supplier_key string, invoice_number_key string, invoice_date date, gross_total decimal(18,2), "
                                  "invoice_number string, supplier_name string, source_file string")
    for use, have in ((table, stored), (None, [])):
        got = {r["arrival_seq"]: (r["status"], r["invoice_id"]) for r in outcome.decide(frame, use, fold_rows, hot_rows).collect()}
        assert len(got) == len(docs)
        assert got == simulate(docs, have)


def test_summary(spark):
    df = spark.createDataFrame([("a", s) for s in ["imported", "duplicate", "failed", "validation_failed", "retry", "retry"]] + [("b", "duplicate")], "run string, status string")
    got = {r["run"]: r["summary"] for r in outcome.run_summary(df, "run").collect()}
    assert got == {"a": "6 Datei(en) verarbeitet: 1 importiert, 1 Duplikat(e), 2 mit Fehler, 2 nicht verarbeitet.",
                   "b": "1 Datei(en) verarbeitet: 0 importiert, 1 Duplikat(e)."}


def test_many_large_keys(spark, monkeypatch):
    """More large number keys than may be broadcast: same result by plain joins."""
    monkeypatch.setattr(dedup, "BROADCAST_KEYS", 0)
    rows = random_rows(5, n=120)
    got = dedup.greedy_imports(spark.createDataFrame(rows, CANDIDATE), 15)
    assert {r["arrival_seq"] for r in got.collect()} == one_by_one(rows)

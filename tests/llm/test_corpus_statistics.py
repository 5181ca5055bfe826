"""Collocations, whitening and host rules: brute force, the SQL on odd inputs, and the parts of their methods."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from invoicelake.llm import collocations, host_rules, whitening

DOCS = "doc_id long, text string, lang string, source string, n long, host string, g string, rank int"
ODD = [(1, None, None, "a", 1, "x", "y", 1), (2, "", "en", None, 1, "x", "y", 1), (3, "Word, word. " * 9000, "en", "a", 1, "x", "y", 1), (None, "a b a b a b # %", None, "", None, None, None, None),
       (4, "one two three. one two\nthree four\n\none two\nthree four", "en", "b", 1, "x", "y", 1), (4, "one two three. one two\nthree four\n\none two\nthree four", "en", "b", 1, "x", "y", 1),
       (5, " \t\r\n\x0b.,;", "de", "b", 2, "y", "y", 2), (6, "Über ÜBER über\xa0x İ " * 12, "de", "c", 3, "z", "y", 3), (7, "x" * 60_000, "de", "c", 3, "z", "y", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def by_sql(spark, docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"text": "string", "lang": "string", "source": "string"}))
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)


def test_host_rules_equal_sql_on_odd_inputs(spark, odd):
    got = host_rules.report(odd)
    assert rows_of(got) == by_sql(spark, odd, host_rules.ORACLE) and got.count() == len(ODD)
    assert host_rules.report(odd.limit(0)).count() == 0


def test_hosts_are_shrunk_and_rejected(spark):
    """A large bad host goes whole, a tiny one with the same rate does not; a clean document of the bad host goes with it."""
    good, bad = "plain words of an ordinary text that says something new all the time", "spam"
    rows = [(h * 1000 + i, bad if i % 10 else good, f"h{h}") for h in (0,) for i in range(400)]
    rows += [(h * 1000 + i, good if i % 20 else bad, f"h{h}") for h in range(1, 41) for i in range(40)] + [(90_001, bad, "tiny"), (90_002, bad, "tiny"), (90_003, good, "tiny")]
    got = {r["doc_id"]: r for r in host_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["host_rejected"] and not got[0]["kept"] and not got[0]["base_failed"]
    assert got[90_003]["kept"] and not got[90_001]["kept"] and got[1001]["kept"]


def test_prior_without_spread_or_hosts(spark):
    even = spark.createDataFrame([(f"h{i}", 10, 1, 1, 1, 1, 1) for i in range(5)], "host string, documents long, " + ", ".join(f"{r} long" for r in host_rules.RULES))
    mean, strength = host_rules.priors(even)["symbols"]
    assert mean == pytest.approx(0.1) and strength is None
    assert set(host_rules.priors(even.withColumn("documents", F.lit(1).cast("long"))).values()) == {None}


def test_collocations_equal_sql_on_odd_inputs(spark, odd):
    got = collocations.collocations(odd, limit=4000)
    assert rows_of(got) == by_sql(spark, odd, collocations.ORACLE) and got.where("phrase = 'word'").count() == 0
    assert collocations.collocations(odd.limit(0)).count() == 0


@pytest.mark.parametrize("shards,bits,groups", [(1, 20, 100_000), (3, 20, 0), (7, 15, 100_000)])
def test_collocations_over_shards(spark, monkeypatch, shards, bits, groups):
    """Any number of shards, a Bloom filter that holds nearly everything, small blocks and tallies, supports by join: the same result."""
    rng = random.Random(shards)
    runs = [[f"w{rng.randrange(25)}" for _ in range(rng.randrange(2, 7))] for _ in range(20)]
    words = [w for _ in range(2500) for w in runs[min(19, int(rng.expovariate(0.2)))]]
    rows = [(i % 11, " ".join(w + rng.choice(["", "", "", "", "", "", ",", "\n"]) for w in words[30 * i:30 * i + 30]), rng.choice(["en", "de", None]), "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    monkeypatch.setattr(collocations, "GROUPS", groups)
    got = collocations.collocations(docs, shards=shards, bits=bits, limit=700)
    assert rows_of(got) == by_sql(spark, docs, collocations.ORACLE) and got.count() > 30


def test_tally_gives_every_count_once():
    block = collocations.Block([b"a b a. b a", b"a c"], [5, 5], [1, 2])
    tally = collocations.Tally(3)
    tally.lang = {1: "en", 2: "en"}
    for _ in range(2):
        tally.add(block, block.key(1), np.arange(len(block.words)))
    rows = [r for batch in tally.rows() for r in batch.to_pylist()]
    assert sum(np.frombuffer(r["counts"], np.uint32).sum() for r in rows) == 14 and not tally.parts
    assert [t for r in rows for t in r["totals"]] == [{"lang": "en", "g": 1, "n": 10}, {"lang": "en", "g": 2, "n": 4}]


def test_cut_long_loses_no_piece():
    text = b"aa bb, cc.dd ee;;ff" * 50 + b"x" * 100 + b".y"
    parts = list(collocations.cut_long(text, 40))
    assert len(parts) > 10
    pieces = lambda t: [p for p in __import__("re").split(rb"[.,;:!?\n-\r]", t) if p]
    assert [p for part in parts for p in pieces(part)] == pieces(text)


# Whitening ----------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, n string, component string, w string, z string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "n", "c", "w", "z") for i, v in enumerate(vectors)], VECTORS).repartition(3)


def brute(vectors, count=8):
    x = np.floor(np.array(vectors) * 1024) + 100_000
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return x, values, (x - x.mean(axis=0)) @ axes / np.sqrt(values), values / np.trace(np.cov(x.T, bias=True))


def test_whitening_equals_brute_force(spark):
    vectors = np.random.default_rng(3).normal(size=(200, 12)) @ np.diag(np.arange(1, 13) / 6)
    rows = vectors.tolist()
    got = whitening.whitened(table(spark, rows + [None, [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e300] * 12, [1.0], []])).collect()
    x, values, want, share = brute(rows)
    assert len(got) == 200 * 8 and {r["n"] for r in got} == {200}
    mine = np.zeros((200, 8))
    for r in got:
        mine[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(share[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
        assert r["deviation"] == int(sum((200 * int(c) - int(s)) ** 2 for c, s in zip(x[r["vec_id"]], x.sum(axis=0)))) == int(r["deviation_exact"])
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-9


def test_polynomial_and_roots_with_multiplicity(spark):
    q, _ = np.linalg.qr(np.random.default_rng(1).integers(-3, 4, (6, 6)) + np.eye(6))
    a = np.zeros((7, 7), object)
    a[:3, :3] = [[2, 1, 1], [1, 2, 1], [1, 1, 2]]  # 4, 1, 1
    a[3, 3], a[4, 4], a[5, 5] = 4, 10**25, 1
    c = whitening.characteristic_polynomial(spark, a)
    want = [1]
    for root in (4, 1, 1, 4, 10**25, 1, 0):
        want = [x - root * y for x, y in zip([0, *want], [*want, 0])]
    assert c == want
    one = 1 << whitening.FRACTION_BITS
    assert [(r / one, m) for r, m in whitening.largest_roots(c[1:], 6, 10**25 + 11)] == [(1e25, 1), (4.0, 2), (1.0, 3)]
    values, axes = whitening.principal(spark, a, 7)
    assert len(values) == 6 and np.abs(axes @ axes.T - np.eye(6)).max() < 1e-14
    assert np.abs((a.astype(float) @ axes.T - axes.T * values)[:, 1:]).max() < 1e-9


def test_whitening_of_few_or_equal_vectors(spark):
    """Rank 1: one component, nothing in the others. Equal vectors: none. Empty table: no rows."""
    line = whitening.whitened(table(spark, [[1.0, 2.0, 0.0], [2.0, 4.0, 0.0], [2.0, 4.0, 0.0]])).collect()
    assert len(line) == 9 and {r["component"] for r in line if r["whitened"] is not None} == {1} and line[0]["identity_error"] < 1e-12
    same = whitening.whitened(table(spark, [[1.0, 2.0]] * 4)).collect()
    assert len(same) == 8 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    assert whitening.whitened(table(spark, [None, [1.0]]).limit(0)).count() == 0


def test_whitening_of_very_large_entries(spark):
    """Entries near the end of the long range: exact sums, a deviation beyond a long is null but has its digits."""
    rows = [[8.9e15, 1.0], [-8.9e15, 2.0], [3.0, 5.0]]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(table(spark, rows)).collect()}
    x = [[int(np.floor(c * 1024)) + 100_000 for c in r] for r in rows]
    sums = [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        exact = sum((3 * c - s) ** 2 for c, s in zip(v, sums))
        assert int(got[i, 1]["deviation_exact"]) == exact and got[i, 1]["deviation"] == (exact if exact < 1 << 63 else None)
    assert got[0, 1]["identity_error"] < 1e-9

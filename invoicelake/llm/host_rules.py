"""Quality rules with host-level verdicts.

Every document is measured by itself and fails or passes each rule. The failures are added up per host (the column `source`),
and every host's rate is shrunk towards what hosts are like in general: the rates of all hosts are taken as drawn from a beta
distribution, whose two parameters come from the hosts themselves (empirical Bayes), so a host's rate is (failures + alpha) /
(documents + alpha + beta). A host with a few documents keeps near the prior, one with many keeps its own rate. A host is
rejected if the shrunk rate of any rule passes `HOST_LIMIT`; the verdict is joined back to the documents. A document is kept
if it fails no rule itself and its host is not rejected: where most documents of a host fail, the others are not trusted either.

- The prior is fitted by moments over hosts with two documents or more, each host counting once: the mean of k/n and the mean
  of k(k-1)/(n(n-1)), which is unbiased for the square of a host's rate. Both are sums of integers (parts of `SCALE`), so
  the order of additions does not matter. Hosts that differ no more than chance leave a variance of zero or less: then all
  of them have the mean rate. Without a host of two documents there is no prior and rates are k/n.
- Words are runs of bytes other than white space (`[^\\x20\\x09-\\x0D]+`). A repeated word lies in a window of five words that
  occurs twice or more in its text, the first occurrence included; windows are compared by 64-bit hash within a text.
- Only rejected hosts are joined back, by a join that keeps a host with a large share of all rows out of the shuffle.

Cases: null and empty texts have no words and fail the first rule; a null source counts as the empty one, a host like any
other; every row is measured by itself, so repeated rows and null ids give a row each; an empty table gives an empty result;
other columns are ignored. A text is measured whole, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoicelake.llm.spans import byte_set, joined, span_hashes, word_borders
from invoicelake.llm.words import BASE, EXACT, Batches, mapped, mix, text_slices
from invoicelake.operators.lookup import hot_keys, left_lookup
from invoicelake.session import staged

WINDOW = 5
HOST_LIMIT = 0.5
SCALE = 1_000_000_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SPACE = byte_set(32, (9, 13))
SYMBOL = byte_set(*b"#*$%&|<>")
FOLLOWING = byte_set((128, 191))  # bytes of a character after its first

#: A document fails a rule if the expression over MEASURES holds.
BASE_RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
}
RULES = BASE_RULES | {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}


def _repeated(text: np.ndarray, words: np.ndarray, rows: int) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(rows, np.int64)
    window = mix(text[:n].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        window = mix(window * BASE + words[k:k + n])
    at = np.flatnonzero(text[:n] == text[WINDOW - 1:])
    _, which, times = np.unique(window[at], return_inverse=True, return_counts=True)
    at = at[times[which] >= 2]
    depth = np.zeros(len(words) + 1, np.int64)
    depth[at] += 1
    depth[at + WINDOW] -= 1
    return np.bincount(text[np.cumsum(depth[:-1]) > 0], minlength=rows)


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes]) -> list[np.ndarray]:
    """MEASURES of every text."""
    rows = len(texts)
    data, _, offset = joined(texts)
    start, end = word_borders(data, ~SPACE)
    text = np.searchsorted(offset, start, "right") - 1
    first = np.concatenate([[0], np.cumsum(~(SPACE | FOLLOWING)[data])])
    lines = [_lines(t) for t in texts]
    return [np.bincount(text, minlength=rows),
            np.bincount(text, weights=first[end] - first[start], minlength=rows).astype(np.int64),
            np.bincount(np.searchsorted(offset, np.flatnonzero(SYMBOL[data]), "right") - 1, minlength=rows),
            np.array([x for x, _ in lines], np.int64), np.array([x for _, x in lines], np.int64),
            _repeated(text, span_hashes(data, EXACT, start, end), rows)]


def _measure(batches: Batches) -> Batches:
    for batch, texts in text_slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(m, pa.int64()) for m in measure(texts)]], ["doc_id", "host", *MEASURES])


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and MEASURES of every row, without the texts."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    return staged(mapped(rows, _measure, kind), "measured")


def host_counts(documents: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """host, documents, and the number that fails each rule."""
    return staged(documents.groupBy("host").agg(F.count(F.lit(1)).alias("documents"), *[F.count_if(F.expr(rule)).alias(name) for name, rule in rules.items()]), "hosts")


def priors(hosts: DataFrame, rules: dict[str, str] = RULES) -> dict[str, tuple[float, float | None] | None]:
    """Mean rate and strength (alpha + beta) of each rule's beta prior; strength None: no spread; None: no prior."""
    def part(of: str, name: str) -> Column:
        n, k = "cast(documents as decimal(19,0))", f"cast({name} as decimal(19,0))"
        top, below = (k, n) if of == "mean" else (f"({k} * ({k} - 1))", f"({n} * ({n} - 1))")
        return F.sum(F.expr(f"cast(({top} * {SCALE}) div {below} as decimal(20,0))")).alias(f"{name}_{of}")

    sums = hosts.where("documents >= 2").agg(F.count(F.lit(1)).alias("hosts"), *[part(of, name) for name in rules for of in ("mean", "square")]).first()
    found: dict[str, tuple[float, float | None] | None] = {}
    for name in rules:
        if not sums["hosts"]:
            found[name] = None
            continue
        mean, square = (float(sums[f"{name}_{of}"]) / (sums["hosts"] * float(SCALE)) for of in ("mean", "square"))
        spread = square - mean * mean
        found[name] = (mean, (mean - square) / spread if spread > 0 else None)
    return found


def host_rates(hosts: DataFrame, prior: dict[str, tuple[float, float | None] | None], limit: float = HOST_LIMIT) -> DataFrame:
    """Hosts with the shrunk rate of every rule (`<rule>_rate`) and the verdict `host_rejected`."""
    def rate(name: str) -> Column:
        if prior[name] is None:
            return F.col(name) / F.col("documents")
        mean, strength = prior[name]
        if strength is None:
            return F.lit(mean)
        return (F.col(name) + F.lit(mean * strength)) / (F.col("documents") + F.lit(strength))

    rated = hosts.withColumns({f"{name}_rate": rate(name) for name in prior})
    return rated.withColumn("host_rejected", F.greatest(F.lit(False), *[F.col(f"{name}_rate") > limit for name in prior]))


def _any(rules: dict[str, str]) -> Column:
    return F.expr(" or ".join(f"({rule})" for rule in rules.values()))


def judged(docs: DataFrame, host: str = "source", rules: dict[str, str] = RULES, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of `docs`: doc_id, MEASURES, base_failed, host_rejected, kept."""
    documents = measured(docs, host)
    hosts = host_counts(documents, rules)
    rejected = staged(host_rates(hosts, priors(hosts, rules), limit).where("host_rejected").select("host", "host_rejected"), "rejected")
    found = left_lookup(documents, rejected, ["host"], hot_keys(hosts, ["host"], rows="documents"))
    found = found.withColumn("base_failed", _any(BASE_RULES)).withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return found.select("doc_id", *MEASURES, "base_failed", "host_rejected", (~F.col("base_failed") & ~_any(rules) & ~F.col("host_rejected")).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def _oracle() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in RULES.items())
    moments = ", ".join(f"sum(({name}::HUGEINT * {SCALE}) // documents)::DOUBLE / (count(*) * {SCALE}::DOUBLE) AS {name}_m, "
                        f"sum(({name}::HUGEINT * ({name} - 1) * {SCALE}) // (documents::HUGEINT * (documents - 1)))::DOUBLE / (count(*) * {SCALE}::DOUBLE) AS {name}_q" for name in RULES)
    strength = ", ".join(f"CASE WHEN {n}_q - {n}_m * {n}_m > 0 THEN ({n}_m - {n}_q) / ({n}_q - {n}_m * {n}_m) END AS {n}_s" for n in RULES)
    bad = " OR ".join(f"CASE WHEN {n}_m IS NULL THEN {n} / documents::DOUBLE WHEN {n}_s IS NULL THEN {n}_m ELSE ({n} + {n}_m * {n}_s) / (documents + {n}_s) END > {HOST_LIMIT}" for n in RULES)
    base = " OR ".join(f"({rule})" for rule in BASE_RULES.values())
    failed = " OR ".join(f"({rule})" for rule in RULES.values())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c >= 2),
repeated AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, unnest([0, 1, 2, 3, 4]) AS u(o) GROUP BY r),
m AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls)::BIGINT AS n_lines,
             len(ls)::BIGINT - len(list_distinct(ls))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM w LEFT JOIN repeated USING (r)),
hosts AS (SELECT host, count(*) AS documents, {counts} FROM m GROUP BY host),
moments AS (SELECT {moments} FROM hosts WHERE documents >= 2),
prior AS (SELECT *, {strength} FROM moments),
verdict AS (SELECT host, {bad} AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({failed}) AND NOT host_rejected AS kept, host_rejected
FROM m JOIN verdict USING (host)
"""


ORACLE = _oracle()

"""Registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from invoicelake.llm import collocations, decontam, exact_dedup, host_rules, jaccard_join, line_dedup, pieces, pii, quality, span_dedup, toxicity, warc, whitening
from invoicelake.llm.words import table


def op1_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_quality(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_span_dedup(spark, sf_dir):
    return span_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def op8_line_dedup(spark, sf_dir):
    return line_dedup.without_copies(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op10_pieces(spark, sf_dir):
    return pieces.tokens(table(spark, sf_dir, "documents"))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_host_rules(spark, sf_dir):
    return host_rules.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_toxicity, op3_warc, op4_quality, op5_exact_dedup, op6_span_dedup, op7_decontamination, op8_line_dedup, op9_jaccard_join, op10_pieces, op11_collocations, op12_whitening, op13_host_rules)}

ORACLE = {
    "op3_warc": warc.ORACLE,
    "op5_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, sha256(s) AS text_sha256
FROM t
""",
    "op7_decontamination": decontam.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op13_host_rules": host_rules.ORACLE,
}
